"""Rule-based text functions: intents, profanity, ordinals, titles.

The word lists and patterns below are fixed values: they must equal the
source system's lists for identical routing decisions.  The source used
Python regular expressions, whose ``\\b`` and case folding are Unicode-aware
(G14).  Java's ``\\b`` is not, so word boundaries are written out with
Unicode classes (``\\pL`` letters, ``\\pN`` digits, ``_``) and matched with
the ``(?iu)`` flags; the same pattern body also runs on RE2 engines, which is
how the SQL oracles reuse it (``sql_pattern``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shiftwise.functions.scalars import strip

# --- Fixed values (must equal the source system's rules) ---------------------
# Intent rules, checked in this order: code words -> out_of_scope; ordinal
# reference -> ordinal; pages / author / year / this-book -> book_followup;
# otherwise recommendation.  Each entry is a regex alternation that is matched
# as a whole word (word boundary on both sides).
INTENT_CODE = [r"python|javascript|typescript|react|vite|angular|vue|sql|bash|docker|kubernetes|algoritm|func(ț|t)ie|function|script|cod"]
INTENT_ORDINAL = [r"prim(a|ă)|a\s+doua|a\s+treia|a\s+patra"]
INTENT_PAGES = [r"(c(â|a)te|care este num(ă|a)rul de)\s+pagini", r"pagini\s+are"]
INTENT_AUTHOR = [r"autorul|cine a scris|de cine e scris"]
INTENT_YEAR = [r"anul apari(t|ț)iei|c(â|a)nd a fost publicat(ă|a)?"]
INTENT_THIS_BOOK = [r"aceast(ă|a)\s+carte|cartea\s+asta|despre\s+ea|despre\s+aceast(ă|a)"]

# Offensive words, variant 1: whole-word patterns (``pizd`` followed by any
# word characters).
OFFENSIVE_PATTERNS = [r"cur", r"pula", r"muie", r"pizd[\pL\pN_]*", r"fuck", r"shit", r"asshole", r"cunt"]
# Offensive words, variant 2: a set of tokens; tokens are runs of lower-case
# letters a-z, ă, â, î, ș, ț and hyphens.
OFFENSIVE_WORDS = ["cur", "pula", "dracu", "morții", "mortii", "futu", "bou", "handicapat", "tâmpit", "tampit"]
TOKEN_PATTERN = r"[a-zăâîșț\-]+"

# Ordinal references, tested as substrings of the lower-cased text in this
# order: ("prima" or "primă") -> 1, "a doua" -> 2, "a treia" -> 3, "a patra" -> 4.
ORDINALS = [(["prima", "primă"], 1), (["a doua"], 2), (["a treia"], 3), (["a patra"], 4)]

# Characters stripped from both ends of a title before matching.
TITLE_QUOTES = "\"'”’“`"
# What is cut from the end of a title, one after the other: a parenthesis; all from a
# colon, hyphen or dash on; "de" and what follows it.
TITLE_TAILS = [r"\s*\(.*?\)\s*$", r"\s*[:\-–—]\s*.*$", r"(?i)\s+de\s+.+$"]
# ----------------------------------------------------------------------------

_W = r"[\pL\pN_]"
_B0 = rf"(^|[^\pL\pN_])"
_B1 = rf"($|[^\pL\pN_])"


def _whole_words(alternatives: Sequence[str]) -> str:
    return "|".join(f"{_B0}({a}){_B1}" for a in alternatives)


def spark_pattern(alternatives: Sequence[str]) -> str:
    """Java regex: Unicode case folding and explicit Unicode word boundaries."""
    return "(?iu)(" + _whole_words(alternatives) + ")"


def sql_pattern(alternatives: Sequence[str]) -> str:
    """Same pattern for RE2-based SQL engines (``(?i)`` is Unicode there)."""
    return "(?i)(" + _whole_words(alternatives) + ")"


def _has(x, alternatives: Sequence[str]) -> Column:
    col = F.col(x) if isinstance(x, str) else x
    return F.coalesce(col, F.lit("")).rlike(spark_pattern(alternatives))


def classify_intent(x) -> Column:
    """Ordered intent rules."""
    return (F.when(_has(x, INTENT_CODE), "out_of_scope")
             .when(_has(x, INTENT_ORDINAL), "ordinal")
             .when(_has(x, INTENT_PAGES) | _has(x, INTENT_AUTHOR) | _has(x, INTENT_YEAR)
                   | _has(x, INTENT_THIS_BOOK), "book_followup")
             .otherwise("recommendation"))


def ordinal_ref(x) -> Column:
    """1..4 from the first ordinal phrase found (in rule order), else NULL."""
    s = F.lower(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))
    out = None
    for words, n in ORDINALS:
        cond = None
        for w in words:
            e = F.instr(s, w) > 0
            cond = e if cond is None else cond | e
        out = F.when(cond, F.lit(n)) if out is None else out.when(cond, F.lit(n))
    return out


def is_offensive_regex(x, patterns: Sequence[str] = OFFENSIVE_PATTERNS) -> Column:
    """Any whole-word pattern matches (case-insensitive)."""
    return _has(x, patterns)


def offensive_tokens(x) -> Column:
    """Tokens of P20: runs of ``TOKEN_PATTERN`` in the lower-cased text."""
    s = F.lower(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")))
    return F.regexp_extract_all(s, F.lit(f"({TOKEN_PATTERN})"), 1)


def is_offensive_tokens(x, words: Sequence[str] = OFFENSIVE_WORDS) -> Column:
    """P20: some token is in the word set (small set: array literal).

    For very large word lists use ``explode(offensive_tokens)`` and a semi
    join against a word table instead.
    """
    return F.arrays_overlap(offensive_tokens(x), F.array(*[F.lit(w) for w in words]))


def clean_title(x) -> Column:
    """P16 part 1: strip quotes, drop a trailing parenthesis, anything after
    ``:``/``-``/dashes, and a trailing `` de <author>``."""
    s = strip(F.col(x) if isinstance(x, str) else x)
    q = "".join("\\" + ch if ch in "\"'`" else ch for ch in TITLE_QUOTES)
    s = F.regexp_replace(s, f"^[{q}]+|[{q}]+$", "")
    for tail in TITLE_TAILS:
        s = F.regexp_replace(s, tail, "")
    return s


def norm_text(x) -> Column:
    """P16 part 2: strip, lower case, collapse whitespace."""
    s = F.col(x) if isinstance(x, str) else x
    return F.regexp_replace(F.lower(strip(s)), r"\s+", " ")


def normalize_title(x) -> Column:
    """The comparison key of a title."""
    return norm_text(clean_title(x))
