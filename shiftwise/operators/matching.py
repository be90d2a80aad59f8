"""Title matching and mention joins.

Both are "first key in key order that satisfies a containment" problems; the
same plan answers for any number of keys and texts, and no candidate is dropped:

* a text inside a key: the keys are indexed by all their grams (substrings of up
  to three characters); a text looks up its rarest gram (itself, if it is no
  longer than a gram), and ``instr`` verifies;
* a key inside a text: automata over shards of the keys, see ``automata``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwise.functions.text import TOKEN_PATTERN, normalize_title
from shiftwise.operators.automata import first_key_in

GRAM = 3


def _grams(text: Column, sizes) -> Column:
    """The different substrings of the given sizes."""
    n = F.length(text)

    def of(size: int) -> Column:
        starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))

    return F.array_distinct(F.concat(*map(of, sizes)))


def _first_key(pairs: DataFrame, id_col: str, out: str) -> DataFrame:
    return pairs.groupBy(id_col).agg(F.min_by("_key", "_pos").alias(out))


def match_title(queries: DataFrame, id_col: str, title_col: str, keys: DataFrame, key_col: str,
                pos_col: str, out: str = "matched_title") -> DataFrame:
    """Exact normalized match first, else the first key containing the text.

    ``pos_col`` is the key order.  Empty or NULL titles match nothing; the
    containment phase needs a non-empty normalized text.  Each different
    normalized text is looked up once.
    """
    k = keys.select(F.col(key_col).alias("_key"), F.col(pos_col).alias("_pos"),
                    normalize_title(key_col).alias("_kn"))
    raw = F.col(title_col)
    q = queries.withColumn("_qn", F.when(raw.isNotNull() & (raw != ""), normalize_title(raw)))
    texts = q.select("_qn").where(F.col("_qn").isNotNull()).distinct()
    exact = _first_key(texts.join(k, texts["_qn"] == k["_kn"]), "_qn", "_exact")
    rest = texts.join(exact, "_qn", "left_anti").where(F.col("_qn") != "")
    index = k.select("_key", "_pos", "_kn", F.explode(_grams(F.col("_kn"), range(1, GRAM + 1))).alias("_gram"))
    often = index.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    own = F.when(F.length("_qn") <= GRAM, F.array("_qn")).otherwise(_grams(F.col("_qn"), [GRAM]))
    # a text with a gram that no key has is in no key; its other grams only cost a look
    rarest = rest.select("_qn", F.explode(own).alias("_gram")).join(often, "_gram").groupBy("_qn").agg(
        F.min(F.struct("_n", "_gram"))["_gram"].alias("_gram"))
    contains = _first_key(rarest.join(index, "_gram").where(F.instr(F.col("_kn"), F.col("_qn")) > 0), "_qn", "_contains")
    return (q.join(exact, "_qn", "left").join(contains, "_qn", "left")
            .withColumn(out, F.coalesce("_exact", "_contains")).select(*queries.columns, out))


def mention_join(texts: DataFrame, id_col: str, text_col: str, keys: DataFrame, key_col: str,
                 pos_col: str, out: str = "mentioned_title") -> DataFrame:
    """The first key (in key order) mentioned in the text, case-insensitive.

    An empty key is mentioned in every text, a NULL text mentions none.
    """
    k = keys.select(F.col(key_col).alias("_key"), F.col(pos_col).cast("long").alias("_pos"), F.lower(F.col(key_col)).alias("_kl"))
    found = first_key_in(texts.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col)).alias("_tl")), k)
    named = found.join(k.groupBy("_pos").agg(F.min("_key").alias(out)), "_pos")
    return texts.join(named.select(F.col("_id").alias(id_col), out), id_col, "left")


def offensive_by_list(texts: DataFrame, id_col: str, text_col: str, words: DataFrame, word_col: str, out: str = "offensive") -> DataFrame:
    """P20 for a word list of any size: ``texts`` with whether a token (as in ``is_offensive_tokens``) is in ``words``.

    The different tokens of each text are joined with the list by value; a text
    moves by its id alone.  NULL texts have no tokens.
    """
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"({TOKEN_PATTERN})"), 1))
    listed = words.select(F.lower(F.col(word_col)).alias("_w")).where(F.col("_w").isNotNull())
    found = texts.select(F.col(id_col).alias("_id"), F.explode(tokens).alias("_w")).join(listed, "_w", "left_semi")
    found = found.select("_id", F.lit(True).alias("_found")).distinct()
    return texts.join(found, F.col(id_col).eqNullSafe(F.col("_id")), "left").withColumn(out, F.col("_found").isNotNull()).drop("_id", "_found")


def shortlist(hits: DataFrame, query_col: str, title_col: str, rank_col: str, allow: DataFrame,
              allow_col: str, k: int = 5, out: str = "shortlist") -> DataFrame:
    """Ranked hits -> distinct allowed titles in rank order (at most k per query).

    ``min(rank)`` per (query, title) de-duplicates, a semi join keeps allowed
    titles, and the list is the k best ranks (``WindowGroupLimit`` applies).
    """
    best = (hits.where(F.col(title_col).isNotNull() & (F.trim(F.col(title_col)) != ""))
            .groupBy(query_col, title_col).agg(F.min(rank_col).alias("_r")))
    allowed = best.join(allow.select(F.col(allow_col).alias(title_col)), title_col, "left_semi")
    from pyspark.sql import Window
    w = Window.partitionBy(query_col).orderBy("_r", title_col)
    top = allowed.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return top.groupBy(query_col).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", title_col))), lambda s: s[title_col]).alias(out))
