"""Column expressions for parsing, dates, names and arithmetic.

Everything here returns a ``Column`` built from built-in functions, so it runs
inside whole-stage code generation; no Python runs per row.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace (not only spaces)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


# --- P1, P2 -----------------------------------------------------------------
def duration_seconds(x) -> Column:
    """``1h 59m 6s`` -> seconds.

    Each ``<digits><unit>`` pair sets its unit (the last pair of a unit wins);
    missing units count as 0, so a text without any pair gives 0.
    """
    s = F.coalesce(_c(x), F.lit(""))

    def part(unit: str) -> Column:
        found = F.regexp_extract_all(s, F.lit(rf"(\d+){unit}"), 1)
        return F.coalesce(F.try_element_at(found, F.lit(-1)).try_cast("long"), F.lit(0))

    return part("h") * 3600 + part("m") * 60 + part("s")


def parse_duration(x) -> Column:
    """P1 as an interval (``INTERVAL DAY TO SECOND``)."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), duration_seconds(x).cast("decimal(18,6)"))


def parse_hours(x) -> Column:
    """``3h`` -> 3; anything that is not digits with optional ``h`` -> NULL."""
    s = strip(x)
    return F.when(s.rlike(r"^\d+h*$"), F.regexp_extract(s, r"^(\d+)", 1).try_cast("int"))


# --- P3-P8 ------------------------------------------------------------------
def month_number(x) -> Column:
    """``June`` or ``6`` -> 6 (English month names, any case)."""
    s = strip(x)
    as_int = s.try_cast("int")
    name = F.initcap(s)
    by_name = F.month(F.try_to_timestamp(F.concat(F.lit("2000 "), name, F.lit(" 1")), F.lit("yyyy MMMM d")))
    return F.coalesce(F.when((as_int >= 1) & (as_int <= 12), as_int), by_name)


def parse_ts(x) -> Column:
    """``6/24/25, 1:47:45 PM`` -> timestamp."""
    return F.try_to_timestamp(strip(x), F.lit("M/d/yy, h:mm:ss a"))


def parse_oracle_date(x) -> Column:
    """P5: ``17-JUN-13`` -> date (month abbreviation in any case)."""
    s = strip(x)
    fixed = F.concat(F.substring_index(s, "-", 1), F.lit("-"),
                     F.initcap(F.substring_index(F.substring_index(s, "-", 2), "-", -1)), F.lit("-"),
                     F.substring_index(s, "-", -1))
    return F.to_date(F.try_to_timestamp(fixed, F.lit("dd-MMM-yy")))


def make_day(y, m, d) -> Column:
    """Date from three numbers (invalid combinations -> NULL)."""
    return F.try_make_timestamp_ntz(_c(y), _c(m), _c(d), F.lit(0), F.lit(0), F.lit(0)).cast("date")


def elapsed(start, end) -> Column:
    """Interval ``end - start``."""
    return _c(end) - _c(start)


def oracle_day_label(x) -> Column:
    """``DD-MON-YY`` upper case."""
    return F.upper(F.date_format(_c(x), "dd-MMM-yy"))


def clock_label(x) -> Column:
    """``HH24:MI:SS``."""
    return F.date_format(_c(x), "HH:mm:ss")


# --- P9-P15 -----------------------------------------------------------------
def full_name(first, last) -> Column:
    """First + ' ' + last; NULL parts are skipped (Oracle ``||`` semantics, G3)."""
    return F.concat_ws(" ", _c(first), _c(last))


def default_zero(x) -> Column:
    """P10: NVL(x, 0)."""
    return F.coalesce(_c(x), F.lit(0))


def safe_divide(a, b) -> Column:
    """Division that yields NULL instead of failing on a zero divisor."""
    return F.try_divide(_c(a), _c(b))


def divide_error(b) -> Column:
    """The error label of ``safe_divide`` (one error row per failing input)."""
    return F.when(_c(b) == 0, F.lit("ZERO_DIVIDE"))


def normalize_code(x) -> Column:
    """Trimmed code (G1: blank-padded CHAR values)."""
    return strip(x)


def split_qualified_name(x) -> tuple[Column, Column]:
    """``PACKAGE.MODULE`` -> (package, module) around the first dot."""
    s = _c(x)
    has_dot = F.instr(s, ".") > 0
    rest = F.substr(s, F.instr(s, ".") + 1)
    return F.when(has_dot, F.substring_index(s, ".", 1)), F.when(has_dot, rest).otherwise(s)


# The four labels of a log source.
LABEL_STORED = "Stored {kind}: {unit}"
LABEL_FUNCTION = "[Package] --> {module}    [Function] --> {name}"
LABEL_PROCEDURE = "[Package] --> {module}    [PROCEDURE] --> {name}"
LABEL_NONE = "No package; No procedure; No function. Check anonymous PL/SQL blocks."


def fill_template(template: str, **values) -> Column:
    """The template with each ``{name}`` replaced by a column; null if one of them is."""
    parts = [F.lit(x) if i % 2 == 0 else _c(values[x]) for i, x in enumerate(re.split(r"\{(\w+)\}", template))]
    return F.concat(*parts)


def module_label(unit, module, kind) -> Column:
    """Label of a log source: its unit (``PACKAGE.NAME``, or a stored program's own name), its module, and
    the kind of object the unit is (null for an anonymous block)."""
    u, m, k = _c(unit), _c(module), _c(kind)
    name = F.substr(u, F.instr(u, ".") + 1)
    return (F.when(F.upper(u) == F.upper(m), fill_template(LABEL_STORED, kind=F.coalesce(k, F.lit("")), unit=u))
             .when(F.upper(k) == "FUNCTION", fill_template(LABEL_FUNCTION, module=F.coalesce(m, F.lit("")), name=name))
             .when(F.upper(k) == "PROCEDURE", fill_template(LABEL_PROCEDURE, module=F.coalesce(m, F.lit("")), name=name))
             .otherwise(F.lit(LABEL_NONE)))


# --- P21-P30 ----------------------------------------------------------------
def word_count(x) -> Column:
    """Number of whitespace-separated words (Python ``len(s.split())``)."""
    return F.size(F.filter(F.split(F.coalesce(_c(x), F.lit("")), r"\s+"), lambda w: w != ""))


def estimate_tokens(x, factor: float = 1.3) -> Column:
    """int(words * 1.3); empty text -> 0."""
    return F.floor(word_count(x) * F.lit(factor)).cast("long")


def usage_cost(df: DataFrame, prices: DataFrame, model: str, tokens_in: str, tokens_out: str,
               out: str = "usd_cost") -> DataFrame:
    """in/1000 * price_in + out/1000 * price_out, unknown model -> 0, 6 decimals.

    ``prices`` is the price list ``model, price_in, price_out`` per 1000 tokens.
    Arithmetic is decimal so costs are exact.
    """
    p = prices.select(F.col("model").alias("_pm"),
                      (F.col("price_in").cast("decimal(12,8)") / 1000).cast("decimal(16,12)").alias("_pin"),
                      (F.col("price_out").cast("decimal(12,8)") / 1000).cast("decimal(16,12)").alias("_pout"))
    j = df.join(p, F.lower(F.col(model)) == F.lower(F.col("_pm")), "left")
    cost = (F.col(tokens_in).cast("decimal(18,0)") * F.coalesce(F.col("_pin"), F.lit(0).cast("decimal(16,12)"))
            + F.col(tokens_out).cast("decimal(18,0)") * F.coalesce(F.col("_pout"), F.lit(0).cast("decimal(16,12)")))
    return j.withColumn(out, F.round(cost, 6).cast("decimal(18,6)")).drop("_pm", "_pin", "_pout")


def embedding_cost(tokens: str, price: str) -> Column:
    """tokens/1000 * price of an embedding model, 6 decimals, exact."""
    a_token = (F.lit(price).cast("decimal(12,8)") / 1000).cast("decimal(16,12)")
    return F.round(F.col(tokens).cast("decimal(18,0)") * a_token, 6).cast("decimal(18,6)")


def split_list(x, sep: str = ",") -> Column:
    """Split, strip, drop empty items."""
    return F.filter(F.transform(F.split(_c(x), sep), lambda t: strip(t)), lambda t: t != "")


def render_document(title, themes, summary) -> Column:
    """``Title/Themes/Summary`` text."""
    return F.concat(F.lit("Title: "), _c(title), F.lit("\nThemes: "), F.array_join(_c(themes), ", "),
                    F.lit("\nSummary: "), _c(summary))


def document_id(title) -> Column:
    """``book_<title>``."""
    return F.concat(F.lit("book_"), _c(title))


def preview(x, n: int = 200) -> Column:
    """P25: first n characters."""
    return F.substring(_c(x), 1, n)


def in_list(x, values: Sequence) -> Column:
    """``IN (...)`` with bound values."""
    return _c(x).isin(list(values))


def between_dates(x, start, end) -> Column:
    """Inclusive period."""
    return _c(x).between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def map_constant(x, mapping: Mapping) -> Column:
    """Literal lookup table (``create_map``); missing keys -> NULL."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*items), _c(x))


def lookup_many(df: DataFrame, cols: Sequence[str], identifiers: DataFrame, ident_col: str, row_key: Sequence[str]) -> DataFrame:
    """P30 for many identifiers: one equi join per column instead of an OR join,
    then one row per (identifier, matched row)."""
    parts = [identifiers.select(F.col(ident_col).alias("identifier")).join(
        df, F.col("identifier") == df[c]) for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["identifier", *row_key])


def literal_rows(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Seed a table from literal rows."""
    return spark.createDataFrame(list(rows), schema)


def lookup_any(df: DataFrame, cols: Sequence[str], value: str) -> DataFrame:
    """Rows where any of ``cols`` equals the identifier."""
    cond = None
    for c in cols:
        e = F.col(c) == F.lit(value)
        cond = e if cond is None else cond | e
    return df.where(cond)
