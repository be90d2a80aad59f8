"""Markdown sections and JSON maps as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftwise.functions.scalars import split_list, strip

HEADING = r"(?m)^##\s*Title:\s*"


def split_sections(df: DataFrame, text_col: str, heading_regex: str = HEADING) -> DataFrame:
    """S3: one row per ``## Title:`` section of each text.

    title = first line of the block; summary = the following lines up to a
    line starting with ``Teme:`` (case-insensitive), each stripped and joined
    by one space; themes = the comma list of that line, stripped, empties
    dropped.  Text before the first heading is ignored.  Runs per row, so a
    file is one task and many files scale out.
    """
    blocks = F.slice(F.split(F.col(text_col), heading_regex), 2, 1 << 30)
    exploded = df.select(*[c for c in df.columns if c != text_col],
                         F.posexplode(blocks).alias("_pos", "_blk"))
    nl = F.instr("_blk", "\n")
    title = strip(F.when(nl > 0, F.substring_index("_blk", "\n", 1)).otherwise(F.col("_blk")))
    rest = F.when(nl > 0, F.substr(F.col("_blk"), nl + 1)).otherwise(F.lit(""))
    lines = F.split(strip(rest), r"\r\n|\r|\n")
    idx = F.array_position(F.transform(lines, lambda x: F.startswith(F.lower(strip(x)), F.lit("teme:"))), True)
    body = F.when(idx > 0, F.slice(lines, 1, (idx - 1).cast("int"))).otherwise(lines)
    summary = strip(F.array_join(F.transform(body, lambda x: strip(x)), " "))
    theme_line = F.when(idx > 0, F.element_at(lines, idx.cast("int")))
    themes = F.coalesce(split_list(F.substr(theme_line, F.instr(theme_line, ":") + 1)),
                        F.array().cast("array<string>"))
    out = (exploded
           .select(*[c for c in df.columns if c != text_col],
                   (F.col("_pos") + 1).alias("section_no"), title.alias("title"),
                   summary.alias("summary"), themes.alias("themes")))
    return out


def whole_sections(df: DataFrame, text_col: str, heading_regex: str = HEADING) -> DataFrame:
    """S3 variant: title + the whole stripped body (lines joined by newlines)."""
    blocks = F.split(F.col(text_col), heading_regex)
    ex = df.select(F.posexplode(blocks).alias("_pos", "_blk")).where(strip("_blk") != "")
    b = strip("_blk")
    title = strip(F.substring_index(b, "\n", 1))
    body = strip(F.when(F.instr(b, "\n") > 0, F.substr(b, F.instr(b, "\n") + 1)).otherwise(F.lit("")))
    return ex.select(title.alias("title"), body.alias("summary")).where(F.col("title") != "")


def read_json_map(spark: SparkSession, path: str, value_type: T.DataType) -> DataFrame:
    """A JSON object ``{key: value}`` per file -> one row per key.

    ``wholetext`` makes each file one row; ``from_json`` with a map type
    parses it and ``explode`` turns entries into rows.  One task per file.
    """
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", T.MapType(T.StringType(), value_type)).alias("m"))
    return parsed.select(F.explode("m").alias("key", "value"))
