"""Batch sinks: usage logs, submissions, report text, appended rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_usage_log(df: DataFrame, path: str, dt_col: str = "dt") -> None:
    """JSON lines appended in one folder per day (``dt=...``)."""
    df.write.mode("append").partitionBy(dt_col).json(path)


def write_submission(df: DataFrame, path: str, id_col: str, prob_col: str, classes: Sequence[str]) -> None:
    """Id + one probability column per class, CSV with header."""
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(F.col(prob_col)) if dict(df.dtypes)[prob_col] == "vector" else F.col(prob_col)
    out = df.select(id_col, *[arr[i].alias(c) for i, c in enumerate(classes)])
    out.write.mode("overwrite").option("header", True).csv(path)


def report_lines(df: DataFrame, key: Sequence[str], parts: Sequence[Column]) -> DataFrame:
    """Report rows -> ordered text lines (``key..., line_no, line``).

    Each part is an ``array<string>`` column: ``F.array(text)`` for one line,
    a list column for bullet lists.  NULL items (optional lines whose value is
    not > 0) are dropped; line numbers follow ``parts`` order.
    """
    flat = F.filter(F.flatten(F.array(*parts)), lambda x: x.isNotNull())
    ex = df.select(*key, F.posexplode(flat).alias("pos", "line"))
    return ex.select(*key, (F.col("pos") + 1).alias("line_no"), "line")


def optional_line(label: str, value: Column, fmt: str = "%s") -> Column:
    """A report line that exists only when ``value > 0``."""
    return F.when(value > 0, F.format_string(f"{label}{fmt}", value))


def padded(cols: Sequence[tuple[Column, int]]) -> Column:
    """Fixed-width columns (right-padded)."""
    return F.concat(*[F.rpad(c.cast("string"), w, " ") for c, w in cols])


#: The folder level that tells which run or micro-batch wrote a row.
BATCH = "batch_no"


def append_once(df: DataFrame, path: str, batch_no: int) -> None:
    """S9/S12, repeatable: the rows of one batch replace those that an earlier try of the same batch wrote.

    The batch number is the first folder level, and only the folders of this
    batch are overwritten; a replayed batch so adds nothing.
    """
    numbered = df.withColumn(BATCH, F.lit(int(batch_no)).cast("long"))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append one row per event (question log etc.)."""
    df.write.mode("append").parquet(path)
