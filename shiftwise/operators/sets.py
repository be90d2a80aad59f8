"""Set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_reasons(*frames: DataFrame) -> DataFrame:
    """Concatenate reason rows of several sources by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def new_codes(raw: DataFrame, existing: DataFrame, code: str) -> DataFrame:
    """Rows whose code is not stored yet (compares the code only)."""
    return raw.join(existing.select(code), code, "left_anti")


def priority_union(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Keys of the first frame, then keys of later frames not seen before.

    Each frame gets its priority as a column; one ``min_by`` per key keeps the
    row of the highest-priority source (map-side combined, no window).
    """
    tagged = [f.withColumn("_sw_prio", F.lit(i)) for i, f in enumerate(frames)]
    allrows = tagged[0]
    for t in tagged[1:]:
        allrows = allrows.unionByName(t)
    rest = [c for c in frames[0].columns if c not in key]
    best = allrows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col("_sw_prio")).alias("_sw_row"))
    return best.select(*key, *[F.col("_sw_row")[c].alias(c) for c in rest])


def distinct_set(arr: Column) -> Column:
    """U4: de-duplicate a submitted list (first occurrence order kept)."""
    return F.array_distinct(arr)
