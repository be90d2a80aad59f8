"""Aggregations.

All of them are hash aggregates with a partial (map-side) phase, so a key that
holds a third of the rows is combined inside every task before the shuffle.
Lists (A8) are only collected over bounded domains (codes, reasons, session
names of a period) and are sorted so their order is repeatable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def exact_sum(c: str | Column, scale_type: str = MONEY) -> Column:
    """Sum in fixed-point decimal: exact and independent of summation order."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col.cast(scale_type))


def hours_by_key(df: DataFrame, key: Sequence[str], value: str, where: Column | None = None,
                 out: str = "total_hours") -> DataFrame:
    """A1: SUM(value) per key with an optional type filter (pushed to the scan)."""
    src = df.where(where) if where is not None else df
    return src.groupBy(*key).agg(exact_sum(value).alias(out))


def bucketed_sums(df: DataFrame, key: Sequence[str], value: str,
                  buckets: dict[str, Column]) -> DataFrame:
    """A5: several conditional sums in one pass (``sum(when(cond, v))`` per bucket)."""
    aggs = [F.coalesce(exact_sum(F.when(cond, F.col(value))), F.lit(0).cast(MONEY)).alias(name)
            for name, cond in buckets.items()]
    return df.groupBy(*key).agg(*aggs)


def people_by_code(df: DataFrame, code: str, person: str, out: str = "people") -> DataFrame:
    """A3: COUNT(DISTINCT person) per code, NULL codes dropped (G1: trim first)."""
    return (df.where(F.col(code).isNotNull())
              .groupBy(code).agg(F.count_distinct(person).cast("long").alias(out)))


def people_sketches(df: DataFrame, code: str, day: str, person: str, lg_size: int = 12) -> DataFrame:
    """A3 at scale: a HyperLogLog sketch of the people of each code and day (2**lg_size registers, some KB).

    Sketches are built map-side and merge, so any period is answered from the
    stored sketches without the facts.  The standard error is 1.04 / sqrt(2**lg_size): 1.6 % at 12.
    """
    return df.where(F.col(code).isNotNull()).groupBy(code, day).agg(F.hll_sketch_agg(person, lg_size).alias("sketch"))


def people_of_period(sketches: DataFrame, code: str, period: Column | None = None, out: str = "people") -> DataFrame:
    """People per code over the days that ``period`` selects, from their sketches."""
    rows = sketches if period is None else sketches.where(period)
    return rows.groupBy(code).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(out))


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """SELECT DISTINCT cols WHERE all cols are NOT NULL."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return df.select(*cols).where(cond).distinct()


def collect_sorted(values: Column, sep: str = "; ") -> Column:
    """Stable text form of a bounded set of values (sorted, de-duplicated)."""
    return F.array_join(F.sort_array(F.collect_set(values)), sep)


def log_loss(df: DataFrame, prob_true: str | Column, eps: float = 1e-15, out: str = "log_loss") -> DataFrame:
    """Mean of -ln(p[true]) with p clipped to [eps, 1 - eps]."""
    p = F.col(prob_true) if isinstance(prob_true, str) else prob_true
    clipped = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return df.agg(F.avg(-F.ln(clipped)).alias(out))


def row_count(df: DataFrame, out: str = "n") -> DataFrame:
    """A10: number of rows of a collection."""
    return df.agg(F.count(F.lit(1)).alias(out))
