"""Join operators.

Policy for join strategies: equi joins are declared plainly and Catalyst/AQE
pick broadcast-hash vs sort-merge from statistics (the size check is
``spark.sql.autoBroadcastJoinThreshold`` and AQE's runtime sizes).  An explicit
``broadcast`` hint is only given to inputs with a proven bound: one-row
scalars, literal lists and tables with a row for each partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def star_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, str | Sequence[str] | Column]],
              how: str = "inner") -> DataFrame:
    """Fact joined to each dimension on its key (strategy left to Catalyst)."""
    return reduce(lambda acc, d: acc.join(d[0], d[1], how), dims, fact)


def join_using(a: DataFrame, b: DataFrame, key: str | Sequence[str], how: str = "inner") -> DataFrame:
    """``JOIN ... USING(key)`` - a single copy of the key column."""
    return a.join(b, on=key if isinstance(key, (list, tuple)) else [key], how=how)


def left_join_filtered(left: DataFrame, right: DataFrame, on, right_filter: Column) -> DataFrame:
    """LEFT JOIN whose extra predicate sits in ON: filter the right side first.

    The filter reaches the right scan (pushed down) and unmatched left rows
    survive with NULLs.
    """
    return left.join(right.where(right_filter), on, "left")


def resolve_keys(fact: DataFrame, lookups: Sequence[tuple[DataFrame, list[str], str]],
                 reason_col: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """Natural keys -> surrogate ids through several lookups.

    ``lookups`` holds ``(dim, natural_key_columns, id_column)``; every dim must
    be unique on its natural key (``dedup_last`` makes it so).  Returns
    ``(resolved, rejected)``; rejected rows carry the name of the first lookup
    that failed.  One left join per lookup, then a split on NULL ids, so the
    input is read once.
    """
    cur = fact
    for dim, keys, id_col in lookups:
        cur = cur.join(dim.select(*keys, id_col), keys, "left")
    reason = F.lit(None).cast("string")
    for dim, keys, id_col in reversed(lookups):
        reason = F.when(F.col(id_col).isNull(), F.lit(f"no {id_col}")).otherwise(reason)
    cur = cur.withColumn(reason_col, reason)
    resolved = cur.where(F.col(reason_col).isNull()).drop(reason_col)
    rejected = cur.where(F.col(reason_col).isNotNull())
    return resolved, rejected


def dedup_last(df: DataFrame, key: Sequence[str], order: str | Column, value_cols: Sequence[str]) -> DataFrame:
    """One row per key, the row with the largest ``order`` wins (``max_by``).

    A plain aggregate: partial ``max_by`` on the map side, so a hot key never
    gathers its rows in one task.
    """
    ordc = F.col(order) if isinstance(order, str) else order
    best = df.groupBy(*key).agg(F.max_by(F.struct(*value_cols), ordc).alias("_sw_row"))
    return best.select(*key, *[F.col("_sw_row")[c].alias(c) for c in value_cols])


def left_lookup(df: DataFrame, lookup: DataFrame, key: Sequence[str], order: str | Column,
                value_cols: Sequence[str]) -> DataFrame:
    """Optional attribute by key, NULL if missing, last row (by ``order``) wins."""
    return df.join(dedup_last(lookup, key, order, value_cols), list(key), "left")


def _null_safe_cond(a: DataFrame, b: DataFrame, key: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in key])


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key: the row with the smallest ``order`` tuple.

    ``order`` holds column names or expressions, compared ascending as one
    struct (append a unique column to make the choice total).  Written as a
    ``min_by`` aggregate, which Spark combines map-side, so a key holding a
    third of all rows is reduced in every task before the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.select(*key).distinct()
    ordkey = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), ordkey).alias("_sw_row"))
    return picked.select(*key, *[F.col("_sw_row")[c].alias(c) for c in rest]).select(*df.columns)


def insert_new(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence,
               nulls_equal: bool = True) -> DataFrame:
    """Incoming rows whose natural key is not stored yet, first per key.

    ``order`` decides which duplicate of the batch is kept.  NULL keys compare
    equal (as Python tuples do) when ``nulls_equal``; the anti join is then
    NULL-safe (``<=>``).
    """
    first = first_per_key(incoming, key, order)
    ex = existing.select(*key).distinct()
    if nulls_equal:
        return first.join(ex, _null_safe_cond(first, ex, key), "left_anti")
    return first.join(ex, list(key), "left_anti")


def calendar_rows(df: DataFrame, start, end, day_col: str = "work_date") -> DataFrame:
    """Every row repeated for each day of ``[start, end]`` (weekends included).

    Generated with ``explode(sequence(...))`` inside each task: no join, the
    day count is fixed by the period.
    """
    seq = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("INTERVAL 1 DAY"))
    return df.withColumn(day_col, F.explode(seq))


def semi_filter(df: DataFrame, allow: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keep rows whose key is in ``allow``."""
    return df.join(allow, on=key if isinstance(key, (list, tuple)) else [key], how="left_semi")


def anti_filter(df: DataFrame, deny: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return df.join(deny, on=key if isinstance(key, (list, tuple)) else [key], how="left_anti")


def missed_with_reason(expected: DataFrame, attended: DataFrame, reasons: DataFrame,
                       key: str) -> DataFrame:
    """Expected members not in the attended set that have at least one reason.

    ``left_anti`` + ``left_semi``: both are shuffled/broadcast by Catalyst.
    """
    missed = expected.join(attended.select(key), key, "left_anti")
    return missed.join(reasons.select(key), key, "left_semi")


def multi_hop(df: DataFrame, hops: Sequence[tuple[DataFrame, str | Sequence[str]]]) -> DataFrame:
    """Chained lookups (employee -> employment -> program -> hours)."""
    return reduce(lambda acc, h: acc.join(h[0], h[1], "left"), hops, df)
