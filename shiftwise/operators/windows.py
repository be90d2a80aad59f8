"""Ranking, surrogate keys and per-group windows.

Global orderings (``RANK() OVER (ORDER BY ...)`` with no partition, dense
surrogate ids) would run in a single task if written as a plain window.  Here
they are computed the way ``zipWithIndex`` works:

1. range-partition by the ordering, so partitions are ordered and equal keys
   never straddle two partitions, then sort inside each partition;
2. rank locally inside every partition (Arrow batches, one pass, no buffering
   of the partition);
3. add the number of rows (or distinct keys) of all earlier partitions, taken
   from a per-partition count table that has one row per partition and is
   therefore safe to broadcast.

Range bounds come from sampling, and the rows of a shuffle partition arrive in
no fixed order, so two evaluations of the same range shuffle may draw
different bounds.  The range-partitioned frame is therefore checkpointed
(reliable storage under ``spark.checkpoint.dir``) and both the local ranks and
the per-partition counts read that single materialized copy; the checkpoint
also cuts the lineage, so a lost executor does not replay the upstream plan.

Per-group top-k uses ``row_number() <= k``; Spark inserts a partial
``WindowGroupLimit`` below the shuffle, so each map task ships at most k rows
per group and a hot group never reaches one task whole.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftwise.session import checkpoint_dir

_PID = "_sw_pid"
_LOCAL = "_sw_local"


def _sort_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _key_names(df: DataFrame, order: Sequence) -> list[str]:
    """Column names referenced by the order expressions (plain columns only)."""
    names = []
    for c in order:
        if isinstance(c, str):
            names.append(c)
        else:
            # Column sort expressions such as F.col("x").desc_nulls_first():
            # their textual form starts with the column name.
            text = str(c)
            inner = text[text.index("'") + 1:text.rindex("'")] if "'" in text else text
            inner = inner.split(" ")[0].strip("`")
            names.append(inner)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"order columns must be plain columns of the frame: {missing}")
    return names


def _leaves(col: Column, kind: T.DataType) -> list[Column]:
    """A key as columns that pandas can compare: a struct as its fields, arrays as their JSON text."""
    if isinstance(kind, T.StructType):
        inner = [c for f in kind.fields for c in _leaves(col[f.name], f.dataType)]
        return [col.isNull(), *inner]
    return [F.to_json(col) if isinstance(kind, T.ArrayType) else col]


def _changed(pdf: pd.DataFrame, keys: list[str], prev: tuple | None) -> np.ndarray:
    """True where the key tuple differs from the previous row (NULL == NULL)."""
    n = len(pdf)
    out = np.zeros(n, dtype=bool)
    out[0] = prev is None
    for i, k in enumerate(keys):
        s = pdf[k]
        empty = s.isna().to_numpy(dtype=bool)
        values = s.to_numpy()
        out[1:] |= (values[1:] != values[:-1]) & ~(empty[1:] & empty[:-1])
        if prev is not None:
            out[0] |= not (empty[0] and pd.isna(prev[i])) and bool(values[0] != prev[i])
    return out


def _local_ranker(keys: list[str], method: str, out_schema_names: list[str]):
    def run(batches):
        seen = 0          # rows of this partition already emitted
        distinct = 0      # distinct keys already emitted
        last_rank = 0
        prev = None
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            pos = np.arange(seen + 1, seen + n + 1, dtype=np.int64)
            seen += n
            if method == "row_number":  # needs no comparison
                yield pdf.assign(**{_LOCAL: pos})[out_schema_names]
                continue
            ch = _changed(pdf, keys, prev)
            if method == "dense_rank":
                local = np.cumsum(ch).astype(np.int64) + distinct
            else:  # rank
                start = np.where(ch, pos, 0)
                start = np.maximum.accumulate(start)
                local = np.where(start == 0, last_rank, start).astype(np.int64)
            distinct += int(ch.sum())
            last_rank = int(local[-1])
            prev = tuple(pdf[k].iloc[-1] for k in keys)
            yield pdf.assign(**{_LOCAL: local})[out_schema_names]
    return run


def global_rank(df: DataFrame, order: Sequence, method: str = "rank", out: str = "rank",
                offset: Column | int = 0, num_partitions: int | None = None) -> DataFrame:
    """Exact global ``rank``/``dense_rank``/``row_number`` without a single-task window.

    ``order`` holds column names or sort expressions on plain columns.  For
    ``row_number`` the order must be total (end it with a unique key) to be
    repeatable.  ``offset`` is added to every value (surrogate keys after the
    current maximum, W2/A7) and may be a literal or a one-row scalar column.
    """
    if method not in ("rank", "dense_rank", "row_number"):
        raise ValueError(method)
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_exprs = [_sort_col(c) for c in order]
    keys = _key_names(df, order)
    checkpoint_dir(spark)
    leaves = [c for k in keys for c in _leaves(F.col(k), df.schema[k].dataType)] if method != "row_number" else []
    compared = [f"_sw_key{i}" for i in range(len(leaves))]
    df_columns = df.columns
    df = df.select("*", *(c.alias(n) for c, n in zip(leaves, compared, strict=True)))
    part = (df.repartitionByRange(n, *sort_exprs)
              .sortWithinPartitions(*sort_exprs)
              .withColumn(_PID, F.spark_partition_id())
              .checkpoint(eager=True))
    out_fields = part.schema.fields + [T.StructField(_LOCAL, T.LongType(), False)]
    schema = T.StructType(out_fields)
    local = part.mapInPandas(_local_ranker(compared, method, [f.name for f in out_fields]), schema)
    # One row per partition: rows before it, distinct keys before it.
    per_part = part.groupBy(_PID).agg(
        F.count(F.lit(1)).alias("_sw_rows"),
        F.count_distinct(F.struct(*keys)).alias("_sw_keys"))
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    measure = "_sw_keys" if method == "dense_rank" else "_sw_rows"
    offsets = per_part.select(
        _PID, F.coalesce(F.sum(measure).over(before), F.lit(0)).cast("long").alias("_sw_off"))
    res = local.join(F.broadcast(offsets), _PID, "left")
    value = F.col(_LOCAL) + F.coalesce(F.col("_sw_off"), F.lit(0))
    if isinstance(offset, int):
        value = value + F.lit(offset)
    else:
        value = value + offset
    return res.withColumn(out, value.cast("long")).select(*(c for c in df_columns if c != out), out)


def assign_keys(df: DataFrame, order: Sequence, key_col: str, start_after: Column | int = 0) -> DataFrame:
    """Dense surrogate ids ``start_after + 1, +2, ...`` in a stable order."""
    return global_rank(df, order, "row_number", key_col, offset=start_after)


def next_key(existing: DataFrame, pk: str, base: int = 0) -> DataFrame:
    """One-row frame with ``COALESCE(MAX(pk), base)`` as ``next_base``.

    Use as ``assign_keys(..., start_after=next_key(df, pk).scalar())``: a
    scalar subquery, evaluated once.
    """
    return existing.agg(F.coalesce(F.max(pk).cast("long"), F.lit(base).cast("long")).alias("next_base"))


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence, k: int,
                    rank_col: str | None = None) -> DataFrame:
    """First ``k`` rows per group in ``order`` (ties broken by the order itself).

    ``row_number() <= k`` lets Spark add a map-side ``WindowGroupLimit``.
    """
    w = Window.partitionBy(*group).orderBy(*[_sort_col(c) for c in order])
    rn = rank_col or "_sw_rn"
    res = df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= k)
    return res if rank_col else res.drop(rn)


def running_before(df: DataFrame, partition: Sequence[str], order: Sequence, value: str,
                   out: str) -> DataFrame:
    """Sum of ``value`` over earlier rows of the same partition (0 for the first)."""
    w = (Window.partitionBy(*partition).orderBy(*[_sort_col(c) for c in order])
         .rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def pick_nth(arr: Column, n: Column) -> Column:
    """N-th element (1-based) only when 1 <= n <= size, else NULL."""
    return F.when((n >= 1) & (n <= F.size(arr)), F.try_element_at(arr, n.cast("int")))


def first_or_fallback(selected: Column, arr: Column) -> Column:
    """The selected value, else the first list element."""
    return F.coalesce(selected, F.try_element_at(arr, F.lit(1)))


def ordered_limit(df: DataFrame, order: Sequence, k: int) -> DataFrame:
    """ORDER BY ... then the first k rows (planned as TakeOrderedAndProject)."""
    return df.orderBy(*[_sort_col(c) for c in order]).limit(k)
