"""Constraints and timesheet rules as batch validators (Q1-Q11).

Spark does not enforce keys or CHECK constraints, so every constraint is a
job that counts (or returns) the violating rows.  Checks on one table are
evaluated in one pass (conditional sums); key checks are aggregates with
map-side combine; foreign keys are anti joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _one(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("check_name"), value.cast("long").alias("violations"))


def check_primary_key(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """Q1: number of duplicated key values plus rows with a NULL key part."""
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    bad = F.when(any_null, F.col("_n")).when(F.col("_n") > 1, F.lit(1)).otherwise(F.lit(0))
    return per_key.agg(F.coalesce(F.sum(bad), F.lit(0)).cast("long").alias("violations")).select(
        F.lit(name).alias("check_name"), "violations")


def check_foreign_key(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str,
                      name: str) -> DataFrame:
    """Q2: child rows whose non-NULL key has no parent row."""
    orphans = (child.where(F.col(child_key).isNotNull()).select(child_key)
               .join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti"))
    return orphans.agg(F.count(F.lit(1)).cast("long").alias("violations")).select(
        F.lit(name).alias("check_name"), "violations")


def row_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Q3-Q5: several per-row predicates (True = violation) counted in one pass.

    Returns one row per check; the aggregate is a single scan of ``df``.
    """
    agg = df.agg(*[F.sum(F.when(cond, 1).otherwise(0)).alias(f"_c{i}") for i, cond in enumerate(checks.values())])
    rows = F.array(*[_one(n, F.coalesce(F.col(f"_c{i}"), F.lit(0))) for i, n in enumerate(checks)])
    return agg.select(F.explode(rows).alias("r")).select("r.check_name", "r.violations")


def check_table(df: DataFrame, key: tuple[str, Sequence[str]] | None = None, checks: dict[str, Column] | None = None,
                foreign: Sequence[tuple[str, str, DataFrame, str]] = ()) -> DataFrame:
    """Q1-Q5 of one table in one pass over it: (check_name, violations).

    ``key``: name and columns of the primary key; ``foreign``: (name, column,
    parent, parent's column).  Parents' keys are joined as flags, then one
    aggregate by the primary key, combined map-side, counts all violations; it
    uses the partitioning of a join on a part of the key.
    """
    checks = dict(checks or {})
    for i, (name, column, parent, parent_key) in enumerate(foreign):
        keys = parent.select(F.col(parent_key).alias(f"_p{i}")).where(F.col(f"_p{i}").isNotNull()).distinct()
        df = df.join(keys, F.col(column) == F.col(f"_p{i}"), "left")
        checks[name] = F.col(column).isNotNull() & F.col(f"_p{i}").isNull()
    if key is None:
        return row_checks(df, checks)
    name, columns = key
    counts = [F.sum(F.when(cond, 1).otherwise(0)).alias(f"_c{i}") for i, cond in enumerate(checks.values())]
    per_key = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"), *counts)
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in columns])
    bad = F.when(any_null, F.col("_n")).when(F.col("_n") > 1, F.lit(1)).otherwise(F.lit(0))
    total = per_key.agg(F.sum(bad).alias("_key"), *[F.sum(f"_c{i}").alias(f"_c{i}") for i in range(len(checks))])
    rows = F.array(_one(name, F.coalesce("_key", F.lit(0))), *[_one(n, F.coalesce(F.col(f"_c{i}"), F.lit(0))) for i, n in enumerate(checks)])
    return total.select(F.explode(rows).alias("r")).select("r.check_name", "r.violations")


def not_null(col: str) -> Column:
    return F.col(col).isNull()


def too_long(col: str, n: int) -> Column:
    return F.length(F.col(col)) > n


def outside(col: str, values: Sequence) -> Column:
    """Q4: not in the domain (NULL counts as a violation unless defaulted first)."""
    return F.col(col).isNull() | ~F.col(col).isin(list(values))


def invalid_json(col: str) -> Column:
    """Q5: set but not parseable as JSON."""
    return F.col(col).isNotNull() & F.try_parse_json(F.col(col)).isNull()


def outside_day_window(day: str, as_of: str, days: int = 7) -> Column:
    """Q6: day not within [as_of - days, as_of]."""
    a = F.to_date(F.lit(as_of))
    d = F.to_date(F.col(day))
    return (d < F.date_sub(a, days)) | (d > a)


# --- Q7-Q9, Q11: timesheet rules --------------------------------------------
def timesheet_rules(df: DataFrame, *, group: Sequence[str], order: Sequence[str], hours: str,
                    time_type: str, limit: str, overtime_cap: int = 6, mode: str = "strict",
                    day: str | None = None, as_of: str | None = None, window_days: int = 7) -> DataFrame:
    """Apply the hour rules to candidate rows; adds existing_hours, error_code, message.

    * 20001: a regular row above the contract's daily hours;
    * 20002: regular hours already recorded for the same employee and day
      plus this row exceed the daily hours (``strict``: ``existing + new >
      daily``; ``compat``: the source's literal test ``existing - new > 0 and
      existing + new > daily``, G8);
    * 20003: an overtime row above ``overtime_cap``.

    With ``as_of`` the day window (Q6) is the first rule: 20001 for a ``day``
    outside [as_of - window_days, as_of].  The first failing rule wins.  "Already recorded" counts every earlier
    regular row of the group (set-based form); ``sequential_rules`` gives the
    insert-by-insert form where rejected rows do not count.
    """
    w = (Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    reg = F.col(time_type) == "REG"
    existing = F.coalesce(F.sum(F.when(reg, F.col(hours))).over(w), F.lit(0))
    res = df.withColumn("existing_hours", existing.cast("long"))
    h, lim, ex = F.col(hours), F.col(limit), F.col("existing_hours")
    if mode == "strict":
        cumul = reg & (ex + h > lim)
    elif mode == "compat":
        cumul = reg & (ex - h > 0) & (ex + h > lim)
    else:
        raise ValueError(mode)
    day_txt = F.date_format(F.col(day), "yyyy-MM-dd") if day else F.lit("this day")
    outside = outside_day_window(day, as_of, window_days) if as_of else F.lit(False)
    code = (F.when(outside | (reg & (h > lim)), F.lit(20001)).when(cumul, F.lit(20002))
             .when((F.col(time_type) == "OVT") & (h > overtime_cap), F.lit(20003)))
    msg = (F.when(outside, F.lit(f"The day of work must be between today and the past {window_days} days"))
             .when(code == 20001, F.concat(F.lit("Inserted regular hours ("), h.cast("string"),
                                          F.lit(") exceed daily limit of "), lim.cast("string"),
                                          F.lit(" hours of employment contract.")))
             .when(code == 20002, F.concat(F.lit("This user is already recorded with "), ex.cast("string"),
                                           F.lit(" regular hours on "), day_txt,
                                           F.lit(", so you cannot add your new "), h.cast("string"),
                                           F.lit(" hours.")))
             .when(code == 20003, F.lit(f"No more than {overtime_cap} hours overtime per day")))
    return res.withColumn("error_code", code.cast("long")).withColumn("message", msg)


def split_accepted(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q11: (accepted, rejected); accepted + rejected = input."""
    return checked.where(F.col("error_code").isNull()), checked.where(F.col("error_code").isNotNull())


def sequential_rules(df: DataFrame, *, group: Sequence[str], order: str | Sequence[str], hours: str,
                     time_type: str, limit: str, overtime_cap: int = 6, mode: str = "strict") -> DataFrame:
    """Q8 exact insert-by-insert semantics: a rejected row never counts as recorded.

    Acceptance depends on earlier acceptances, so rows are walked in order.
    The rows are hash-partitioned by group and sorted by (group, order) inside
    each partition; one streaming pass per partition (Arrow batches) carries
    the running state across batches and resets it at each new group.  No
    group is ever materialised as a whole, and there is no per-group Python
    call overhead.
    """
    order = [order] if isinstance(order, str) else list(order)
    group = list(group)
    out_schema = T.StructType(df.schema.fields + [
        T.StructField("existing_hours", T.LongType()), T.StructField("error_code", T.LongType())])
    names = [f.name for f in out_schema.fields]
    strict = mode == "strict"
    if mode not in ("strict", "compat"):
        raise ValueError(mode)

    def walk(batches):
        cur_key = None
        recorded = 0
        for pdf in batches:
            if pdf.empty:
                continue
            keys = list(zip(*[pdf[g].tolist() for g in group]))
            hrs = pdf[hours].astype("int64").to_numpy()
            lim = pdf[limit].astype("int64").to_numpy()
            tts = pdf[time_type].tolist()
            ex_col = np.zeros(len(pdf), dtype=np.int64)
            codes = [None] * len(pdf)
            for i in range(len(pdf)):
                if keys[i] != cur_key:
                    cur_key, recorded = keys[i], 0
                h, lm, tt = int(hrs[i]), int(lim[i]), tts[i]
                ex_col[i] = recorded
                code = None
                if tt == "REG":
                    if h > lm:
                        code = 20001
                    elif (recorded + h > lm) if strict else (recorded - h > 0 and recorded + h > lm):
                        code = 20002
                    else:
                        recorded += h
                elif tt == "OVT" and h > overtime_cap:
                    code = 20003
                codes[i] = code
            pdf = pdf.copy()
            pdf["existing_hours"] = ex_col
            pdf["error_code"] = pd.array(codes, dtype="Int64")
            yield pdf[names]

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartition(n, *group).sortWithinPartitions(*group, *order)
    return ordered.mapInPandas(walk, out_schema)


# --- Q3, Q10: lengths and formats ----------------------------------------------
# Address syntax accepted for e-mails: local part of the usual atom characters
# and dots, "@", dot-separated domain labels, alphabetic top-level domain.
EMAIL_PATTERN = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"


def invalid_email(col: str) -> Column:
    """Q10: set but not an address."""
    return F.col(col).isNotNull() & ~F.col(col).rlike(EMAIL_PATTERN)


def length_outside(col: str, lo: int | None = None, hi: int | None = None) -> Column:
    """Q3: character length outside [lo, hi] (user name 3..30, password >= 8)."""
    n = F.length(F.col(col))
    cond = F.lit(False)
    if lo is not None:
        cond = cond | (n < lo)
    if hi is not None:
        cond = cond | (n > hi)
    return F.col(col).isNotNull() & cond
