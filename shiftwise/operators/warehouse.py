"""Warehouse and table-maintenance operators.

Parquet tables have no MERGE, so every operator is a pure function
``(current, incoming, ...) -> new table``.  Writing the result is a separate,
staged step (``stage_and_swap``) so a failed job never leaves a half-written
table and a rerun produces the same table (idempotent loads, G15).
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftwise.functions.scalars import fill_template, module_label
from shiftwise.operators.joins import first_per_key, insert_new
from shiftwise.operators.windows import assign_keys, next_key
from shiftwise.session import checkpoint_dir


# --- D2 ---------------------------------------------------------------------
def date_dimension(bounds: DataFrame, start_col: str, end_col: str) -> DataFrame:
    """One row per day between the bounds of each input row (usually one row).

    Columns: date_id (yyyyMMdd), full_date, day, month, year, English weekday
    name and a weekend flag.  Generated by ``explode(sequence)``; the size is
    the number of calendar days, not the data volume.
    """
    days = bounds.select(F.explode(F.sequence(F.col(start_col), F.col(end_col),
                                              F.expr("INTERVAL 1 DAY"))).alias("full_date"))
    dow = F.dayofweek("full_date")  # 1 = Sunday, 7 = Saturday
    return days.select(
        F.date_format("full_date", "yyyyMMdd").cast("long").alias("date_id"),
        "full_date",
        F.dayofmonth("full_date").alias("day"),
        F.month("full_date").alias("month"),
        F.year("full_date").alias("year"),
        F.date_format("full_date", "EEEE").alias("day_of_week"),
        F.when(dow.isin(1, 7), "Y").otherwise("N").alias("is_weekend"))


# --- D3 ---------------------------------------------------------------------
def seed_dimension(existing: DataFrame, derived: DataFrame, fixed: DataFrame, key: str,
                   id_col: str) -> DataFrame:
    """Existing members + derived members + fixed members that are still missing.

    Derived rows win over fixed rows with the same key; new members get dense
    ids after the current maximum, in key order.
    """
    cand = derived.unionByName(fixed.join(derived.select(key), key, "left_anti"))
    new = insert_new(existing, cand, [key], [key])
    base = next_key(existing, id_col).scalar()
    keyed = assign_keys(new, [key], id_col, start_after=base)
    return existing.unionByName(keyed.select(*existing.columns))


# --- D1 ---------------------------------------------------------------------
def scd2_apply(history: DataFrame, snapshot: DataFrame, key: Sequence[str], attrs: Sequence[str],
               effective_ts, id_col: str = "history_id", start_col: str = "start_ts",
               end_col: str = "end_ts", active_col: str = "is_active", open_end=None) -> DataFrame:
    """Slowly changing dimension type 2 in one pass.

    * key without active version -> insert the first version;
    * any attribute differs (NULL-safe) -> close the active row at
      ``effective_ts`` (``is_active='N'``) and insert a new active version;
    * no change -> nothing.

    The snapshot must hold one row per key (reduce it with ``first_per_key``
    or apply several snapshots in ``effective_ts`` order).  Invariant: exactly
    one active row per key afterwards.
    """
    key = list(key)
    eff = F.lit(effective_ts).cast("timestamp_ntz") if not isinstance(effective_ts, Column) else effective_ts
    end_val = (F.lit(open_end).cast("timestamp_ntz") if open_end is not None
               else F.lit(None).cast("timestamp_ntz"))
    act = history.where(F.col(active_col) == "Y").select(*key, *[F.col(a).alias(f"_h_{a}") for a in attrs],
                                                         F.lit(True).alias("_h_present"))
    cmp = snapshot.select(*key, *attrs).join(act, key, "left")
    differs = reduce(lambda x, y: x | y, [~F.col(a).eqNullSafe(F.col(f"_h_{a}")) for a in attrs])
    status = (F.when(F.col("_h_present").isNull(), "new").when(differs, "changed").otherwise("same"))
    cmp = cmp.withColumn("_status", status)
    changed = cmp.where(F.col("_status") == "changed").select(*key, F.lit(True).alias("_chg"))
    closing = F.coalesce(F.col("_chg"), F.lit(False)) & (F.col(active_col) == "Y")
    kept = (history.join(changed, key, "left")
            .withColumn(end_col, F.when(closing, eff).otherwise(F.col(end_col)))
            .withColumn(active_col, F.when(closing, F.lit("N")).otherwise(F.col(active_col)))
            .drop("_chg"))
    inserts = cmp.where(F.col("_status").isin("new", "changed")).select(*key, *attrs)
    base = next_key(history, id_col).scalar()
    new_rows = (assign_keys(inserts, key, id_col, start_after=base)
                .withColumn(start_col, eff).withColumn(end_col, end_val)
                .withColumn(active_col, F.lit("Y")))
    return kept.unionByName(new_rows.select(*history.columns))


def scd2_versions(active: DataFrame, snapshots: DataFrame, key: Sequence[str], attrs: Sequence[str], effective: str,
                  start_col: str = "start_ts", end_col: str = "end_ts") -> DataFrame:
    """D1 for several snapshots in one pass: the versions of every key that is active or in a snapshot.

    ``active`` (key, attrs, start) holds the open versions alone, ``snapshots``
    (key, attrs, ``effective``) any number of rows a key, one for each time.
    A snapshot row that differs (NULL-safe) from the version before it starts a
    new one, which closes the other; the last stays open (null end).  Rows no
    later than a key's open version are known already and change nothing, so
    a snapshot may be applied again.  Closed rows of the stored history are
    neither read nor written.
    """
    seen = active.select(*key, *attrs, F.col(start_col), F.lit(True).alias("_stored")).unionByName(
        snapshots.select(*key, *attrs, F.col(effective).alias(start_col), F.lit(False).alias("_stored")))
    order = Window.partitionBy(*key).orderBy(F.desc("_stored"), start_col)
    same = reduce(lambda x, y: x & y, [F.col(a).eqNullSafe(F.lag(a).over(order)) for a in attrs])
    opened = F.max(F.when(F.col("_stored"), F.col(start_col))).over(Window.partitionBy(*key))
    seen = seen.withColumn("_open", opened).where(F.col("_stored") | F.col("_open").isNull() | (F.col(start_col) > F.col("_open"))).drop("_open")
    kept = seen.withColumn("_same", same & (F.row_number().over(order) > 1)).where(~F.col("_same")).drop("_same")
    return kept.withColumn(end_col, F.lead(start_col).over(order)).withColumnRenamed("_stored", "stored")


def scd2_store(spark: SparkSession, path: str, snapshots: DataFrame, key: Sequence[str], attrs: Sequence[str], effective: str,
               batch_no: int, id_col: str = "history_id") -> None:
    """D1 on a stored history, partitioned by ``is_active`` and the batch that closed a row.

    Only the active folder is read and replaced; rows that this batch closes
    become a folder of their own.  A batch that runs again closes nothing more.
    """
    from shiftwise.sources.tables import path_exists
    kinds = {f.name: f.dataType.simpleString() for f in snapshots.schema.fields}
    schema = ", ".join([f"{id_col} bigint", *(f"{c} {kinds[c]}" for c in (*key, *attrs)), f"start_ts {kinds[effective]}", f"end_ts {kinds[effective]}", "is_active string", "batch_no bigint"])
    history = spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)
    active = history.where("is_active = 'Y'")
    versions = scd2_versions(active, snapshots, key, attrs, effective)
    old = active.select(*[F.col(k).alias(f"_o_{k}") for k in key], id_col)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in key])
    stored = versions.where("stored").join(old, same).drop(*[f"_o_{k}" for k in key])
    base = next_key(history, id_col).scalar()  # reads the id column alone
    new = assign_keys(versions.where("not stored"), [*key, "start_ts"], id_col, start_after=base)
    closes = F.col("end_ts").isNotNull()
    rows = stored.unionByName(new, allowMissingColumns=True).withColumn("is_active", F.when(closes, "N").otherwise("Y"))
    rows = rows.withColumn("batch_no", F.when(closes, F.lit(batch_no)).otherwise(F.lit(-1)).cast("long"))
    checkpoint_dir(spark)
    done = rows.select(*history.columns).checkpoint(eager=True)  # before the folder that it was read from is replaced
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("is_active", "batch_no").parquet(path)


# --- D7-D11, D16 ------------------------------------------------------------
def upsert(current: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert or replace by key; of several incoming rows of a key the first in the order of their columns."""
    incoming = first_per_key(incoming.select(*current.columns), list(key), [c for c in current.columns if c not in key])
    return current.join(incoming.select(*key), list(key), "left_anti").unionByName(
        incoming.select(*current.columns))


def partial_update(current: DataFrame, patch: DataFrame, key: Sequence[str],
                   clear: Sequence[str] = ()) -> DataFrame:
    """Only non-NULL patch fields overwrite; ``clear`` fields become ''."""
    fields = [c for c in current.columns if c not in key]
    p = patch.select(*key, *[F.col(f).alias(f"_p_{f}") for f in fields if f in patch.columns],
                     F.lit(True).alias("_p_hit"))
    j = current.join(p, list(key), "left")
    out = []
    for f in fields:
        if f in clear:
            out.append(F.when(F.col("_p_hit"), F.lit("")).otherwise(F.col(f)).alias(f))
        elif f in patch.columns:
            out.append(F.coalesce(F.col(f"_p_{f}"), F.col(f)).alias(f))
        else:
            out.append(F.col(f))
    return j.select(*key, *out).select(*current.columns)


def replace_set(current: DataFrame, incoming: DataFrame, owner: Sequence[str]) -> DataFrame:
    """Delete all rows of each incoming owner, insert its distinct new set."""
    return current.join(incoming.select(*owner).distinct(), list(owner), "left_anti").unionByName(
        incoming.select(*current.columns).distinct())


def insert_unique(current: DataFrame, incoming: DataFrame, unique_cols: Sequence[str],
                  order: Sequence[str]) -> DataFrame:
    """Accept a row unless one of its unique columns is already taken.

    Taken means: held by a stored row or by an earlier accepted row (``order``
    is total); a rejected row takes nothing.  Returns the batch with ``status``
    ('accepted' or 'rejected') and ``reason`` (first violated column).

    Decided in rounds: of the open rows, those with a taken value are rejected;
    of the rest, those that come first for each of their values are accepted,
    because no open row can take a value from them.  A round settles at least
    the first open row, usually nearly all.
    """
    checkpoint_dir(incoming.sparkSession)
    rows = incoming.withColumn("_ord", F.struct(*order)).withColumn("_row", F.to_json("_ord"))
    values = rows.select("_ord", "_row", F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(u).cast("string").alias("_v"))
                                                             for i, u in enumerate(unique_cols)])).alias("x")).select("_ord", "_row", "x.*")
    values = values.where(F.col("_v").isNotNull()).checkpoint()
    taken = None  # by stored rows: before any row of the batch
    for i, u in enumerate(unique_cols):
        held = current.select(F.lit(i).alias("_i"), F.col(u).cast("string").alias("_v")).where(F.col("_v").isNotNull()).distinct()
        taken = held if taken is None else taken.unionByName(held)
    taken = taken.select("_i", "_v", F.lit(None).cast(values.schema["_ord"].dataType).alias("_by")).checkpoint()
    accepted = rows.select("_row").join(values.select("_row"), "_row", "left_anti")  # rows without any value
    undecided = values
    while not undecided.isEmpty():
        free = undecided.join(undecided.join(taken, ["_i", "_v"], "left_semi").select("_row").distinct(), "_row", "left_anti").checkpoint()
        first = free.groupBy("_i", "_v").agg(F.min("_ord").alias("_first"))
        late = free.join(first, ["_i", "_v"]).where(F.col("_ord") != F.col("_first")).select("_row").distinct()
        won = free.join(late, "_row", "left_anti").checkpoint()
        accepted = accepted.unionByName(won.select("_row").distinct())
        taken = taken.unionByName(won.select("_i", "_v", F.col("_ord").alias("_by"))).checkpoint()
        undecided = free.join(won.select("_row").distinct(), "_row", "left_anti").checkpoint()
    status = accepted.distinct().withColumn("status", F.lit("accepted"))
    clash = values.join(taken, ["_i", "_v"]).where(F.col("_by").isNull() | (F.col("_by") < F.col("_ord")))
    names = F.array(*[F.lit(f"{u} taken") for u in unique_cols])
    reasons = clash.groupBy("_row").agg(F.min("_i").alias("_i")).select("_row", F.element_at(names, F.col("_i") + 1).alias("_reason"))
    out = rows.join(status, "_row", "left").join(reasons, "_row", "left")
    return out.select(*incoming.columns, F.coalesce("status", F.lit("rejected")).alias("status"),
                      F.when(F.col("status").isNull(), F.col("_reason")).alias("reason"))


def delete_by_key(current: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is not in ``keys`` (count deleted = before - after)."""
    return current.join(keys.select(*key).distinct(), list(key), "left_anti")


def ensure_rows(current: DataFrame, defaults: DataFrame, key: Sequence[str],
                correct: Sequence[str]) -> DataFrame:
    """Insert missing default rows; on present rows force the ``correct`` fields."""
    fixed = partial_update(current, defaults.select(*key, *correct), key)
    missing = defaults.join(current.select(*key), list(key), "left_anti")
    return fixed.unionByName(missing.select(*current.columns))


# --- P11, D14, D15 ----------------------------------------------------------
def adjust_salary(df: DataFrame, salary: str, commission: str, default_pct: float = 0.02,
                  out: str = "new_salary") -> DataFrame:
    """Salary * (1 + commission) when commission is set, else salary * (1 + default)."""
    sal = F.col(salary).cast("decimal(12,2)")
    com = F.col(commission).cast("decimal(4,2)")
    factor = F.when(com.isNotNull(), F.lit(1).cast("decimal(4,2)") + com).otherwise(
        F.lit(1 + default_pct).cast("decimal(4,2)"))
    return (df.withColumn(out, F.round(sal * factor, 2).cast("decimal(12,2)"))
              .withColumn("branch", F.when(com.isNotNull(), "COMMISSION").otherwise("DEFAULT")))


# Log levels and texts of the salary procedure.
DEBUG, INFO, WARNING, ERROR = "DEBUG", "INFO", "WARNING", "ERROR"
AUDIT_MODULE = "HR_MANAGEMENT"
AUDIT_UNIT = "HR_MANAGEMENT.ADJUST_SALARIES_BY_COMMISSION"
MSG_VARIABLE = "[VAR] {name} = {value}"
MSG_COMMISSION = "Commission_pct found: {value}"
MSG_DEFAULT = "Commission_pct NULL, applied default 2%"
MSG_UPDATED = "Updated SALARY -> {value}"
MSG_START, MSG_END = ">>> START {module}", "<<< END {module}"
MSG_ZERO_DIVIDE = "Code = [-1476] > ORA-01476: divisor is equal to zero"
# Lines of the procedure that write the rows (a parameter of the log, not of the result).
AUDIT_LINES = {"start": 1, "id": 2, "old": 3, "branch": 4, "new": 5, "end": 6, "error": 7}


def number_text(x) -> Column:
    """A decimal as the database writes it: no trailing zeros, no zero before the point."""
    s = x.cast("string")
    s = F.when(s.contains("."), F.regexp_replace(F.regexp_replace(s, "0+$", ""), "[.]$", "")).otherwise(s)
    return F.when(s == "0", s).otherwise(F.regexp_replace(s, "^(-?)0[.]", "$1."))


def _log_columns(log_time, module: Column, line, level, message) -> list[Column]:
    return [F.lit(log_time).cast("timestamp_ntz").alias("log_time"), module.alias("module_name"),
            line.cast("long").alias("line_no"), level.alias("log_level"), message.alias("log_message")]


def audit_rows(adjusted: DataFrame, id_col: str, salary: str, commission: str, new_salary: str, seq_col: str,
               log_time: str, lines: dict[str, int] | None = None) -> DataFrame:
    """Four log rows per adjusted row: id, old value, branch, new value.

    ``seq_col`` is the row's 1-based position (from ``assign_keys``); log ids
    are ``1 + 4 * (seq - 1) + i`` so the START row is 1 and ids are dense.
    All are DEBUG, but the branch row of the default percentage is a WARNING.
    """
    at = {**AUDIT_LINES, **(lines or {})}
    unset = F.col(commission).isNull()

    def row(i: int, line: str, message: Column, level: Column | None = None) -> Column:
        return F.struct(F.lit(i).alias("i"), F.lit(at[line]).alias("line"), (F.lit(DEBUG) if level is None else level).alias("level"),
                        message.alias("message"))

    rows = F.array(
        row(1, "id", fill_template(MSG_VARIABLE, name=F.lit("EMP_ID"), value=F.col(id_col).cast("string"))),
        row(2, "old", fill_template(MSG_VARIABLE, name=F.lit("OLD_SALARY"), value=number_text(F.col(salary)))),
        row(3, "branch", F.when(unset, F.lit(MSG_DEFAULT)).otherwise(fill_template(MSG_COMMISSION, value=number_text(F.col(commission)))),
            F.when(unset, F.lit(WARNING)).otherwise(F.lit(DEBUG))),
        row(4, "new", fill_template(MSG_UPDATED, value=number_text(F.col(new_salary)))))
    ex = adjusted.select(seq_col, F.explode(rows).alias("r"))
    label = module_label(F.lit(AUDIT_UNIT), F.lit(AUDIT_MODULE), F.lit("PROCEDURE"))
    return ex.select((F.lit(1) + (F.col(seq_col) - 1) * 4 + F.col("r.i")).cast("long").alias("log_id"),
                     *_log_columns(log_time, label, F.col("r.line"), F.col("r.level"), F.col("r.message")))


def update_with_audit(table: DataFrame, id_col: str, salary: str, commission: str, table_path: str,
                      log_path: str, log_time: str, debug: bool = True, default_pct: float = 0.02) -> str:
    """D14 end to end: adjust, write the audit log first (append; it survives a
    failed table write, like the autonomous log transaction), then the new
    table version (staged)."""
    adjusted = adjust_salary(table, salary, commission, default_pct)
    seq = assign_keys(adjusted, [id_col], "_seq")
    total = adjusted.agg(F.count(F.lit(1))).scalar()
    body = audit_rows(seq, id_col, salary, commission, "new_salary", "_seq", log_time)
    log = filter_log(bracket_log(body, total, log_time), debug)
    log.write.mode("append").parquet(log_path)
    new_table = adjusted.withColumn(salary, F.col("new_salary")).drop("new_salary", "branch")
    return stage_and_swap(new_table, table_path)


def bracket_log(body: DataFrame, total: Column, log_time: str, lines: dict[str, int] | None = None) -> DataFrame:
    """START (id 1) and END (id 4 * total + 2) rows around an audit body."""
    at = {**AUDIT_LINES, **(lines or {})}
    label = module_label(F.lit(AUDIT_UNIT), F.lit(AUDIT_MODULE), F.lit("PROCEDURE"))
    one = body.sparkSession.range(1)
    ends = [one.select(id_.cast("long").alias("log_id"), *_log_columns(
        log_time, label, F.lit(at[line]), F.lit(INFO), fill_template(text, module=F.lit(AUDIT_MODULE))))
        for id_, line, text in ((F.lit(1), "start", MSG_START), (total * 4 + 2, "end", MSG_END))]
    return ends[0].unionByName(body).unionByName(ends[1])


def error_rows(failed: DataFrame, id_col: str, unit: str, module: str, kind: str, log_time: str, line: int = AUDIT_LINES["error"]) -> DataFrame:
    """One ERROR row for each row whose division failed; ``log_id`` is the row's id."""
    label = module_label(F.lit(unit), F.lit(module), F.lit(kind))
    return failed.select(F.col(id_col).cast("long").alias("log_id"),
                         *_log_columns(log_time, label, F.lit(line), F.lit(ERROR), F.lit(MSG_ZERO_DIVIDE)))


def filter_log(log: DataFrame, debug: bool, level_col: str = "log_level") -> DataFrame:
    """Messages and variables are written in debug mode only, errors always."""
    return log if debug else log.where(F.col(level_col) == ERROR)


# --- D12, D13: persisted results --------------------------------------------
def stage_and_swap(df: DataFrame, path: str, spark: SparkSession | None = None) -> str:
    """Write ``df`` to a fresh sibling folder, then point readers at it.

    Returns the new folder; the previous version stays readable until the
    caller drops it, so a failure mid-write never corrupts the table.  Each
    version adds a marker of its own, so a reader always finds one.
    """
    target = f"{path.rstrip('/')}.v{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").parquet(target)
    marker = os.path.join(path.rstrip("/") + ".current")
    sp = spark or df.sparkSession
    sp.createDataFrame([(time.time_ns(), target)], "at long, path string").coalesce(1).write.mode("append").json(marker)
    return target


def current_version(spark: SparkSession, path: str) -> str:
    marker = os.path.join(path.rstrip("/") + ".current")
    return spark.read.schema("at long, path string").json(marker).agg(F.max_by("path", "at")).first()[0]


def refresh_materialized(df: DataFrame, path: str) -> str:
    """Complete refresh on demand (recompute + staged overwrite)."""
    return stage_and_swap(df, path)


def copy_table(df: DataFrame, path: str) -> str:
    """CREATE TABLE AS SELECT."""
    df.write.mode("errorifexists").parquet(path)
    return path


__all__ = [n for n in dir() if not n.startswith("_")] + ["first_per_key"]
