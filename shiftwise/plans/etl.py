"""Layered attendance/absence load: raw -> staging -> star schema.

Each step is a pure function of DataFrames; ``load_layers`` runs them in the
source's order (attendance before employees: the e-mail lookup; employees
before facts: the history lookup) and is idempotent - every insert goes
through the NULL-safe anti join, so a rerun over the same files adds nothing
(G15).  Surrogate keys are dense and continue after the stored maximum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwise.functions.scalars import make_day, map_constant, oracle_day_label
from shiftwise.operators.joins import dedup_last, insert_new, left_lookup, resolve_keys
from shiftwise.operators.warehouse import date_dimension, scd2_apply, seed_dimension
from shiftwise.operators.windows import assign_keys, next_key
from shiftwise.session import checkpoint_dir

# Fixed values of the source's load (first ids of each table, constant attributes).
BASE_ABSENCE_ID = 3110
BASE_EMPLOYEE_ID = 6110
BASE_SESSION_ID = 9110
GRADE = "DT"
DISCIPLINE = "Data & AI"
FIXED_ABSENCE_MEMBERS = [("S", "Sick"), ("R", "Regular"), ("OVT", "Overtime")]
DATE_RANGE = ("2025-05-01", "2025-08-31")


def _empty(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


# --- staging -----------------------------------------------------------------
def stage_absence_codes(raw: DataFrame, existing: DataFrame) -> DataFrame:
    """D5 (codes): distinct (code, description) with both set, new codes only."""
    cand = raw.where(F.col("absence_code").isNotNull() & F.col("absence_description").isNotNull()).select(
        F.col("absence_code").alias("code"), F.col("absence_description").alias("description")).distinct()
    new = insert_new(existing.select("code"), cand, ["code"], ["description"])
    keyed = assign_keys(new, ["code"], "code_id", start_after=next_key(existing, "code_id").scalar())
    return existing.unionByName(keyed.select(*existing.columns))


def stage_absences(raw: DataFrame, codes: DataFrame, existing: DataFrame) -> DataFrame:
    """D5 (rows): (employee, code id, date, unit) for coded cells; uncoded cells are skipped."""
    rows = raw.where(F.col("absence_code").isNotNull()).join(
        codes.select(F.col("code").alias("absence_code"), "code_id"), "absence_code")
    rows = rows.select("employee_name", "code_id", make_day("year", "month", "day").alias("absence_date"), "du",
                       "file", "line_no", "day_pos")
    key = ["employee_name", "code_id", "absence_date", "du"]
    new = insert_new(existing.select(*key), rows, key, ["file", "line_no", "day_pos"])
    base = next_key(existing, "absence_id", BASE_ABSENCE_ID - 1).scalar()
    keyed = assign_keys(new, ["file", "line_no", "day_pos"], "absence_id", start_after=base)
    return existing.unionByName(keyed.select(*existing.columns))


def stage_attendance(raw: DataFrame, sessions: DataFrame, attendance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One session per name (the earliest start) and the first attendance row per
    (session, e-mail); both insert-only."""
    s_cols = ["session_name", "total_participants", "start_time", "end_time", "meeting_duration",
              "average_attendance_time"]
    cand = raw.select(*s_cols, "file")
    new_s = insert_new(sessions.select("session_name"), cand.drop("file"), ["session_name"],
                       ["start_time", "end_time"])
    new_s = assign_keys(new_s, ["start_time", "session_name"], "training_id",
                        start_after=next_key(sessions, "training_id", BASE_SESSION_ID - 1).scalar())
    sessions = sessions.unionByName(new_s.select(*sessions.columns))
    a_cols = ["session_name", "employee_name", "employee_email", "first_join", "last_leave", "in_meeting"]
    a_cand = raw.select(*a_cols, "file", "line_no")
    new_a = insert_new(attendance.select("session_name", "employee_email"), a_cand,
                       ["session_name", "employee_email"], ["first_join", "file", "line_no"])
    new_a = assign_keys(new_a, ["session_name", "first_join", "employee_email"], "attendance_id",
                        start_after=next_key(attendance, "attendance_id").scalar())
    return sessions, attendance.unionByName(new_a.select(*attendance.columns))


def stage_employees(raw_absences: DataFrame, attendance: DataFrame, existing: DataFrame,
                    managers: dict[str, str]) -> DataFrame:
    """Distinct (name, unit) + e-mail from training attendance (last row wins, G6)
    + constants + line manager by unit; insert-only on the whole tuple."""
    people = raw_absences.where(F.col("employee_name").isNotNull()).select("employee_name", "du").distinct()
    with_mail = left_lookup(people, attendance, ["employee_name"], "attendance_id", ["employee_email"])
    cand = with_mail.select("employee_name", "employee_email", F.lit(GRADE).alias("grade"),
                            F.lit(DISCIPLINE).alias("discipline"),
                            map_constant("du", managers).alias("line_manager"), "du")
    key = ["employee_name", "employee_email", "grade", "discipline", "line_manager", "du"]
    new = insert_new(existing.select(*key), cand, key, ["employee_name", "du"])
    keyed = assign_keys(new, ["employee_name", "du"], "employee_id",
                        start_after=next_key(existing, "employee_id", BASE_EMPLOYEE_ID - 1).scalar())
    return existing.unionByName(keyed.select(*existing.columns))


# --- target -------------------------------------------------------------------
EMP_ATTRS = ["employee_name", "employee_email", "grade", "discipline", "line_manager", "du"]


def load_absence_facts(stg_absences: DataFrame, stg_codes: DataFrame, history: DataFrame, dim_date: DataFrame,
                       dim_absence: DataFrame, existing: DataFrame, project_id: int = 1):
    """Employee name -> active history id, date -> date id, staging code id ->
    code -> target absence id (two hops).  Returns (facts, rejected)."""
    # one active version per name (names are the source's lookup key; G6)
    hist = dedup_last(history.where(F.col("is_active") == "Y"), ["employee_name"], "history_id", ["history_id"])
    code_hop = stg_codes.select("code_id", "code").join(
        dim_absence.select("code", F.col("code_id").alias("absence_id")), "code")
    fact = stg_absences.select("absence_id", "employee_name", F.col("code_id"), "absence_date", "du") \
        .withColumnRenamed("absence_id", "stg_absence_id")
    resolved, rejected = resolve_keys(fact, [
        (hist, ["employee_name"], "history_id"),
        (dim_date.select(F.col("full_date").alias("absence_date"), "date_id"), ["absence_date"], "date_id"),
        (code_hop.select("code_id", "absence_id"), ["code_id"], "absence_id")])
    rows = resolved.select("stg_absence_id", "history_id", "absence_id", "date_id",
                           F.lit(project_id).cast("long").alias("project_id"), "du")
    new = insert_new(existing.select("stg_absence_id"), rows, ["stg_absence_id"], ["stg_absence_id"])
    keyed = assign_keys(new, ["stg_absence_id"], "id", start_after=next_key(existing, "id").scalar())
    return existing.unionByName(keyed.select(*existing.columns)), rejected


@dataclass
class Layers:
    raw_absences: DataFrame
    stg_codes: DataFrame
    stg_absences: DataFrame
    stg_sessions: DataFrame
    stg_attendance: DataFrame
    stg_employees: DataFrame
    dim_date: DataFrame
    dim_absence: DataFrame
    dim_history: DataFrame
    fact_absence: DataFrame
    rejected: DataFrame


def empty_layers(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "stg_codes": _empty(spark, "code_id long, code string, description string"),
        "stg_absences": _empty(spark, "absence_id long, employee_name string, code_id long, absence_date date, du string"),
        "stg_sessions": _empty(spark, "training_id long, session_name string, total_participants int, "
                                      "start_time timestamp, end_time timestamp, meeting_duration interval day to second, "
                                      "average_attendance_time interval day to second"),
        "stg_attendance": _empty(spark, "attendance_id long, session_name string, employee_name string, "
                                        "employee_email string, first_join timestamp, last_leave timestamp, "
                                        "in_meeting interval day to second"),
        "stg_employees": _empty(spark, "employee_id long, employee_name string, employee_email string, grade string, "
                                       "discipline string, line_manager string, du string"),
        "dim_absence": _empty(spark, "code_id long, code string, description string"),
        "dim_history": _empty(spark, "history_id long, employee_id long, employee_name string, employee_email string, "
                                     "grade string, discipline string, line_manager string, du string, "
                                     "start_ts timestamp_ntz, end_ts timestamp_ntz, is_active string"),
        "fact_absence": _empty(spark, "id long, stg_absence_id long, history_id long, absence_id long, date_id long, "
                                      "project_id long, du string"),
    }


def _barrier(df: DataFrame) -> DataFrame:
    """Layer boundary: materialize into the shared checkpoint folder and cut the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def load_layers(spark: SparkSession, raw_absences: DataFrame, raw_attendance: DataFrame, managers: dict[str, str],
                effective_ts: str, current: dict[str, DataFrame] | None = None) -> Layers:
    """Run every layer once over the given raw inputs on top of ``current`` tables.

    Each produced layer is materialized once (the layer write of a real run),
    so later layers read it instead of re-deriving it.
    """
    cur = current or empty_layers(spark)
    raw_absences = _barrier(raw_absences)
    raw_attendance = _barrier(raw_attendance)
    codes = _barrier(stage_absence_codes(raw_absences, cur["stg_codes"]))
    absences = _barrier(stage_absences(raw_absences, codes, cur["stg_absences"]))
    sessions, attendance = stage_attendance(raw_attendance, cur["stg_sessions"], cur["stg_attendance"])
    sessions, attendance = _barrier(sessions), _barrier(attendance)
    employees = _barrier(stage_employees(raw_absences, attendance, cur["stg_employees"], managers))
    bounds = spark.range(1).select(F.to_date(F.lit(DATE_RANGE[0])).alias("s"), F.to_date(F.lit(DATE_RANGE[1])).alias("e"))
    dim_date = date_dimension(bounds, "s", "e")
    fixed = spark.createDataFrame(FIXED_ABSENCE_MEMBERS, "code string, description string")
    dim_absence = _barrier(seed_dimension(cur["dim_absence"], codes.select("code", "description"), fixed,
                                          "code", "code_id"))
    history = _barrier(scd2_apply(cur["dim_history"], employees.select("employee_id", *EMP_ATTRS), ["employee_id"],
                                  EMP_ATTRS, effective_ts))
    facts, rejected = load_absence_facts(absences, codes, history, dim_date, dim_absence, cur["fact_absence"])
    facts = _barrier(facts)
    return Layers(raw_absences, codes, absences, sessions, attendance, employees, dim_date, dim_absence,
                  history, facts, rejected)


def absence_listing(layers: Layers) -> DataFrame:
    """Facts joined to their dimensions, dates as ``DD-MON-YY``."""
    f = layers.fact_absence
    j = (f.join(layers.dim_history.select("history_id", "employee_name"), "history_id")
         .join(layers.dim_absence.select(F.col("code_id").alias("absence_id"), "code", "description"), "absence_id")
         .join(layers.dim_date.select("date_id", "full_date"), "date_id"))
    return j.select("id", "employee_name", "code", "description", oracle_day_label("full_date").alias("day"), "du")


def people_per_code(layers: Layers) -> DataFrame:
    """R3 on the star schema: distinct employees per absence code."""
    j = layers.fact_absence.join(layers.dim_absence.select(F.col("code_id").alias("absence_id"), "code"), "absence_id")
    return j.groupBy("code").agg(F.count_distinct("history_id").alias("people")).orderBy(F.desc("people"), "code")
