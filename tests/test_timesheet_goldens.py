"""Goldens from the timesheet seed rows (20 entries) and the trigger use cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shiftwise.operators import aggregates as agg
from shiftwise.operators import quality as qc
from shiftwise.operators.joins import left_join_filtered
from shiftwise.operators.windows import global_rank

# (timesheet_id, link, type, day, hours); links map to (project, employee).
SEED = [
    (1, "EP103004", "REG", "2025-06-05", 4), (2, "EP103005", "REG", "2025-06-05", 4),
    (3, "EP103004", "REG", "2025-06-06", 4), (4, "EP103005", "REG", "2025-06-06", 4),
    (5, "EP100001", "REG", "2025-06-06", 8), (6, "EP100001", "OVT", "2025-06-06", 3),
    (7, "EP127008", "REG", "2025-06-07", 8), (8, "EP127008", "OVT", "2025-06-07", 2),
    (9, "EP103004", "REG", "2025-06-07", 4), (10, "EP103005", "REG", "2025-06-07", 4),
    (11, "EP103005", "OVT", "2025-06-07", 5), (12, "EP100001", "REG", "2025-06-07", 8),
    (13, "EP124005", "REG", "2025-06-07", 6), (14, "EP127008", "REG", "2025-06-08", 8),
    (15, "EP127008", "OVT", "2025-06-08", 3), (16, "EP103004", "REG", "2025-06-08", 4),
    (17, "EP103005", "REG", "2025-06-08", 4), (18, "EP100001", "REG", "2025-06-08", 8),
    (19, "EP124005", "REG", "2025-06-09", 6), (20, "EP127008", "REG", "2025-06-09", 8),
]
LINKS = [("EP100001", "PRJ001", 100), ("EP103004", "PRJ004", 103), ("EP103005", "PRJ004", 103),
         ("EP124005", "PRJ005", 124), ("EP127008", "PRJ008", 127)]
CONTRACT = [(100, 8), (103, 4), (124, 6), (127, 8)]
EMPLOYEES = [100, 101, 102, 103, 104, 124, 125, 126, 127]


@pytest.fixture(scope="module")
def ts(spark):
    sheets = spark.createDataFrame(
        [(i, l, t, dt.date.fromisoformat(d), h) for i, l, t, d, h in SEED],
        "timesheet_id long, link string, time_type string, day date, hours int")
    links = spark.createDataFrame(LINKS, "link string, project string, employee_id int")
    limits = spark.createDataFrame(CONTRACT, "employee_id int, daily_hours int")
    return sheets.join(links, "link").join(limits, "employee_id", "left")


def test_regular_totals_and_rank(ts):
    totals = agg.hours_by_key(ts, ["employee_id"], "hours", where=F.col("time_type") == "REG")
    got = {r.employee_id: int(r.total_hours) for r in totals.collect()}
    assert got == {103: 32, 100: 24, 127: 24, 124: 12}
    ranked = global_rank(totals, [F.col("total_hours").desc_nulls_first()], "rank", "rk",
                         num_partitions=3)
    assert {r.employee_id: r.rk for r in ranked.collect()} == {103: 1, 100: 2, 127: 2, 124: 4}


def test_project_hours(ts):
    ph = agg.hours_by_key(ts, ["project"], "hours")
    assert {r.project: int(r.total_hours) for r in ph.collect()} == {
        "PRJ001": 27, "PRJ004": 37, "PRJ005": 12, "PRJ008": 29}
    assert ts.count() == 20


def test_left_join_one_day(spark, ts):
    emps = spark.createDataFrame([(e,) for e in EMPLOYEES], "employee_id int")
    day = ts.select("employee_id", "day", "hours")
    j = left_join_filtered(emps, day, "employee_id", F.col("day") == F.lit("2025-06-05").cast("date"))
    got = {r.employee_id: r.h for r in j.groupBy("employee_id").agg(
        F.coalesce(F.sum("hours"), F.lit(0)).alias("h")).collect()}
    assert got == {e: (8 if e == 103 else 0) for e in EMPLOYEES}


def _flags(df):
    return sorted(r.timesheet_id for r in df.where(F.col("error_code").isNotNull()).collect())


def test_cumulative_rule_modes(ts):
    kw = dict(group=["employee_id", "day"], order=["timesheet_id"], hours="hours", time_type="time_type",
              limit="daily_hours")
    assert _flags(qc.timesheet_rules(ts, mode="strict", **kw)) == [2, 4, 10, 17]
    assert _flags(qc.timesheet_rules(ts, mode="compat", **kw)) == []
    seq = qc.sequential_rules(ts, group=["employee_id", "day"], order="timesheet_id", hours="hours",
                              time_type="time_type", limit="daily_hours")
    assert _flags(seq) == [2, 4, 10, 17]


def test_trigger_cases(spark):
    rows = [(900, 100, "REG", 9, 8), (901, 103, "REG", 4, 4), (902, 103, "REG", 7, 4), (903, 127, "OVT", 7, 8)]
    df = spark.createDataFrame(rows, "timesheet_id long, employee_id int, time_type string, hours int, daily_hours int")
    df = df.withColumn("day", F.lit("2025-06-10").cast("date"))
    res = qc.timesheet_rules(df, group=["employee_id", "day"], order=["timesheet_id"], hours="hours",
                             time_type="time_type", limit="daily_hours")
    codes = {r.timesheet_id: r.error_code for r in res.collect()}
    assert codes == {900: 20001, 901: None, 902: 20001, 903: 20003}
    acc, rej = qc.split_accepted(res)
    assert acc.count() + rej.count() == df.count()


def test_day_window(spark):
    df = spark.createDataFrame([("2025-06-12",), ("2025-06-03",), ("2025-06-04",), ("2025-06-11",)], "d string")
    bad = df.where(qc.outside_day_window("d", "2025-06-11", 7)).collect()
    assert sorted(r.d for r in bad) == ["2025-06-03", "2025-06-12"]
