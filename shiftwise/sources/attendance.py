"""Meeting attendance reports (UTF-16, tab separated, positional).

Lines (1-based): 2 title, 3 participants, 4 start, 5 end, 6 duration,
7 average attendance (value in column 2); participants from line 11 until
the line ``3. In-Meeting Activities``; blank names are skipped.  The session
fields are repeated on every participant row.

The CSV reader would infer one column from the first line of a UTF-16 file
(G13), so files are read as binary, decoded, and split into lines; each file
is one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwise.functions.scalars import duration_seconds, parse_ts, strip

STOP_LINE = "3. In-Meeting Activities"


def _col2(lines, n):
    return strip(F.try_element_at(F.split(F.coalesce(F.try_element_at(lines, F.lit(n)), F.lit("")), "\t"), F.lit(2)))


def _interval(text):
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), duration_seconds(text).cast("decimal(18,6)"))


def read_attendance_report(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    raw = spark.read.format("binaryFile").load(paths).select(
        F.col("path").alias("file"), F.decode("content", "UTF-16").alias("text"))
    lines = F.split(F.regexp_replace("text", "^\ufeff", ""), r"\r\n|\r|\n")
    f = raw.select("file", lines.alias("lines"))
    sess = f.select(
        "file", "lines",
        _col2(F.col("lines"), 2).alias("session_name"),
        _col2(F.col("lines"), 3).try_cast("int").alias("total_participants"),
        parse_ts(_col2(F.col("lines"), 4)).alias("start_time"),
        parse_ts(_col2(F.col("lines"), 5)).alias("end_time"),
        _interval(_col2(F.col("lines"), 6)).alias("meeting_duration"),
        _interval(_col2(F.col("lines"), 7)).alias("average_attendance_time"))
    body = F.slice(F.col("lines"), 11, F.greatest(F.size("lines") - 10, F.lit(1)))
    names = F.transform(body, lambda ln: strip(F.element_at(F.split(ln, "\t"), 1)))
    stop = F.array_position(names, STOP_LINE).cast("int")
    body = F.when(stop > 0, F.slice(body, 1, stop - 1)).otherwise(body)
    rows = sess.select("*", F.posexplode(body).alias("pos", "line")).withColumn("c", F.split("line", "\t"))
    cell = lambda i: strip(F.try_element_at(F.col("c"), F.lit(i)))
    rows = rows.where(F.coalesce(cell(1), F.lit("")) != "")
    return rows.select(
        "file", (F.col("pos") + 11).alias("line_no"), "session_name", "total_participants", "start_time",
        "end_time", "meeting_duration", "average_attendance_time",
        cell(1).alias("employee_name"), parse_ts(cell(2)).alias("first_join"), parse_ts(cell(3)).alias("last_leave"),
        _interval(cell(4)).alias("in_meeting"), cell(5).alias("employee_email"),
        cell(6).alias("participant_id"), cell(7).alias("role"))
