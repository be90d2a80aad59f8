"""Monthly absence calendars (positional CSV) -> one row per employee and day.

Layout of a file (line numbers 1-based): 2 month (name or number), 3 unit,
4 ``code, description`` pairs (a code is a cell matching ``[A-Z0-9/]+``, its
description the next non-empty cell), 6 the year (first 4-digit cell),
8 header (day numbers, ``Total days``, optional ``Missing time/h``), 9.. one
employee per line until ``<month> total`` or ``absence type key total``.

Each file is read whole (``wholetext``), so one file is one task and a
thousand files are a thousand tasks; every step after that is a column
expression over the file's line array, then two ``posexplode``s (employees,
days).  The CSV reader is not used: the header is positional.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwise.functions.scalars import month_number, strip

# Split on commas outside double quotes.
_CELL_SPLIT = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _cells(line: Column) -> Column:
    raw = F.split(line, _CELL_SPLIT, -1)
    return F.transform(raw, lambda c: F.regexp_replace(c, r'^"|"$', ""))


def _line(lines: Column, n: int) -> Column:
    return F.coalesce(F.try_element_at(lines, F.lit(n)), F.lit(""))


def read_absence_matrix(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Raw absence rows: file, month, du, absence_code, absence_description, day, year,
    employee_name, total_missing_days, missing_time, line_no, day_pos.

    Blank day cells give a NULL code (as in the source); codes are trimmed
    (G1).  Use ``assign_keys`` on (file, line_no, day_pos) for dense ids.
    """
    return absence_rows(spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value")))


def absence_rows(raw: DataFrame) -> DataFrame:
    """The rows of ``read_absence_matrix`` of calendar texts (file, value)."""
    lines = F.split(F.regexp_replace("value", "^\ufeff", ""), r"\r\n|\r|\n")
    f = raw.select("file", lines.alias("lines"))
    month_cell = strip(F.element_at(_cells(_line(F.col("lines"), 2)), 1))
    du = strip(F.element_at(_cells(_line(F.col("lines"), 3)), 1))
    c4 = _cells(_line(F.col("lines"), 4))
    n4 = F.size(c4)
    entries = F.transform(F.sequence(F.lit(1), F.greatest(n4, F.lit(1))), lambda i: F.struct(
        strip(F.element_at(c4, i)).alias("code"),
        strip(F.try_element_at(F.filter(F.slice(c4, i + 1, F.greatest(n4, F.lit(1))),
                                        lambda d: strip(d) != ""), F.lit(1))).alias("description")))
    entries = F.filter(entries, lambda e: e["code"].rlike(r"^[A-Z0-9/]+$"))
    # a repeated code keeps its last description (dictionary semantics)
    entries = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))),
                                                        lambda x: x["code"] == e["code"]))
    c6 = _cells(_line(F.col("lines"), 6))
    year = F.try_element_at(F.filter(F.transform(c6, lambda x: strip(x)), lambda x: x.rlike(r"^\d{4}$")),
                            F.lit(1)).cast("int")
    header = _cells(_line(F.col("lines"), 8))
    f = f.select("file", "lines", month_cell.alias("month_cell"), du.alias("du"),
                 F.map_from_entries(entries).alias("codes"), year.alias("year"), header.alias("header"))
    f = f.withColumn("total_idx", F.array_position("header", "Total days").cast("int")).withColumn(
        "missing_idx", F.array_position("header", "Missing time/h").cast("int"))
    days = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size("header"), F.lit(1))),
                                lambda i: F.struct(i.alias("col"), strip(F.element_at(F.col("header"), i)).alias("h"))),
                    lambda d: d["h"].rlike(r"^\d+$"))
    f = f.withColumn("days", days)
    # employee lines: from line 9 up to the first total line
    body = F.slice(F.col("lines"), 9, F.greatest(F.size("lines") - 8, F.lit(1)))
    first_cells = F.transform(body, lambda ln: F.lower(strip(F.element_at(_cells(ln), 1))))
    stop_label = F.concat(F.lower(F.col("month_cell")), F.lit(" total"))
    stop = F.array_position(F.transform(first_cells, lambda x: (x == stop_label) | (x == "absence type key total")),
                            True).cast("int")
    kept = F.when(stop > 0, F.slice(body, 1, stop - 1)).otherwise(body)
    f = f.withColumn("body", kept)
    emp = f.select("file", "month_cell", "du", "codes", "year", "total_idx", "missing_idx", "days",
                   F.posexplode("body").alias("pos", "line"))
    emp = emp.withColumn("cells", _cells(F.col("line"))).where(strip(F.element_at("cells", 1)) != "")
    total_txt = strip(F.try_element_at("cells", F.col("total_idx")))
    miss_txt = F.regexp_replace(strip(F.try_element_at("cells", F.col("missing_idx"))), "h+$", "")
    emp = emp.select(
        "file", (F.col("pos") + 9).alias("line_no"), month_number("month_cell").alias("month"), "du", "codes",
        "year", strip(F.element_at("cells", 1)).alias("employee_name"),
        F.when(total_txt.rlike(r"^\d+$"), total_txt.cast("int")).alias("total_missing_days"),
        F.when((F.col("missing_idx") > 0) & miss_txt.rlike(r"^\d+$"), miss_txt.cast("int")).alias("missing_time"),
        "cells", "days")
    out = emp.select("*", F.posexplode("days").alias("day_pos", "d"))
    code = strip(F.try_element_at("cells", F.col("d.col")))
    code = F.when(code != "", code)
    return out.select(
        "file", "line_no", "day_pos", "month", "du", code.alias("absence_code"),
        F.try_element_at("codes", code).alias("absence_description"),
        F.col("d.h").cast("int").alias("day"), "year", "employee_name", "total_missing_days", "missing_time")
