"""Report rows as ordered text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftwise.operators.windows import global_rank
from shiftwise.sources.sinks import report_lines

# The texts of the reports.
MISSED_TITLE = "Training “%s”"
MISSED_HEAD = f"{'Employee':30}       Code            Reason"
NOBODY_MISSED = "No employee missed the training"
SESSION_LINES = ("Data: %s", "Inceput la ora: %s", "Finalizat la ora: %s", "Numar participanti: %s")
PERIOD = "A înregistrat în perioada %s - %s %s ore."
OVERTIME = "A avut ore suplimentare în numar de: %s ore."
VACATION = "A avut concediu în numar de: %s ore."
ATTENDED = "A participat la trainingurile:"
BULLET = "• %s"
MISSED = "A lipsit de la trainingul %s din motivul că a avut codul %s."


def _wide(text: Column, width: int) -> Column:
    """Padded to ``width`` characters at least, never cut."""
    return F.rpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))


def missed_lines(sessions: DataFrame, missed: DataFrame, session: str) -> DataFrame:
    """(session, line_no, line) of every session; ``missed`` has session, name, code and description.

    The rows of a report are numbered by a distributed rank, so a session that
    most employees missed is not one task.
    """
    ranked = global_rank(missed.select(session, "name", "code", "description"), [session, "name", "code", "description"], "row_number", "_row")
    first = ranked.groupBy(F.col(session).alias("_s")).agg(F.min("_row").alias("_first"))
    text = F.concat(_wide(F.col("name"), 30), F.lit("  "), _wide(F.col("code"), 4), F.lit("  "), F.col("description"))
    body = ranked.join(first, F.col(session) == F.col("_s")).select(session, (F.col("_row") - F.col("_first") + 5).cast("long").alias("line_no"), text.alias("line"))
    heads = sessions.select(session).distinct().join(first, F.col(session) == F.col("_s"), "left")
    some = F.col("_first").isNotNull()
    head = F.array(F.format_string(MISSED_TITLE, F.col(session)), F.lit(""), F.when(some, MISSED_HEAD).otherwise(NOBODY_MISSED), F.when(some, "-" * 70))
    return report_lines(heads, [session], [head]).select(session, F.col("line_no").cast("long").alias("line_no"), "line").unionByName(body)


def session_lines(sessions: DataFrame, name: str, date: str, start: str, end: str, participants: str) -> DataFrame:
    """R2: (name, line_no, line) of every session."""
    told = [F.format_string(t, F.col(x).cast("string")) for t, x in zip(SESSION_LINES, (date, start, end, participants), strict=True)]
    return report_lines(sessions, [name], [F.array(F.concat(F.lit(" " * 28 + "~ "), F.col(name), F.lit(" ~")), F.lit(""), *told)])


def missed_trainings(sessions: DataFrame, absences: DataFrame, person: str, day: str, session: str, code: str) -> DataFrame:
    """(person, session, code) of absences on the day of a session."""
    return absences.join(sessions.select(day, session), day).select(person, session, code).distinct()


def activity_lines(activity: DataFrame, missed: DataFrame, person: str, name: str, start: str, end: str) -> DataFrame:
    """(person, line_no, line); ``activity`` has worked, overtime and vacation hours and the sessions attended ("a; b").

    Lines of hours that are 0 are left out; the list of missed trainings has one
    entry for each session and code, so it is bounded by the calendar.
    """
    lists = missed.groupBy(F.col(person).alias("_p")).agg(F.sort_array(F.collect_set(F.struct("session", "code"))).alias("_missed"))
    rows = activity.join(lists, F.col(person) == F.col("_p"), "left")

    def hours(text: str, col: str) -> Column:
        return F.when(F.col(col) > 0, F.format_string(text, F.col(col).cast("string")))

    attended = F.when(F.coalesce(F.col("sessions"), F.lit("")) != "", F.concat(F.array(F.lit(ATTENDED)), F.transform(F.split("sessions", "; "), lambda s: F.format_string(BULLET, s))))
    absent = F.transform("_missed", lambda m: F.format_string(MISSED, m["session"], m["code"]))
    none = F.array().cast("array<string>")
    first = F.array(F.col(name), F.format_string(PERIOD, F.lit(start), F.lit(end), F.col("worked_hours").cast("string")), hours(OVERTIME, "overtime_hours"), hours(VACATION, "vacation_hours"))
    return report_lines(rows, [person], [first, F.coalesce(attended, none), F.coalesce(absent, none)])
