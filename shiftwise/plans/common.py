"""Small helpers shared by the driver query plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(name: str) -> Column:
    return F.col(name)


def money(col: Column | str) -> Column:
    """Decimal value (exact arithmetic) exposed as double in results."""
    x = F.col(col) if isinstance(col, str) else col
    return x.cast("double")


def day_text(col: Column | str) -> Column:
    x = F.col(col) if isinstance(col, str) else col
    return F.date_format(x, "yyyy-MM-dd")


def ts_text(col: Column | str) -> Column:
    x = F.col(col) if isinstance(col, str) else col
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss")


def ts_range(col: str, start: str, end: str) -> Column:
    """Half-open timestamp range; stays a pushable Parquet predicate."""
    return (F.col(col) >= F.lit(start).cast("timestamp_ntz")) & (F.col(col) < F.lit(end).cast("timestamp_ntz"))
