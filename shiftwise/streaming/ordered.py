"""Per-key state on a stream, rows in event-time order, state that expires.

A step function takes a key's state and its next row and returns the new state
and what to add to the row.  ``in_order`` runs it with ``transformWithState``:

* rows that arrive in any order are held in list state until the watermark has
  passed them, so a step sees each row after all earlier ones, whichever
  micro-batch brought it;
* one event-time timer a key fires when its next held row is due, or, with
  none held, when the state has expired and is dropped;
* state and held rows live in the state store, so a lost executor resumes from
  the last checkpoint of the query.

The state is a row of plain columns; times are whole microseconds.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from shiftwise.session import ship_package

#: The state store that ``transformWithState`` needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_US = "_us"


#: A held row in the state store: its time, and its values, pickled, so that nulls and lists stay what they are.
HELD = T.StructType([T.StructField("us", T.LongType()), T.StructField("row", T.BinaryType())])


def plain(x, kind: T.DataType | None = None):
    """A value of a pandas frame as Python has it: missing ones are None, whole numbers ints."""
    if isinstance(x, (list, tuple, dict, str)) or x is None:
        return x
    if hasattr(x, "tolist") and getattr(x, "ndim", 0):
        return x.tolist()
    if pd.isna(x):
        return None
    return int(x) if isinstance(kind, T.IntegralType) else x.item() if hasattr(x, "item") else x


class InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then takes the steps of those due."""

    def __init__(self, step: Callable, rows: T.StructType, places: list[int], state: T.StructType, out: T.StructType, tie: str, lives_us: Callable | None):
        self.step, self.rows, self.places, self.state_schema, self.out, self.tie, self.lives_us = step, rows, places, state, out, tie, lives_us

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)
        self.state = handle.getValueState("state", self.state_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        us = [f.name for f in self.rows.fields].index(_US)
        # by place: Spark renames columns that begin with an underscore
        new = [tuple(plain(x, f.dataType) for x, f in zip(row, self.rows.fields, strict=True)) for pdf in rows for row in zip(*(pdf.iloc[:, i] for i in self.places), strict=True)]
        if new:
            self.held.appendList([(r[us], pickle.dumps(r)) for r in new])
            self._wake(min(r[us] for r in new))
        return iter(())

    def _wake(self, us: int, firing: int | None = None) -> None:
        """Have the timer fire no later than when ``us`` is due; the key has one timer, beside the one that is ``firing``."""
        at = us // 1000 + 1
        timers = [x[0] if isinstance(x, (tuple, list)) else x for x in self.handle.listTimers()]
        timers = [x for x in timers if x != firing]
        if not timers or at < min(timers):
            for x in timers:
                self.handle.deleteTimer(x)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        names = [f.name for f in self.rows.fields]
        us, tie = names.index(_US), names.index(self.tie)
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = [pickle.loads(bytes(r[1])) for r in self.held.get()] if self.held.exists() else []
        due = sorted((r for r in held if r[us] < mark), key=lambda r: (r[us], r[tie] is not None, r[tie]))
        later = [r for r in held if r[us] >= mark]
        state = tuple(plain(x, f.dataType) for x, f in zip(self.state.get(), self.state_schema.fields, strict=True)) if self.state.exists() else None
        done = []
        for row in due:
            record = dict(zip(names, row, strict=True))
            state, found = self.step(state, record)
            if found is not None:
                done.append({**record, **found})
        if due:
            self.held.clear()
            if later:
                self.held.put([(r[us], pickle.dumps(r)) for r in later])
        ends = self.lives_us(state) if self.lives_us and state is not None else None
        if state is not None and not later and ends is not None and ends < mark:
            self.state.clear()
            state = None
        elif state is not None and due:
            self.state.update(state)
        firing = expiredTimerInfo.getExpiryTimeInMs()
        if later:
            self._wake(min(r[us] for r in later), firing)
        elif state is not None and ends is not None:
            self._wake(max(ends, mark), firing)
        if done:
            columns = [f.name for f in self.out.fields]
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in done], dtype=object) for c in columns})

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, ts: str, tie: str, step: Callable, state: str, adds: str, watermark: str, lives_us: Callable | None = None) -> DataFrame:
    """The rows of a stream with the columns ``adds`` (DDL) that ``step`` gives them, in event-time order by key.

    ``state`` is the DDL of the state, a tuple for the step.  ``lives_us`` tells
    from a state until when (microseconds) it matters; later it is dropped.
    A step may return None for a row that gives none.  Rows later than the
    watermark are dropped by Spark; a row is handed on once the watermark has passed it.
    """
    ship_package(rows.sparkSession)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    held = timed.withColumn(_US, F.unix_micros(ts))
    kept = T.StructType([f for f in held.schema.fields if f.name != ts])
    out = T.StructType([*kept.fields, *T.StructType.fromDDL(adds).fields])
    places = [held.columns.index(f.name) for f in kept.fields]
    processor = InOrder(step, kept, places, T.StructType.fromDDL(state), out, tie, lives_us)
    found = held.groupBy(key).transformWithStateInPandas(processor, out, "Append", "EventTime")
    names = [*(F.timestamp_micros(_US).alias(n) if n == ts else F.col(n) for n in rows.columns), *(F.col(f.name) for f in T.StructType.fromDDL(adds).fields)]
    return found.select(*names)
