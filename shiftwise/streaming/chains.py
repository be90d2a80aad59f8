"""Chains of events in time, without walking a key in one task.

A rule whose outcome feeds back into its state ("a refused send does not
restart the cooldown") moves from one event that changes the state to the next
one.  That next event - the first one at least so long after - is a pointer
that needs no state, so all pointers are found at once:

* ``first_after``: windows over (key, time bucket), never over a key's
  events; where a bucket has no such event, it is the first of the key's next
  bucket that has any, from a table with one row a bucket;
* ``reached``: which events lie on a chain from its starts, by pointer doubling
  (after i rounds the first 2**i events of each chain are known), so a chain of
  n events takes log2(n) joins, whatever share of the rows its key holds.

Rows are told apart by ``Event`` structs (microseconds, tie breaker, row id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftwise.session import checkpoint_dir

#: Microseconds in a second.
SECOND = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall-clock time, independent of the session time zone."""
    whole = F.datediff(F.to_date(ts), F.to_date(F.lit("1970-01-01"))).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    return whole * SECOND + F.round(F.extract(F.lit("SECOND"), ts) * SECOND).cast("long")


def bucket(us: Column, width: int) -> Column:
    """The bucket of ``width`` microseconds that a time lies in."""
    return F.floor(us / F.lit(width)).cast("long") if width > 1 else us


def numbered(df: DataFrame, key: str, ts: str, tiebreak: str) -> DataFrame:
    """``df`` with ``_k`` (key) and ``_e`` (Event); checkpointed, so that row ids stay the same when tasks run again."""
    checkpoint_dir(df.sparkSession)
    event = F.struct(micros(F.col(ts)).alias("us"), F.col(tiebreak).alias("tie"), F.monotonically_increasing_id().alias("id"))
    return df.withColumn("_k", F.col(key)).withColumn("_e", event).checkpoint(eager=True)


def same_key(a: str, b: str = "_k") -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def first_after(events: DataFrame, width: int) -> DataFrame:
    """(id, next): for each event of ``events`` (_k, _e) the key's first one ``width`` microseconds later or more."""
    b = bucket(F.col("_e.us"), width)
    asked = events.select("_k", (b + 1).alias("_b"), (F.col("_e.us") + width).alias("_t"), F.col("_e.id").alias("id"), F.lit(None).cast(events.schema["_e"].dataType).alias("_c"))
    there = events.select("_k", b.alias("_b"), F.col("_e.us").alias("_t"), F.lit(None).cast("long").alias("id"), F.col("_e").alias("_c"))
    # latest first, an event before a question of the same time: the last event seen is the first one not earlier
    order = Window.partitionBy("_k", "_b").orderBy(F.desc("_t"), F.desc_nulls_last("_c"))
    inside = asked.unionByName(there).withColumn("_n", F.last("_c", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("id").isNotNull())
    by_bucket = Window.partitionBy("_k").orderBy("_b")
    buckets = events.groupBy("_k", b.alias("_b")).agg(F.min("_e").alias("_f"))
    further = F.when(F.lead("_b").over(by_bucket) > F.col("_b") + 1, F.lead("_f").over(by_bucket)).otherwise(F.lead("_f", 2).over(by_bucket))
    further = buckets.select(F.col("_k").alias("_fk"), (F.col("_b") + 1).alias("_fb"), further.alias("_further"))
    return inside.join(further, same_key("_fk") & (F.col("_b") == F.col("_fb")), "left").select("id", F.coalesce("_n", "_further").alias("next"))


def following(events: DataFrame, width: int, n: int) -> DataFrame:
    """``events`` (_k, _e) with ``previous`` (the event just before) and ``then`` (the next ``n``), in order of ``_e``.

    Windows lie inside buckets of ``width`` microseconds; a bucket's neighbours
    add what is needed across its edges.
    """
    b = bucket(F.col("_e.us"), width)
    rows = events.select("_k", "_e", b.alias("_b"))
    order = Window.partitionBy("_k", "_b").orderBy("_e")
    inside = rows.withColumn("_row", F.row_number().over(order)).withColumn("_lag", F.lag("_e").over(order))
    leads = F.array(*(F.lead("_e", i + 1).over(order) for i in range(n))) if n else F.slice(F.array("_e"), 1, 0)
    inside = inside.withColumn("_leads", F.filter(leads, lambda x: x.isNotNull()))
    heads = inside.where(F.col("_row") <= max(n, 1)).groupBy("_k", "_b").agg(F.sort_array(F.collect_list("_e")).alias("_heads"))
    last = rows.groupBy("_k", "_b").agg(F.max("_e").alias("_last"))
    by_bucket = Window.partitionBy("_k").orderBy("_b")
    both = heads.join(last.select(F.col("_k").alias("_lk"), F.col("_b").alias("_lb"), "_last"), same_key("_lk") & (F.col("_b") == F.col("_lb"))).drop("_lk", "_lb")
    empty = F.slice("_heads", 1, 0)
    after = [F.coalesce(F.lead("_heads", i + 1).over(by_bucket), empty) for i in range(n)]
    edges = both.select(F.col("_k").alias("_ek"), F.col("_b").alias("_eb"), F.lag("_last").over(by_bucket).alias("_before"), (F.concat(*after) if n else empty).alias("_after"))
    out = inside.join(edges, same_key("_ek") & (F.col("_b") == F.col("_eb")))
    then = F.slice(F.concat("_leads", "_after"), 1, n) if n else F.col("_after")
    return out.select("_k", "_e", F.coalesce("_lag", "_before").alias("previous"), then.alias("then"))



def reached(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """(id): the ids of ``starts`` (id, unique) and all that ``pointers`` (id, next) lead to from them.

    Chains of different starts may meet; each id is returned once.
    """
    spark = pointers.sparkSession
    checkpoint_dir(spark)
    jump = pointers.where(F.col("next").isNotNull()).select("id", "next").checkpoint(eager=True)
    found = starts.select("id").distinct().checkpoint(eager=True)
    while True:
        step = found.join(jump, "id").select(F.col("next").alias("id"))
        more = step.distinct().join(found, "id", "left_anti").checkpoint(eager=True)
        if more.isEmpty():
            return found
        found = found.unionByName(more).checkpoint(eager=True)
        onward = jump.select(F.col("id").alias("next"), F.col("next").alias("_to"))
        jump = jump.join(onward, "next").select("id", F.col("_to").alias("next")).checkpoint(eager=True)
