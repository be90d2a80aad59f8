"""Request events as a stream (Kafka topic or a folder of JSON files).

The Kafka connector jar is not part of a plain PySpark install, so the file
source is the default; ``format="kafka"`` with the usual options works where
the connector is on the class path.  Both directions are checkpointed so a
restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("operation", T.StringType()),
    T.StructField("input", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("result", T.StringType()),
])


def read_request_stream(spark: SparkSession, path: str | None = None, *, fmt: str = "json",
                        options: dict | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of ``operation, input, result`` events."""
    if fmt == "kafka":
        df = spark.readStream.format("kafka").options(**(options or {})).load()
        return df.select(F.from_json(F.col("value").cast("string"), EVENT_SCHEMA).alias("e")).select("e.*")
    reader = spark.readStream.schema(EVENT_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.options(**(options or {})).load(path)


def write_request_stream(events: DataFrame, checkpoint: str, path: str | None = None, *, fmt: str = "json",
                         options: dict | None = None, trigger: dict | None = None):
    """Serialize events as JSON and append them (exactly once per checkpoint)."""
    if fmt == "kafka":
        out = events.select(F.to_json(F.struct(*events.columns)).alias("value"))
        w = out.writeStream.format("kafka").options(**(options or {}))
    else:
        w = events.writeStream.format(fmt).option("path", path)
    w = w.option("checkpointLocation", checkpoint).outputMode("append")
    if trigger:
        w = w.trigger(**trigger)
    return w.start()
