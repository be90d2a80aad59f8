"""Scans of the layer tables.

Tables are Parquet; Spark pushes filters and column pruning into the scan, so
callers select only the columns they need and filter as early as they like.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, base: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan ``<base>/<name>.parquet`` (file or folder), or else the folder ``<base>/<name>``."""
    try:
        df = spark.read.parquet(os.path.join(base, f"{name}.parquet"))
    except AnalysisException as e:  # asked of the file system that holds it
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.read.parquet(os.path.join(base, name))
    return df.select(*columns) if columns else df


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something under ``path``, asked of the file system that Spark reads it from."""
    try:
        spark.read.schema("x int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def write_table(df: DataFrame, base: str, name: str, mode: str = "append",
                partition_by: list[str] | None = None) -> str:
    """Append (or overwrite) a layer table; returns its path."""
    path = os.path.join(base, name)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


class Tables:
    """Lazy accessor: ``t = Tables(spark, sf_dir); t.orders``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base

    def __getattr__(self, name: str) -> DataFrame:
        if name in TEST_TABLES:
            return read_table(self.spark, self.base, name)
        raise AttributeError(name)


LABELLED_SCHEMA = "id string, text string, author string"


def read_labelled_csv(spark: SparkSession, path: str, schema: str = LABELLED_SCHEMA) -> DataFrame:
    """CSV with a header (id, text, label); quoted multi-line texts allowed."""
    return (spark.read.option("header", True).option("multiLine", True).option("quote", '"')
            .option("escape", '"').schema(schema).csv(path))
