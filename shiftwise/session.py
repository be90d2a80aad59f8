"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on.  AQE re-plans joins and coalesces shuffle
# partitions from runtime statistics; skew-join splitting handles hot keys in
# sort-merge joins; UTC keeps timestamp arithmetic independent of the host.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # checkpoints of finished queries are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


_shipped: set[str] = set()
_ship_lock = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Make ``shiftwise`` importable in the Python workers (``--py-files`` equivalent).

    Pandas UDFs pickle references to module-level helpers, so executors must
    be able to import the package.  A zip of the package is added once per
    application with ``addPyFile``; Spark's file server distributes it to
    every executor, including ones started later.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    with _ship_lock:
        if app in _shipped:
            return
        pkg = os.path.dirname(os.path.abspath(__file__))
        out = os.path.join(tempfile.mkdtemp(prefix="shiftwise-pyfiles-"), "shiftwise.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for root, _, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(root, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
        sc.addPyFile(out)
        _shipped.add(app)


def get_spark(app: str = "shiftwise", master: str | None = None,
              shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    """Return the active session or build one with the defaults above."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    On a cluster this is ``spark.checkpoint.dir`` as configured by the
    operator (a shared file system).  Only when it is unset - local tests - a
    fresh temporary folder is created and registered.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="shiftwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def staging_path(spark: SparkSession, name: str) -> str:
    """A location under the shared checkpoint folder for a staged table."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "staged", name)
