"""Session settings the operators are written for."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark import SparkContext
from pyspark.sql import SparkSession

# Runtime SQL settings only, so they can also be applied to a session that a
# cluster hands over. Skewed join partitions are split by AQE even where that
# costs one more shuffle: one key may hold a third of all rows.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # vector means keep one buffer per group; the default of 128 groups would
    # send nearly every map task through the sort-based fallback
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


# Batches that Python workers get are cut by bytes as well as by rows, as a text
# may be long; the size changes no result.
BATCH_CONF = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}

_shipped: SparkContext | None = None


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable on the executors, once per context, and
    bound the bytes of the batches that its functions get.

    Spark hands the archive to every executor, so the Python workers need
    neither a shared folder nor this folder as their working directory.
    """
    global _shipped
    if _shipped is not spark.sparkContext:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(), "twinedge"), "zip", os.path.dirname(package), os.path.basename(package)
        )
        spark.sparkContext.addPyFile(archive)
        _shipped = spark.sparkContext
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and ship the package.

    Only settings that the operators need for right results or for skew are
    set; other settings of the session stay as they are.
    """
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return ship(spark)


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and for the bench on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("twinedge")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="twinedge-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
