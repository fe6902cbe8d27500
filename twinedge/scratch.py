"""Tables written to cut lineage, in the shared folder the cluster names."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or a folder in the warehouse.

    Both are places that the driver and all executors share, whatever the
    master is; a machine-local temporary folder is not.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir')}/twinedge-scratch").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_sweeping: dict[str, tuple[int, str | None]] = {}
_sweeping_lock = threading.Lock()


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of the writes within as soon as each is done, not
    when the driver happens to collect its garbage. Threads may be within at a time."""
    key = spark._jsparkSession.sessionUUID()
    with _sweeping_lock:
        within, before = _sweeping.get(key, (0, None))
        if not within:
            before = spark.conf.get(SWEEP, None)
            spark.conf.set(SWEEP, "true")
        _sweeping[key] = within + 1, before
    try:
        yield
    finally:
        with _sweeping_lock:
            within, before = _sweeping.pop(key)
            if within > 1:
                _sweeping[key] = within - 1, before
            elif before is None:
                spark.conf.unset(SWEEP)
            else:
                spark.conf.set(SWEEP, before)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and go on from the written table; it is one of the scratch
    folder, or at ``path``."""
    return materialise_counted(df, name, path)[0]


def materialise_counted(df: DataFrame, name: str, path: str | None = None) -> tuple[DataFrame, int]:
    """As :func:`materialise`, with the number of rows counted by the same job.

    Parquet rather than an RDD checkpoint: it is columnar and compressed, it
    survives lost executors, and the optimizer sees its true size, so later
    joins broadcast it only when it is really small.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    seen = Observation()
    with swept(spark):
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    rows = seen.get.get("rows")
    # a plan that AQE proves empty reports no metrics
    return table, int(rows) if rows is not None else table.count()


def at_once(builds: Mapping[str, Callable[[], DataFrame]]) -> dict[str, DataFrame]:
    """Run independent builds that start jobs side by side, so that a small one
    does not leave the executors idle."""
    with ThreadPoolExecutor(len(builds)) as pool:
        running = {name: pool.submit(build) for name, build in builds.items()}
        return {name: build.result() for name, build in running.items()}


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that :func:`materialise` wrote.

    Only for tables that nothing lazy still reads.
    """
    for table in tables:
        spark = table.sparkSession
        root = scratch_root(spark).split("://")[-1]
        for file in table.inputFiles():
            folder = file.rsplit("/", 1)[0]
            if root in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
                break
