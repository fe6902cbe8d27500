"""Stored graphs, scorers and training metrics."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinedge.scratch import swept

METRIC_SCHEMA = "run_id string, epoch int, split string, metric string, value double"
COMMIT_SCHEMA = "version bigint, folder string"
SET_ASIDE = "set_aside"
"""Column of a node table with the text of a line that is no node, or else null."""


# ---- processed graph -----------------------------------------------------

class GraphStore:
    """A graph as Parquet tables in versioned folders.

    A version counts only once its line is in the commit table, which is
    appended after all its tables are complete; a half-written graph is
    therefore never taken for a stored one. :meth:`expire` removes old versions,
    but none that a reader holds a lease on (:meth:`reading`).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _latest(self) -> tuple[int, str] | None:
        try:
            commits = self.spark.read.schema(COMMIT_SCHEMA).json(f"{self.root}/commits")
            row = commits.agg(F.max("version").alias("v"), F.max_by("folder", "version").alias("f")).first()
        except AnalysisException:
            return None
        return None if row["v"] is None else (row["v"], row["f"])

    def has_graph(self) -> bool:
        return self._latest() is not None

    def save(
        self, nodes: Mapping[str, DataFrame], edges: DataFrame, reports: Mapping[str, DataFrame] | None = None, draft: str | None = None
    ) -> None:
        """Store and commit a version. With ``draft``, a path of :meth:`draft`, the
        build has written the ``nodes`` there (:func:`nodes_path`)."""
        latest = self._latest()
        folder = (draft or self.draft()).rsplit("/", 1)[1]
        with swept(self.spark):
            if not draft:
                for ntype, table in nodes.items():
                    table.write.parquet(nodes_path(f"{self.root}/{folder}", ntype))
            # few files per type, and a type with most of the edges is split
            edges.hint("rebalance", "etype").write.partitionBy("etype").parquet(f"{self.root}/{folder}/edges")
            for name, table in (reports or {}).items():
                table.write.parquet(f"{self.root}/{folder}/report_{name}")
        version = latest[0] + 1 if latest else 0
        self.spark.createDataFrame([(version, folder)], COMMIT_SCHEMA).coalesce(1).write.mode("append").json(
            f"{self.root}/commits"
        )

    def draft(self) -> str:
        """The path of a folder for a version that is not committed yet."""
        return f"{self.root}/graph-{uuid.uuid4().hex}"

    def _folder(self) -> str:
        latest = self._latest()
        if latest is None:
            raise FileNotFoundError(f"no graph is stored in {self.root}")
        return f"{self.root}/{latest[1]}"

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder()}/{name}")

    def edges(self) -> DataFrame:
        return self._table("edges")

    def nodes(self, ntype: str) -> DataFrame:
        table = self.spark.read.parquet(nodes_path(self._folder(), ntype))
        return table.where(F.col(SET_ASIDE).isNull()).drop(SET_ASIDE) if SET_ASIDE in table.columns else table

    def report(self, name: str) -> DataFrame:
        """A table that was stored with the graph, such as ``drops``."""
        return self._table(f"report_{name}")

    def bucketed(self, name: str, key: str, build: Callable[[], DataFrame] | None = None, buckets: int | None = None) -> DataFrame:
        """A table kept with the stored version, bucketed and sorted by ``key``;
        built on first use. Two tables with as many buckets, one joined by
        its key with the other's, meet without an exchange.

        ``buckets`` is that of the session's shuffles if it is not given; a table
        that is there keeps its own.
        """
        path = f"{self._folder()}/bucketed_{name}"
        fs, done = _filesystem(self.spark, f"{path}/described")
        if not fs.exists(done):
            if build is None:
                raise FileNotFoundError(f"no table {name} is stored in {self.root}")
            table = build()
            n = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            data = f"data-{uuid.uuid4().hex}"
            draft = f"draft_{uuid.uuid4().hex}"
            # as many files as buckets: each task writes the buckets it holds whole
            spread = table.repartition(n, key)
            with swept(self.spark):
                spread.write.bucketBy(n, key).sortBy(key).format("parquet").option("path", f"{path}/{data}").saveAsTable(draft)
            self.spark.sql(f"DROP TABLE {draft}")  # the name; the files stay
            about = [(data, n, key, table.schema.json())]
            try:
                stream = fs.create(done, False)
            except Py4JJavaError:
                if not fs.exists(done):
                    raise  # another writer was first: its table stands
            else:
                stream.writeUTF("\n".join(map(str, about[0])))
                stream.close()
        return self._open_bucketed(path)

    def _open_bucketed(self, path: str) -> DataFrame:
        fs, done = _filesystem(self.spark, f"{path}/described")
        stream = fs.open(done)
        data, n, key, schema = stream.readUTF().split("\n", 3)
        stream.close()
        columns = T.StructType.fromJson(json.loads(schema))
        name = "stored_" + hashlib.md5(f"{path}/{data}".encode()).hexdigest()
        if not self.spark.catalog.tableExists(name):
            listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.fields)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({listed}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {n} BUCKETS LOCATION '{path}/{data}'")
        return self.spark.table(name)

    @contextmanager
    def reading(self) -> Iterator[int]:
        """Hold a lease on the latest version, which keeps it from expiring;
        gives its number."""
        latest = self._latest()
        if latest is None:
            raise FileNotFoundError(f"no graph is stored in {self.root}")
        fs, lease = _filesystem(self.spark, f"{self.root}/leases/{latest[1]}/{uuid.uuid4().hex}")
        fs.create(lease, False).close()
        try:
            yield latest[0]
        finally:
            fs.delete(lease, False)

    def expire(self, keep: int = 1, lease_hours: float = 24.0) -> list[str]:
        """Remove the folders of all but the last ``keep`` versions, and what
        builds that were cut off have left; returns their names.

        A folder with a lease stays, unless the lease is older than
        ``lease_hours``; so does an uncommitted one that is younger than that,
        as it may be being written.
        """
        if keep < 1:
            raise ValueError("the latest version cannot expire")
        commits = {r["folder"]: r["version"] for r in self.spark.read.schema(COMMIT_SCHEMA).json(f"{self.root}/commits").collect()} if self.has_graph() else {}
        kept = set(sorted(commits, key=commits.get)[-keep:])
        fs, root = _filesystem(self.spark, self.root)
        old = (time.time() - 3600 * lease_hours) * 1000
        gone = []
        for status in fs.listStatus(root) if fs.exists(root) else []:
            name = status.getPath().getName()
            if not name.startswith("graph-") or name in kept:
                continue
            _, leases = _filesystem(self.spark, f"{self.root}/leases/{name}")
            held = fs.exists(leases) and any(s.getModificationTime() > old for s in fs.listStatus(leases))
            if held or (name not in commits and status.getModificationTime() > old):
                continue
            fs.delete(status.getPath(), True)
            fs.delete(leases, True)
            gone.append(name)
        return sorted(gone)

    def load_or_build(self, build, force_reload: bool = False, drafted: bool = False) -> GraphStore:
        """Build and store the graph unless one is stored; ``build()`` returns
        ``(nodes, edges)`` or ``(nodes, edges, reports)``. A ``drafted`` one gets a path
        of :meth:`draft`, to write the nodes to as it makes them."""
        if force_reload or not self.has_graph():
            if not drafted:
                self.save(*build())
                return self
            path = self.draft()
            try:
                self.save(*build(path), draft=path)
            except BaseException:
                fs, folder = _filesystem(self.spark, path)
                fs.delete(folder, True)
                raise
        return self


def nodes_path(folder: str, ntype: str) -> str:
    return f"{folder}/nodes_{ntype}"


# ---- trained scorers -----------------------------------------------------

def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_model(model, root: str, epoch: int) -> str:
    """Save under ``<class>-epoch<n>``; others stay."""
    path = f"{root}/{type(model).__name__}-epoch{epoch}"
    model.write().overwrite().save(path)
    return path


def save_model(spark: SparkSession, model, root: str, epoch: int, written: bool = False) -> str:
    """Save under ``<class>-epoch<n>``, then delete the older ones of that class.

    In this order a crash leaves one model too many, never none. ``written``
    says that :func:`write_model` has saved it before.
    """
    prefix = f"{type(model).__name__}-epoch"
    path = f"{root}/{prefix}{epoch}" if written else write_model(model, root, epoch)
    fs, folder = _filesystem(spark, root)
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith(prefix) and name != f"{prefix}{epoch}":
            fs.delete(status.getPath(), True)
    return path


def stored_models(spark: SparkSession, root: str) -> list[str]:
    """Names of the stored models, by class and then by epoch number."""
    fs, folder = _filesystem(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(names, key=lambda n: (n.rpartition("epoch")[0], int(n.rpartition("epoch")[2]) if n.rpartition("epoch")[2].isdigit() else -1))


# ---- training metrics ----------------------------------------------------

def append_metrics(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Append ``(run_id, epoch, split, metric, value)`` rows, a few per epoch."""
    spark.createDataFrame(rows, METRIC_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def training_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).parquet(path)
