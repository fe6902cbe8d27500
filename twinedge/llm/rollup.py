"""Operator 7, token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are never recounted. A batch
brings signed changes: an insert adds a document's count, a delete subtracts
it, a revised count subtracts the old and adds the new one. The changes of a
batch are added up per key and written as one small table named by the batch.
Totals are the sum of the committed batches.

A batch's table is written to a folder of its own; the batch commits by a small
file that names the folder and is created without overwriting. So of two writers
of one batch one commits, and a batch may be sent again after any failure and
counts once. ``compact`` folds the batches it has listed into one table that
remembers their names, so the cost of reading does not grow with their number;
what is committed meanwhile stays a batch.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinedge.llm.tokens import tokenizer
from twinedge.llm.words import map_slices

KEY = ("source", "lang", "tokenizer")
SCHEMA = T.StructType(
    [*(T.StructField(k, T.StringType()) for k in KEY), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())]
)


def document_counts(docs: DataFrame, version: str, file: str | None = None) -> DataFrame:
    """``(doc_id, source, lang, text_hash, tokenizer, n_tokens)``, a row per input row.

    A null text has no tokens; null or missing sources and languages are null,
    which is a key like any other; other columns are ignored.
    """
    text = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text("source").alias("source"), text("lang").alias("lang"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"), F.col("text").cast("string").alias("text"),
    )

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = tokenizer(file).counts(batch.column("text"))
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "source", "lang", "text_hash")), pa.array(np.asarray(counts, np.int64))],
            names=["doc_id", "source", "lang", "text_hash", "n_tokens"],
        )

    counted = map_slices(rows, work, "doc_id long, source string, lang string, text_hash long, n_tokens long")
    return counted.withColumn("tokenizer", F.lit(version))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEY, F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").cast("long").alias("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEY, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).cast("long").alias("n_tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed counts or keys of documents: the old row out, the new one in."""
    return deletes(before).unionByName(inserts(after))


class Rollup:
    """Totals kept in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._file(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        where = self._file(f"{self.path}/{folder}")
        found = self._fs.listStatus(where) if self._fs.exists(where) else []
        return sorted(x.getPath().getName() for x in found if x.getLen() and not x.getPath().getName().startswith("."))

    def _named(self, file: str) -> str:
        stream = self._fs.open(self._file(f"{self.path}/{file}"))
        try:
            return f"{self.path}/{stream.readUTF()}"
        finally:
            stream.close()

    def _publish(self, folder: str, file: str) -> bool:
        """Let ``file`` name ``folder``; False if another writer was first."""
        target = self._file(f"{self.path}/{file}")
        if self._fs.exists(target) and not self._fs.getFileStatus(target).getLen():
            self._fs.delete(target, False)  # cut off before it named anything
        try:
            stream = self._fs.create(target, False)
        except Py4JJavaError:
            if self._fs.exists(target):
                return False
            raise
        try:
            stream.writeUTF(folder)
        finally:
            stream.close()
        return True

    def _folded(self) -> tuple[str | None, DataFrame | None]:
        """The newest compacted table and the names of the batches in it."""
        tables = self._names("compacted")
        if not tables:
            return None, None
        folder = self._named(f"compacted/{tables[-1]}")
        return f"{folder}/totals", self.spark.read.schema("batch string").parquet(f"{folder}/batches")

    def _open(self) -> tuple[list[str], str | None, DataFrame | None]:
        """Committed batches that are not folded yet, and what is folded."""
        # batches first: one that is folded and dropped after this listing is in
        # the compacted table that is looked up next
        names = self._names("batches")
        base, folded = self._folded()
        if folded is not None and names:
            listed = self.spark.createDataFrame([(n,) for n in names], "batch string")
            names = sorted(r["batch"] for r in listed.join(folded, "batch", "left_anti").collect())
        return names, base, folded

    def batches(self) -> DataFrame:
        """``(batch)``: the name of every batch that counts."""
        _, folded = self._folded()
        open_ = self.spark.createDataFrame([(n,) for n in self._names("batches")], "batch string")
        return (open_ if folded is None else open_.unionAll(folded)).distinct()

    def committed(self, batch: str) -> bool:
        if batch in self._names("batches"):
            return True
        _, folded = self._folded()
        return folded is not None and not folded.where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes; False if it is already in the totals.

        Rows with null keys are a key like any other; a batch without rows or
        without a net change commits as well.
        """
        if not batch or "/" in batch or batch.startswith(("_", ".")):
            raise ValueError(f"not a name for a batch: {batch!r}")
        if self.committed(batch):
            return False
        folder = f"tables/{uuid.uuid4().hex}"
        delta = changes.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        delta.where("n_docs <> 0 OR n_tokens <> 0").select(*SCHEMA.names).write.parquet(f"{self.path}/{folder}")
        return self._publish(folder, f"batches/{batch}")

    def _sum(self, names: list[str], base: str | None) -> DataFrame:
        paths = [self._named(f"batches/{b}") for b in names] + ([base] if base else [])
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        summed = rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, n_docs, n_tokens)``; keys with nothing left are gone."""
        names, base, _ = self._open()
        return self._sum(names, base)

    def compact(self) -> None:
        """Fold the batches committed so far into one table, then drop them and
        the compacted tables before the last one."""
        names, base, folded = self._open()
        tables = self._names("compacted")
        folder = f"tables/{uuid.uuid4().hex}"
        self._sum(names, base).write.parquet(f"{self.path}/{folder}/totals")
        listed = self.spark.createDataFrame([(b,) for b in names], "batch string")
        (listed if folded is None else listed.unionAll(folded)).write.parquet(f"{self.path}/{folder}/batches")
        number = int(tables[-1]) + 1 if tables else 0
        if not self._publish(folder, f"compacted/{number:09d}"):
            return  # another compaction was first, and stands
        # the names go first: what nothing names is not read
        for name in names:
            self._drop(f"batches/{name}")
        for old in tables[:-1]:
            self._drop(f"compacted/{old}")

    def _drop(self, file: str) -> None:
        folder = self._named(file)
        self._fs.delete(self._file(f"{self.path}/{file}"), False)
        self._fs.delete(self._file(folder), True)
