"""Connected components that grow: batches of edges are contracted with the
stored labels, and no edge of an earlier batch is read again.

A store holds two kinds of tables. ``labels`` are written once per batch, for
nodes that were in no batch before. ``moves`` say which components have become
part of another one; they are composed when a batch is added, so a label is
found by one lookup however many batches there were. A batch touches the labels
of its own nodes and the moves, and leaves all other rows as they are.

A version counts once its line is in ``commits``, as with the graph store.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinedge.operators.components import linked_nodes, undirected
from twinedge.scratch import materialise

LABELS = "idx bigint, component bigint"
MOVES = "old bigint, new bigint"
COMMITS = "version bigint, labels array<string>, moves string"


class ComponentStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _state(self) -> tuple[int, list[str], str | None]:
        """Version, folders of labels, folder of moves: one short row."""
        try:
            commits = self.spark.read.schema(COMMITS).json(f"{self.root}/commits")
            last = commits.orderBy(F.desc("version")).first()
        except AnalysisException:
            last = None
        return (last["version"], list(last["labels"]), last["moves"]) if last else (0, [], None)

    def _read(self, schema: str, *folders: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def labels(self) -> DataFrame:
        """``(idx, component)`` of every node that an edge has named; a
        component is named by its smallest member."""
        _, folders, moves = self._state()
        stored = self._read(LABELS, *folders)
        if moves is None:
            return stored
        moved = self._read(MOVES, moves).withColumnRenamed("old", "component")
        return stored.join(moved, "component", "left").select("idx", F.coalesce("new", "component").alias("component"))

    def add(self, edges: DataFrame) -> None:
        """Add a batch ``(src, dst)``: direction, copies and loops do not matter,
        edges with a null end are left out. An empty batch changes nothing."""
        version, folders, moves = self._state()
        edges = materialise(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst"), "component-batch")
        ends = edges.select(F.explode(F.array("src", "dst")).alias("idx")).distinct()
        # the labels of the batch's own nodes; a node not seen before is its own
        known = materialise(ends.join(self.labels(), "idx", "left").select("idx", F.coalesce("component", "idx").alias("component"), F.col("component").isNull().alias("fresh")), "batch-labels")
        at_src = known.select(F.col("idx").alias("src"), F.col("component").alias("a"))
        at_dst = known.select(F.col("idx").alias("dst"), F.col("component").alias("b"))
        contracted = edges.join(at_src, "src").join(at_dst, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        merged = linked_nodes(undirected(contracted)).where("idx <> component").select(F.col("idx").alias("old"), F.col("component").alias("new"))
        merged = materialise(merged, "merged-components")
        batch = uuid.uuid4().hex
        fresh = known.where("fresh").join(merged.withColumnRenamed("old", "component"), "component", "left")
        fresh.select("idx", F.coalesce("new", "component").alias("component")).write.parquet(f"{self.root}/labels-{batch}")
        # earlier moves end where this batch moved their end to
        earlier = self._read(MOVES, moves) if moves else self._read(MOVES)
        onward = merged.select(F.col("old").alias("new"), F.col("new").alias("then"))
        composed = earlier.join(onward, "new", "left").select("old", F.coalesce("then", "new").alias("new"))
        # a name that only fresh nodes had is in their labels already
        stored = merged.join(known.where("NOT fresh").select(F.col("component").alias("old")).distinct(), "old", "left_semi")
        reduce(DataFrame.unionByName, [composed, stored]).write.parquet(f"{self.root}/moves-{batch}")
        line = (version + 1, [*folders, f"labels-{batch}"], f"moves-{batch}")
        self.spark.createDataFrame([line], COMMITS).coalesce(1).write.mode("append").json(f"{self.root}/commits")
