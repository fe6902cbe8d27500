"""Groups of every threshold from one maximum spanning forest.

Edges carry a level: how many of the ascending thresholds their score reaches.
In each round a vertex looks at its best edge (highest level, then the
neighbour of the highest hash in this round) and hooks onto that neighbour if
the hash rises and the neighbour stays (Boruvka's step on stars). Edges are
rewritten to the vertices that stay; of parallel ones the best is kept.

A vertex hooks once, at the level ``l`` of the best edge that leaves the
vertices hooked onto it so far. Each of those was hooked at ``l`` or above, as
the same edge left it, so the vertex and the one it hooks onto are connected at
every level up to ``l``, and at none above. The hooks are therefore a tree with
the connectivity of the graph at all levels at once (a merge tree): the group of
a node at level ``t`` is named by the first vertex on its way up that hooked
below ``t``. A way up has at most as many steps as there were rounds.

An edge enters once, whatever the number of levels. In a round the hooks and
the edges left are together no more than the edges before it, as every hook
uses up an edge of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinedge.functions.scalar import pairs_of
from twinedge.scratch import discard, materialise_counted

HASH_BITS = 48
MOST_LEVELS = 1 << (62 - HASH_BITS)
"""Level and hash of an edge are compared as one number."""


@dataclass
class MergeForest:
    """The hooks ``(u, rep, level)`` of each round, and (edges before, hooks,
    edges left) of each round as counted while they were written."""

    hooks: list[DataFrame]
    written: list[tuple[int, int, int]] = field(default_factory=list)

    def links(self) -> DataFrame:
        """``(u, rep, level)`` of all rounds: a maximum spanning forest."""
        return reduce(DataFrame.unionAll, self.hooks)


def best_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (u, v, level) with u < v, the level of the best copy; loops and
    edges of level 0 are dropped."""
    return (
        edges.where("src <> dst AND level > 0")
        .groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
        .agg(F.max("level").alias("level"))
    )


def _hooks(edges: DataFrame, seed: int) -> DataFrame:
    mask = F.lit((1 << HASH_BITS) - 1)

    def drawn(col: str) -> Column:
        return F.xxhash64(F.col(col), F.lit(seed)).bitwiseAND(mask)

    both = edges.select("u", "v", "level").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "level"))
    # one LONG to compare by keeps this a hash aggregate
    rank = F.shiftleft(F.col("level").cast("long"), HASH_BITS).bitwiseOR(drawn("v"))
    best = both.groupBy("u").agg(F.max_by("v", rank).alias("near"), F.max("level").alias("level"))
    rises = (drawn("near") > drawn("u")) | ((drawn("near") == drawn("u")) & (F.col("near") > F.col("u")))
    best = best.withColumn("rises", rises)
    stays = best.where("NOT rises").select(F.col("u").alias("rep"))
    return best.where("rises").withColumnRenamed("near", "rep").join(stays, "rep").select("u", "rep", "level")


def _rewrite(edges: DataFrame, hooks: DataFrame) -> DataFrame:
    at_u = hooks.select("u", F.col("rep").alias("to_u"))
    at_v = hooks.select(F.col("u").alias("v"), F.col("rep").alias("to_v"))
    moved = edges.join(at_u, "u", "left").join(at_v, "v", "left")
    return best_pairs(moved.select(F.coalesce("to_u", "u").alias("src"), F.coalesce("to_v", "v").alias("dst"), "level"))


def merge_forest(edges: DataFrame, levels: int) -> MergeForest:
    """The merge tree of ``edges(src, dst, level)`` with levels of at most ``levels``."""
    if levels >= MOST_LEVELS:
        raise ValueError(f"at most {MOST_LEVELS - 1} levels, not {levels}")
    left, before = materialise_counted(best_pairs(edges), "forest-edges")
    forest = MergeForest([])
    while before or not forest.hooks:
        hooks, hooked = materialise_counted(_hooks(left, len(forest.hooks)), "forest-hooks")
        old, (left, after) = left, materialise_counted(_rewrite(left, hooks), "forest-edges")
        discard(old)
        forest.hooks.append(hooks)
        forest.written.append((before, hooked, after))
        before = after
    return forest


def memberships(forest: MergeForest, levels: int) -> DataFrame:
    """``(idx, top, joined, lost)``: node ``idx`` is in the group named ``top`` at
    the levels above ``lost`` up to ``joined``; for every node with a link.

    The levels of a node are covered once, by at most as many rows as it has
    steps up and no more than there are levels.
    """
    links = forest.links()
    hooked = links.select(F.col("u").alias("idx"))
    tops = links.select(F.col("rep").alias("idx")).distinct().join(hooked, "idx", "left_anti")
    nodes = hooked.unionAll(tops)
    none = F.array().cast("array<struct<top:bigint,joined:int,lost:int>>")
    way = nodes.select("idx", F.col("idx").alias("at"), F.lit(levels).alias("joined"), none.alias("groups"))

    def group(lost: str | Column) -> Column:
        return F.array(F.struct(F.col("at").cast("long").alias("top"), F.col("joined").alias("joined"), F.col(lost).cast("int").alias("lost") if isinstance(lost, str) else lost.cast("int").alias("lost")))

    for hooks in forest.hooks:
        step = hooks.select(F.col("u").alias("at"), "rep", "level")
        way = way.join(step, "at", "left").select(
            "idx",
            F.coalesce("rep", "at").alias("at"),
            F.least("joined", "level").alias("joined"),
            F.when(F.col("joined") > F.col("level"), F.concat("groups", group("level"))).otherwise(F.col("groups")).alias("groups"),
        )
    every = F.explode(F.concat("groups", group(F.lit(0)))).alias("g")
    return way.select("idx", every).select("idx", "g.top", "g.joined", "g.lost")


def groups_at(members: DataFrame, level: int) -> DataFrame:
    """``(idx, component)`` of the nodes with a link at ``level``, from
    :func:`memberships`; a group is named by its smallest member."""
    at = members.where((F.col("lost") < level) & (F.col("joined") >= level))
    named = at.groupBy("top").agg(F.min("idx").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return at.join(named, "top").select("idx", "component")


def suffix_sums(rows: DataFrame, level: str, levels: int, *amounts: str) -> DataFrame:
    """``(level, amounts)`` for each of the levels 1 to ``levels``: the sums over
    it and all above. One row per level goes through one task, whatever the
    size of the graph."""
    each = rows.sparkSession.range(1, levels + 1).select(F.col("id").cast("int").alias(level))
    by_level = rows.unionByName(each, allowMissingColumns=True).groupBy(level).agg(*[F.coalesce(F.sum(a), F.lit(0)).alias(a) for a in amounts])
    above = Window.orderBy(F.desc(level)).rowsBetween(Window.unboundedPreceding, 0)
    return by_level.select(level, *[F.sum(a).over(above).alias(a) for a in amounts]).where(F.col(level) > 0)


def _events(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(level, pairs, linked_nodes, linked_groups)``: what each group gains at
    the levels where members join, and gives up at the level where it is lost.

    A group has at most one row per level here.
    """
    grown = Window.partitionBy(*keys).orderBy(F.desc("joined")).rowsBetween(Window.unboundedPreceding, 0)
    sized = cells.groupBy(*keys, "lost", "joined").agg(F.sum("n").alias("n")).withColumn("m", F.sum("n").over(grown))
    before = F.col("m") - F.col("n")
    gains = sized.select(
        "lost", "joined",
        (pairs_of("m") - pairs_of(before)).alias("pairs"),
        F.when(before > 1, F.col("n")).when(F.col("m") > 1, F.col("m")).otherwise(0).alias("linked_nodes"),
        F.when((before <= 1) & (F.col("m") > 1), 1).otherwise(0).alias("linked_groups"),
    )
    names = ["pairs", "linked_nodes", "linked_groups"]
    gained = gains.groupBy(F.col("joined").alias("level")).agg(*[F.sum(c).alias(c) for c in names])
    lost = gains.groupBy(F.col("lost").alias("level")).agg(*[(-F.sum(c)).alias(c) for c in names])
    return gained.unionByName(lost)


def group_statistics(members: DataFrame, identities: DataFrame, levels: int) -> DataFrame:
    """``(level, linked_groups, linked_nodes, predicted, common)`` of each level.

    ``predicted`` counts the pairs of nodes in one group, ``common`` those that
    also share their ``identities(idx, orcid)``. A node joins and leaves a group
    once, so rows grow with the nodes and not with the number of levels.
    """
    cells = (
        members.join(identities.select("idx", "orcid"), "idx")
        .groupBy("top", "orcid", "lost", "joined")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    whole = _events(cells, ["top"]).withColumnRenamed("pairs", "predicted").withColumn("common", F.lit(0).cast("decimal(38,0)"))
    shared = _events(cells, ["top", "orcid"]).select(
        "level", F.lit(0).cast("long").alias("linked_nodes"), F.lit(0).cast("long").alias("linked_groups"),
        F.lit(0).cast("decimal(38,0)").alias("predicted"), F.col("pairs").alias("common"),
    )
    return suffix_sums(whole.unionByName(shared), "level", levels, "linked_groups", "linked_nodes", "predicted", "common")
