"""Connected components by randomised contraction.

Each round every vertex moves to the member of its closed neighbourhood with
the smallest hash, and on to where that member moves; edges are rewritten to those representatives, and loops and
copies fall away (Boegeholz, Brand and Todor, "In-database connected component
analysis", ICDE 2020). The order is drawn anew each round, so the number of
vertices shrinks by a constant factor in expectation whatever the shape of the
graph: a long path takes O(log n) rounds, and the tables of all rounds
together are not much larger than the first.

Skew: the representative is a minimum (combined map-side), and the joins have
one row per vertex on the right, so AQE can split the edges of a hub.
No neighbour list is ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinedge.scratch import discard, materialise, materialise_counted


def undirected(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct (u, v) with u < v; direction, copies and loops are dropped."""
    return (
        edges.where(F.col("src") != F.col("dst"))
        .select(*keys, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
        .distinct()
    )


def _representatives(edges: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Where each vertex moves: to its smallest neighbour or itself, and from
    there once more, which lets fewer representatives remain per round."""

    def drawn(col: str) -> Column:
        return F.xxhash64(F.col(col), F.lit(seed))

    both_ways = edges.select(*keys, "u", "v").unionByName(
        edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))
    )
    # plain LONG buffers keep this a hash aggregate; min of a struct would sort
    near = both_ways.groupBy(*keys, "u").agg(
        F.min(drawn("v")).alias("h"), F.min_by("v", drawn("v")).alias("near")
    )
    step = near.select(*keys, "u", F.when(F.col("h") < drawn("u"), F.col("near")).otherwise(F.col("u")).alias("rep"))
    onward = step.select(*keys, F.col("u").alias("rep"), F.col("rep").alias("then"))
    return step.join(onward, [*keys, "rep"]).select(*keys, "u", F.col("then").alias("rep"))


def _rewrite(edges: DataFrame, reps: DataFrame, keys: list[str]) -> DataFrame:
    at_v = reps.select(*keys, F.col("u").alias("v"), F.col("rep").alias("rep_v"))
    moved = edges.join(reps, [*keys, "u"]).join(at_v, [*keys, "v"])
    return undirected(
        moved.select(*keys, F.col("rep").alias("src"), F.col("rep_v").alias("dst")), keys
    )


def linked_nodes(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, idx, component)`` for every node that has at least one edge.

    ``pairs(keys, u, v)`` must come from :func:`undirected`. With ``keys`` the
    graphs of all key values are solved in the same rounds. The component is
    named by its smallest member.
    """
    keys = list(keys)
    edges, left = materialise_counted(pairs, "cc-edges")
    moves: list[DataFrame] = []
    while left or not moves:
        reps = materialise(_representatives(edges, keys, len(moves)), "cc-reps")
        moves.append(reps)
        before, (edges, left) = edges, materialise_counted(_rewrite(edges, reps, keys), "cc-edges")
        discard(before)

    # follow the moves backwards: a representative without a later move is final
    placed = moves.pop()
    while moves:
        later = placed.select(*keys, F.col("rep").alias("final"), F.col("u").alias("rep"))
        placed = (
            moves.pop()
            .join(later, [*keys, "rep"], "left")
            .select(*keys, "u", F.coalesce("final", "rep").alias("rep"))
        )
    smallest = placed.groupBy(*keys, "rep").agg(F.min("u").alias("component"))
    return placed.join(smallest, [*keys, "rep"]).select(*keys, F.col("u").alias("idx"), "component")


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(idx, component)`` for all ``nodes(idx)``; isolated nodes name themselves."""
    return nodes.select("idx").join(linked_nodes(undirected(edges)), "idx", "left").select(
        "idx", F.coalesce("component", "idx").alias("component")
    )
