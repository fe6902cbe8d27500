"""The threshold sweep: prune, group, compare with the known identities."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinedge.functions.scalar import f1_of, pairs_of, ratio_or_zero
from twinedge.operators.blocking import pairwise_prf
from twinedge.operators.forest import group_statistics, memberships, merge_forest, suffix_sums
from twinedge.operators.labels import label_candidates
from twinedge.schema import THRESHOLDS
from twinedge.scratch import materialise

FEW_THRESHOLDS = 64


def reached(thresholds: Sequence[float], score: str = "score") -> Column:
    """How many of the ascending thresholds a score reaches; NaN reaches none.

    Few are compared one by one in generated code; more are laid out in about
    as many shelves as there are on a shelf, so two short scans find the number.
    """
    value = F.col(score)
    if len(thresholds) <= FEW_THRESHOLDS:
        found = reduce(add, [(value >= t).cast("int") for t in thresholds])
    else:
        width = math.isqrt(len(thresholds))
        shelves = [list(thresholds[k : k + width]) for k in range(0, len(thresholds), width)]
        heads = F.from_json(F.lit(json.dumps([s[0] for s in shelves])), "array<double>")
        listed = F.from_json(F.lit(json.dumps(shelves)), "array<array<double>>")
        full = F.size(F.filter(heads, lambda t: t <= value))
        last = F.size(F.filter(F.get(listed, full - 1), lambda t: t <= value))
        found = F.when(full > 0, (full - 1) * width + last).otherwise(0)
    return F.when(F.isnan(value) | value.isNull(), 0).otherwise(found).cast("int")


def threshold_sweep(
    scored: DataFrame,
    truth: DataFrame,
    identities: DataFrame,
    thresholds: Sequence[float] = THRESHOLDS,
) -> DataFrame:
    """One row per threshold.

    ``scored(src, dst, score)``, ``truth(src, dst)``, ``identities(idx, orcid)``
    with one row per node. An edge enters once with the number of thresholds it
    reaches; the groups of all thresholds are read off one merge tree. Nodes
    without a surviving edge are counted, never listed: they are groups of one,
    hold no pairs, and their number follows from the total.
    """
    thresholds = sorted({float(t) for t in thresholds})
    labelled = materialise(
        label_candidates(scored, truth, "correct").select("src", "dst", "correct", reached(thresholds).alias("level")),
        "sweep-levels",
    )
    forest = merge_forest(labelled.select("src", "dst", "level"), len(thresholds))
    groups = group_statistics(memberships(forest, len(thresholds)), identities, len(thresholds))
    by_level = labelled.where("level > 0").groupBy("level").agg(F.count(F.lit(1)).alias("edges"), F.sum("correct").alias("right"))
    edges = suffix_sums(by_level, "level", len(thresholds), "edges", "right")
    # one row of totals, repeated for each threshold
    totals = (
        identities.groupBy("orcid")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.sum(pairs_of("n")).alias("true"))
    )
    cuts = F.from_json(F.lit(json.dumps([{"level": k, "threshold": t} for k, t in enumerate(thresholds, 1)])), "array<struct<level:int,threshold:double>>")
    rows = totals.select("nodes", "true", F.inline(cuts)).join(edges, "level").join(groups, "level")
    singles = F.col("nodes") - F.col("linked_nodes")
    precision = ratio_or_zero("common", "predicted")
    recall = ratio_or_zero("common", "true")
    return rows.select(
        "threshold",
        "edges",
        F.try_divide("right", "edges").alias("simrels_accuracy"),
        (singles + F.col("linked_groups")).alias("groups"),
        F.coalesce(F.try_divide(singles, "nodes"), F.lit(0.0)).alias("singleton_fraction"),
        precision.alias("precision"),
        recall.alias("recall"),
    ).withColumn("f1", f1_of("precision", "recall"))


def threshold_stats(edges: DataFrame, truth: DataFrame, identities: DataFrame, groups: DataFrame) -> DataFrame:
    """The sweep's row for one set of surviving edges and a given grouping."""
    accuracy = label_candidates(edges, truth).agg(F.avg("label").alias("simrels_accuracy"))
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.try_divide(F.count_if(F.col("n") == 1), F.sum("n")), F.lit(0.0)).alias("singleton_fraction")
    )
    pairs = pairwise_prf(identities.join(groups, "idx"), "orcid", "component")
    # three rows of one line each, brought together by an aggregate
    lines = accuracy.unionByName(sizes, True).unionByName(pairs, True)
    return lines.agg(*[F.max(c).alias(c) for c in lines.columns])


def sweep_header(candidates: DataFrame, identities: DataFrame) -> DataFrame:
    """Nodes, candidate edges and the share of ORCIDs held by a single node."""
    orcids = (
        identities.groupBy("orcid")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sum("n").alias("nodes"), F.count_if(F.col("n") == 1).alias("single"))
    )
    edges = candidates.agg(F.count(F.lit(1)).alias("edges"))
    lines = orcids.unionByName(edges, True)
    return lines.agg(*[F.max(c).alias(c) for c in lines.columns]).select(
        "nodes", "edges", F.try_divide("single", "nodes").alias("singleton_orcid_share")
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The lowest threshold with the highest F1."""
    best = F.max_by("threshold", F.struct("f1", -F.col("threshold")))
    return sweep.agg(best.alias("threshold"), F.max("f1").alias("f1"))


def sweep_long(sweep: DataFrame) -> DataFrame:
    """(threshold, metric, value): the form a chart is drawn from."""
    metrics = ["simrels_accuracy", "singleton_fraction", "precision", "recall", "f1"]
    return sweep.unpivot(["threshold"], metrics, "metric", "value")
