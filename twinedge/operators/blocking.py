"""Block statistics and agreement of two groupings, from counts alone.

Everything is computed from a contingency table, so no pair of records is ever
listed and a block with a third of all rows is just one large number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinedge.functions.scalar import f1_of, pairs_of, ratio_or_zero


def _sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def pair_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Number of record pairs that agree on ``keys``."""
    return _sizes(df, keys).agg(F.coalesce(F.sum(pairs_of("n")), F.lit(0)).alias("pairs"))


def block_count(df: DataFrame, label: str) -> DataFrame:
    """Distinct labels; every value counts, also -1 and null."""
    return df.select(label).distinct().agg(F.count(F.lit(1)).alias("blocks"))


def block_size_histogram(df: DataFrame, label: str) -> DataFrame:
    return _sizes(df, [label]).groupBy(F.col("n").alias("block_size")).agg(
        F.count(F.lit(1)).alias("blocks")
    )


def singleton_blocks(df: DataFrame, label: str) -> DataFrame:
    return _sizes(df, [label]).agg(F.count_if(F.col("n") == 1).alias("singletons"))


def reduction_ratio(df: DataFrame, label: str) -> DataFrame:
    """Share of all pairs that blocking saves; null for fewer than 2 rows."""
    counted = _sizes(df, [label]).agg(F.sum("n").alias("n"), F.sum(pairs_of("n")).alias("kept"))
    whole = F.when(F.col("n") >= 2, pairs_of("n").cast("double"))
    return counted.select((1 - F.try_divide(F.col("kept").cast("double"), whole)).alias("reduction_ratio"))


def author_stats(df: DataFrame, label: str) -> DataFrame:
    """Labels, labels held once, labels held more often, and rows, in one pass."""
    return _sizes(df, [label]).agg(
        F.count(F.lit(1)).alias("authors"),
        F.count_if(F.col("n") == 1).alias("singletons"),
        F.count_if(F.col("n") > 1).alias("groups"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_authors"),
    )


def cluster_noise_stats(df: DataFrame, label: str, is_core: str) -> DataFrame:
    """Clusters and noise of a density clustering (noise is label -1), and how
    many clustered points are core or border points."""
    per_label = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(is_core)).alias("core")
    )
    noise = F.col(label) == -1
    return per_label.agg(
        F.count_if(~noise).alias("clusters"),
        F.coalesce(F.sum(F.when(noise, F.col("n"))), F.lit(0)).alias("noise"),
        F.coalesce(F.sum(F.when(~noise, F.col("core"))), F.lit(0)).alias("core_points"),
        F.coalesce(F.sum(F.when(~noise, F.col("n") - F.col("core"))), F.lit(0)).alias("border_points"),
    )


def _marginals(df: DataFrame, true: str, pred: str) -> DataFrame:
    """One row: counts, pair counts and n*ln(n) sums of the table and its margins."""
    cells = df.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # all three groupings in one aggregate; grouping_id also tells a null label
    # from a summed-out column
    levels = (
        cells.groupingSets([["t", "p"], ["t"], ["p"]], "t", "p")
        .agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
    )
    pick = {"cell": F.col("gid") == 0, "true": F.col("gid") == 1, "pred": F.col("gid") == 2}

    def summed(level: str, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(pick[level], value)), F.lit(0))

    xlogx = F.col("n") * F.ln(F.col("n").cast("double"))
    return levels.agg(
        summed("cell", F.col("n")).alias("rows"),
        *[summed(k, pairs_of("n")).alias(f"{k}_pairs") for k in pick],
        *[F.count_if(pick[k]).alias(f"{k}_groups") for k in pick],
        *[summed(k, xlogx).alias(f"{k}_xlogx") for k in pick],
        F.count_if(pick["pred"] & (F.col("n") == 1)).alias("pred_singletons"),
    )


def pairwise_prf(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Pairwise precision, recall and F1; 0 wherever a denominator is 0."""
    return (
        _marginals(df, true, pred)
        .select(
            ratio_or_zero("cell_pairs", "pred_pairs").alias("precision"),
            ratio_or_zero("cell_pairs", "true_pairs").alias("recall"),
        )
        .withColumn("f1", f1_of("precision", "recall"))
    )


def blocking_report(df: DataFrame, true: str, pred: str) -> DataFrame:
    """Blocks, singletons, homogeneity, completeness, V-measure, Rand index,
    adjusted Rand index and normalised mutual information in one row.

    A labelling with a single group has no entropy; its score is then 1.
    """
    rows = F.col("rows").cast("double")

    def entropy(level: str) -> Column:
        return F.ln(rows) - F.try_divide(F.col(f"{level}_xlogx"), rows)

    mutual = entropy("true") + entropy("pred") - entropy("cell")
    both, t, p = (F.col(f"{k}_pairs").cast("double") for k in ("cell", "true", "pred"))
    whole = pairs_of("rows").cast("double")
    fp, fn = p - both, t - both
    tn = whole - both - fp - fn
    ari = F.try_divide(
        2 * (both * tn - fn * fp), (both + fn) * (fn + tn) + (both + fp) * (fp + tn)
    )
    scored = _marginals(df, true, pred).select(
        F.col("pred_groups").alias("blocks"),
        F.col("pred_singletons").alias("singletons"),
        F.when(F.col("true_groups") <= 1, 1.0).otherwise(mutual / entropy("true")).alias("homogeneity"),
        F.when(F.col("pred_groups") <= 1, 1.0).otherwise(mutual / entropy("pred")).alias("completeness"),
        F.coalesce(F.try_divide(whole + 2 * both - t - p, whole), F.lit(1.0)).alias("rand_index"),
        F.when((fp == 0) & (fn == 0), 1.0).otherwise(ari).alias("adjusted_rand_index"),
    )
    v = f1_of("homogeneity", "completeness")
    return scored.withColumn("v_measure", v).withColumn("nmi", v)


def blocking_quality(df: DataFrame, true: str, pred: str) -> DataFrame:
    return blocking_report(df, true, pred).drop("blocks", "singletons")
