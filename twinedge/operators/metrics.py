"""Metrics and losses of scored, labelled candidate edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinedge.functions.scalar import is_above, round_half_even, survives
from twinedge.functions.text import author_display
from twinedge.operators.ordering import running_total
from twinedge.schema import CUT_THRESHOLD, EXAMPLES


def prune_edges(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.where(survives("score", threshold))


def binarise(scored: DataFrame, threshold: float = CUT_THRESHOLD) -> DataFrame:
    """Both yes/no rules: rounding half to even, and strictly above the cut."""
    return scored.withColumn("rounded", round_half_even("score")).withColumn(
        "above", is_above("score", threshold).cast("int")
    )


def scored_union(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Scores of right (label 1) and wrong (label 0) edges as one bag."""
    return positive.select("score", F.lit(1).alias("label")).unionByName(
        negative.select("score", F.lit(0).alias("label"))
    )


def simrel_counts(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count(F.lit(1)).alias("simrels"),
        F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("correct"),
        F.coalesce(F.sum(1 - F.col("label")), F.lit(0)).cast("long").alias("wrong"),
        F.avg("label").alias("accuracy"),
    )


def confusion_counts(scored: DataFrame, threshold: float = CUT_THRESHOLD) -> DataFrame:
    """One row ``tn, fp, fn, tp``; a score counts as yes strictly above the cut."""
    right, yes = F.col("label") == 1, is_above("score", threshold)
    return scored.agg(
        F.count_if(~right & ~yes).alias("tn"),
        F.count_if(~right & yes).alias("fp"),
        F.count_if(right & ~yes).alias("fn"),
        F.count_if(right & yes).alias("tp"),
    )


def confusion_matrix(scored: DataFrame, threshold: float = CUT_THRESHOLD) -> DataFrame:
    """The four cells as rows (label, predicted, edges), empty cells included."""
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    rows = F.array(
        *[
            F.struct(F.lit(y).alias("label"), F.lit(p).alias("predicted"), F.col(c).alias("edges"))
            for y, p, c in cells
        ]
    )
    return confusion_counts(scored, threshold).select(F.inline(rows))


def confusion_metrics(counts: DataFrame) -> DataFrame:
    """Rates of a ``tn, fp, fn, tp`` row; null where nothing was counted."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        F.try_divide(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        F.try_divide(tp, fn + tp).alias("tpr"),
        F.try_divide(tn, tn + fp).alias("tnr"),
        F.try_divide(fn, fn + tp).alias("fnr"),
        F.try_divide(fp, tn + fp).alias("fpr"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ).withColumn("balanced_accuracy", (F.col("tpr") + F.col("tnr")) / 2)


def hit_term(label: str = "label", score: str = "score") -> Column:
    """1 where the rounded score equals the label, else 0."""
    return (round_half_even(score) == F.col(label)).cast("int")


def round_accuracy(scored: DataFrame) -> DataFrame:
    """Percent of edges whose rounded score equals the label."""
    return scored.agg((F.avg(hit_term()) * 100).alias("accuracy_pct"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties at half; null if a class is missing.

    ``auc`` treats a high score as right; ``auc_distance`` treats it as a
    distance (right edges are the low ones) and is its complement. Scores are
    counted per value first, then ranked by distributed running totals.
    """
    per_score = scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    ranked = running_total(per_score, ["score"], "neg", "neg_below")
    won = F.col("pos").cast("double") * (F.col("neg_below") + F.col("neg") / 2)
    totals = ranked.agg(
        F.sum(won).alias("won"), F.sum(F.col("pos").cast("double")).alias("p"), F.sum(F.col("neg").cast("double")).alias("n")
    )
    return totals.select(F.try_divide("won", F.col("p") * F.col("n")).alias("auc")).withColumn(
        "auc_distance", 1 - F.col("auc")
    )


def bce_term(label: str = "label", score: str = "score") -> Column:
    """Cross-entropy of one probability, logarithms cut at -100."""

    def log_cut(p: Column) -> Column:
        # ln(0) is null, and greatest skips nulls
        return F.greatest(F.ln(p), F.lit(-100.0))

    y, p = F.col(label), F.col(score)
    return -(y * log_cut(p) + (1 - y) * log_cut(1 - p))


def bce_loss(scored: DataFrame) -> DataFrame:
    """Mean binary cross-entropy of probabilities."""
    return scored.agg(F.avg(bce_term()).alias("bce"))


def bce_logits_loss(scored: DataFrame, logit: str = "logit") -> DataFrame:
    """Mean binary cross-entropy of logits in the form that cannot overflow."""
    x, y = F.col(logit), F.col("label")
    return scored.agg(
        F.avg(F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))).alias("bce_logits")
    )


def margin_loss(scored: DataFrame) -> DataFrame:
    """Mean hinge of ``pos_score`` against each of its ``neg_score``, margin 1.

    A negative travels with the edge it was drawn from, so no join is needed.
    """
    return scored.agg(
        F.avg(F.greatest(1 - F.col("pos_score") + F.col("neg_score"), F.lit(0.0))).alias("margin_loss")
    )


def contrastive_loss(distances: DataFrame, margin: float = 1.0) -> DataFrame:
    """Right pairs (label 1) should be near, wrong ones beyond the margin."""
    d = F.col("distance")
    far = F.greatest(F.lit(margin) - d, F.lit(0.0))
    return distances.agg(F.avg(F.when(F.col("label") == 1, d * d).otherwise(far * far)).alias("contrastive_loss"))


def extreme_edges(scored: DataFrame, authors: DataFrame, condition: Column, k: int = EXAMPLES) -> DataFrame:
    """The first ``k`` edges, in (src, dst) order, that meet a score condition,
    with the display strings of both ends. Only these ``k`` rows are broadcast."""
    names = authors.select("idx", author_display("fullname", "orcid").alias("name"))
    top = scored.where(condition).select("src", "dst", "score").orderBy("src", "dst").limit(k)
    with_src = names.withColumnsRenamed({"idx": "src", "name": "source"}).join(F.broadcast(top), "src")
    return (
        names.withColumnsRenamed({"idx": "dst", "name": "target"})
        .join(F.broadcast(with_src), "dst")
        .select("src", "dst", "score", "source", "target")
    )
