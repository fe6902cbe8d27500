"""Report on the scores of all candidate edges against the truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinedge.functions.scalar import is_above
from twinedge.operators.labels import label_candidates
from twinedge.operators.metrics import (
    confusion_counts,
    confusion_metrics,
    extreme_edges,
    simrel_counts,
)
from twinedge.schema import CUT_THRESHOLD, EXAMPLES, SURELY_RIGHT, SURELY_WRONG
from twinedge.scratch import materialise


def _long(row: DataFrame, section: str) -> DataFrame:
    values = row.select([F.col(c).cast("double").alias(c) for c in row.columns])
    return values.unpivot([], values.columns, "item", "value").select(
        F.lit(section).alias("section"), "item", "value", *[F.lit(None).cast("string").alias(c) for c in ("source", "target")]
    )


def inspection_report(
    scored: DataFrame,
    truth: DataFrame,
    authors: DataFrame,
    right_above: float = SURELY_RIGHT,
    wrong_below: float = SURELY_WRONG,
    k: int = EXAMPLES,
    threshold: float = CUT_THRESHOLD,
) -> DataFrame:
    """``(section, item, value, source, target)``: counts, confusion metrics, and the
    first edges scored surely right or surely wrong."""
    # scores are costly and read four times
    labelled = materialise(label_candidates(scored, truth), "inspect")
    counts = confusion_counts(labelled, threshold)
    parts = [
        _long(simrel_counts(labelled).drop("accuracy"), "simrels"),
        _long(counts, "confusion"),
        _long(confusion_metrics(counts), "metrics"),
    ]
    for section, condition in (
        ("inferred right", is_above("score", right_above)),
        ("inferred wrong", F.col("score") < wrong_below),
    ):
        edges = extreme_edges(labelled, authors, condition, k)
        parts.append(
            edges.select(
                F.lit(section).alias("section"),
                F.concat_ws("-", "src", "dst").alias("item"),
                F.col("score").alias("value"),
                "source",
                "target",
            )
        )
    return reduce(DataFrame.unionByName, parts)
