"""Mergeable counts of distinct labels: sketches stored by partition and united
for any subset, without reading the records again.

Theta sketches keep the smallest 2^14 hashes of the labels: exact below that, to
within about 1 % above. A union does not depend on the order of its sketches
(the estimate of united HyperLogLog sketches does), so partitions can be added,
replaced or left out one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 14


def _value(label: str) -> Column:
    """Every value is a label of its own, null and '' as well."""
    return F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null"))


def label_sketches(records: DataFrame, label: str, *parts: str) -> DataFrame:
    """``(parts, rows, sketch)``: a row per partition of ``records``.

    One pass with partial sketches on the map side; a sketch has at most 256 KB.
    """
    return records.groupBy(*parts).agg(F.count(F.lit(1)).alias("rows"), F.theta_sketch_agg(_value(label), F.lit(LG_K)).alias("sketch"))


def united(sketches: DataFrame, *by: str) -> DataFrame:
    """``(by, rows, sketch)``: sketches united by some of their partition columns."""
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.theta_union_agg("sketch", F.lit(LG_K)).alias("sketch"))


def estimated_labels(sketches: DataFrame, *by: str) -> DataFrame:
    """``(by, rows, labels)``: rows exactly, distinct labels by estimate."""
    return united(sketches, *by).select(*by, "rows", F.theta_sketch_estimate("sketch").alias("labels"))
