"""Global order without a global task: positions, dense indices, prefix cuts.

A window without ``partitionBy`` would sort everything in one task. Here rows
are range-partitioned, each partition runs its own total, and only one number
per partition (never per row) goes through the driver to shift the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinedge.scratch import materialise


def running_total(
    df: DataFrame, order: Sequence[str], amount: str, out: str = "before", without: Sequence[str] = ()
) -> DataFrame:
    """Add ``out``: the sum of ``amount`` (LONG) over all rows earlier in ``order``.

    ``order`` must tell rows apart. Callers therefore group copies first and
    pass their number as ``amount``, so a row with very many copies is one row
    here and cannot overfill a range. Columns ``without`` serve the order alone
    and are left out of the result.
    """
    schema = T.StructType(
        [*df.drop(*without).schema.fields, T.StructField("_part", T.IntegerType()), T.StructField(out, T.LongType())]
    )

    def within_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = batch.column(amount)
            upto = pc.add(pc.cumulative_sum(own), so_far)
            columns = [*batch.columns, pa.array([part] * len(own), pa.int32()), pc.subtract(upto, own)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            if len(own):
                so_far = upto[-1].as_py()

    # written down: the sampled range bounds must not change between the passes.
    # AQE may join neighbouring ranges, which keeps their order. The other
    # columns stay Arrow columns and are not converted.
    local = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order).drop(*without).mapInArrow(within_partition, schema),
        "running-total",
    )
    # one row per shuffle partition, whatever the size of df
    totals = sorted((r["_part"], r["total"]) for r in local.groupBy("_part").agg(F.sum(amount).alias("total")).collect())
    starts = accumulate([0, *(total for _, total in totals)])
    shifts = [(part, start) for (part, _), start in zip(totals, starts)]
    offsets = df.sparkSession.createDataFrame(shifts, "_part int, _shift bigint")
    shifted = local.join(F.broadcast(offsets), "_part")
    return shifted.withColumn(out, F.col(out) + F.col("_shift")).drop("_part", "_shift")


def positional_index(df: DataFrame, order: Sequence[str], out: str = "position") -> DataFrame:
    """0-based position of each row in ``order`` (which must tell rows apart)."""
    return running_total(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", out).drop("_one")


def dense_index(df: DataFrame, value: str, out: str = "label") -> DataFrame:
    """Distinct values of a column with indices 0..k-1 in value order, null first."""
    return positional_index(df.select(value).distinct(), [value], out)
