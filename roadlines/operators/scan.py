"""Running totals and ranks over groups of any size.

A plain window sorts a whole group in one task. Here rows are range-partitioned by
(group, order), each slice is summed on its own, and slice offsets (at most one row per
slice and group) are added. A group that holds most rows is spread over all slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlines.session import cut, shuffle_width




def prefix_scan(df: DataFrame, by: Sequence[str], order: Sequence[str],
                rank: str | None = None, sums: dict[str, str] | None = None,
                slices: int | None = None) -> DataFrame:
    """Add a 1-based `rank` and inclusive running `sums` ({new: source}) per `by` in `order`.

    `order` has to be total within a group for the result to be unique. The ranged rows are
    written to the checkpoint folder: both branches below have to see the same slice bounds.
    """
    sums = sums or {}
    n = slices or shuffle_width(df.sparkSession)
    ranged = cut(df.repartitionByRange(n, *by, *order).withColumn("_slice", F.spark_partition_id()))

    frame = Window.partitionBy("_slice", *by).orderBy(*order)
    upto = frame.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged
    if rank:
        local = local.withColumn(rank, F.row_number().over(frame).cast("long"))
    for new, source in sums.items():
        local = local.withColumn(new, F.sum(source).over(upto))

    totals = ranged.groupBy(*by, "_slice").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(s).alias(f"_t_{new}") for new, s in sums.items()])
    earlier = (Window.partitionBy(*by).orderBy("_slice")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(
        *[F.col(b).alias(f"_b_{b}") for b in by], F.col("_slice").alias("_b_slice"),
        F.sum("_n").over(earlier).alias("_before"),
        *[F.sum(f"_t_{new}").over(earlier).alias(f"_o_{new}") for new in sums])
    on = local["_slice"] == offsets["_b_slice"]
    for b in by:
        on = on & local[b].eqNullSafe(offsets[f"_b_{b}"])
    joined = local.join(offsets, on, "left")
    if rank:
        joined = joined.withColumn(rank, F.col(rank) + F.coalesce("_before", F.lit(0)))
    for new in sums:
        joined = joined.withColumn(new, F.col(new) + F.coalesce(f"_o_{new}", F.lit(0)))
    extra = [rank] if rank else []
    return joined.select(*df.columns, *extra, *sums)
