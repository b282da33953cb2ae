"""Bins along the geometric chain of each road, kept as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlines.config import BIN_SIZES_KM
from roadlines.functions import geometry as geo
from roadlines.operators import bins as bn
from roadlines.operators.chain import chain_total
from roadlines.operators.merge import merge_lines

KEYS = ("road_number", "bin_size_km", "bin_idx")


def grid_of(chain: DataFrame, sizes: Sequence[int] = BIN_SIZES_KM) -> DataFrame:
    return bn.chain_grid(chain_total(chain), sizes)


def chain_clips(chain: DataFrame, grid: DataFrame) -> DataFrame:
    """Pieces of the chain inside each bin."""
    usable = chain.where(F.col("seg_len_m") > 0)
    return bn.clip_segments(usable, grid, "chain_start_m", "chain_end_m", span="seg_len_m")


def without_line(defs: DataFrame, clips: DataFrame) -> DataFrame:
    """The bins for which no clip has a line to draw, as `merge_lines` leaves such clips out."""
    drawable = clips.where(geo.is_valid("geom_clip")).select(*KEYS)
    return defs.join(drawable, list(KEYS), "left_anti")


def longest_part(parts: DataFrame) -> DataFrame:
    """Longest merged part of each bin (ties: lower vertices)."""
    size = (-geo.length("geom")).alias("size")
    return parts.groupBy(*KEYS).agg(F.min(F.struct(size, "geom")).alias("p")).select(
        *KEYS, F.col("p.geom").alias("geom_rd"))


def union_empty(drawn: DataFrame, empty: DataFrame) -> DataFrame:
    """Drawn bins and bins without a line, the latter with typed NULLs."""
    return drawn.unionByName(empty, allowMissingColumns=True)


def chain_bins(chain: DataFrame, sizes: Sequence[int] = BIN_SIZES_KM) -> DataFrame:
    """Bin table for all sizes: bounds, longest line part, GeoJSON, quality."""
    grid = grid_of(chain, sizes)
    clips = chain_clips(chain, grid)
    lines = longest_part(merge_lines(clips, KEYS, "geom_clip"))
    defs = bn.bin_defs(grid).select(
        bn.bin_id().alias("bin_id"), *KEYS, F.col("bin_start").alias("bin_start_m"),
        F.col("bin_end").alias("bin_end_m"),
        (F.col("bin_end") - F.col("bin_start")).alias("length_m"))
    drawn = (defs.join(lines, list(KEYS), "inner").withColumn("geom_wgs84", geo.rd_to_wgs84("geom_rd"))
             .withColumn("geojson", geo.as_geojson("geom_wgs84"))
             .withColumn("geometry_quality", F.lit("linesubstring")))
    empty = without_line(defs, clips).withColumn("geometry_quality", F.lit("empty"))
    return union_empty(drawn, empty)


def empty_bins(chain: DataFrame, sizes: Sequence[int] = BIN_SIZES_KM) -> DataFrame:
    """Bins that no piece of the chain with a line reaches."""
    grid = grid_of(chain, sizes)
    return without_line(bn.bin_defs(grid), chain_clips(chain, grid))


def chain_bin_cube(chainage: DataFrame, grid: DataFrame) -> DataFrame:
    """Accident counts per bin, year and severity for all sizes."""
    placed = bn.point_in_bin_join(chainage.where(F.col("chain_m").isNotNull()), grid, "chain_m")
    return bn.bin_cube(placed).withColumn("bin_id", bn.bin_id())


def top_bins(defs: DataFrame, cube: DataFrame, size: int = 1, n: int = 10) -> DataFrame:
    """Per road the n bins of one size with most accidents; bins without any rank last.

    The rank filter is applied per map task before the window's shuffle, so a road with very
    many bins sends n rows per task.
    """
    sums = cube.where(F.col("bin_size_km") == size).groupBy(*KEYS).agg(
        F.sum("accident_count").alias("accident_count"))
    ranked = Window.partitionBy("road_number").orderBy(
        F.col("accident_count").desc_nulls_last(), "bin_start_m")
    return (
        defs.where(F.col("bin_size_km") == size).join(sums, list(KEYS), "left")
        .withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= n)
        .select("road_number", "bin_id", "bin_size_km", "bin_start_m", "bin_end_m",
                "accident_count"))
