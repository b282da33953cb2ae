"""Bins along the official km of every road, recomputed for a set of filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlines.config import GEOMETRY_DIRECTION, AppConfig, check_args, clean_direction
from roadlines.functions import geometry as geo
from roadlines.operators import bins as bn
from roadlines.operators import filters as flt
from roadlines.operators.accidents import (
    attach_casualties, attach_intervals, km_weights, on_segments, road_km, select_accidents,
)
from roadlines.operators.joins import segment_intervals
from roadlines.operators.merge import collect_lines, merge_lines

KEYS = ("road_number", "bin_size_km", "bin_idx")


def suffix(main_road_only: bool, direction: str | None) -> str:
    main = "_HR" if main_road_only else ""
    return f"{main}_{clean_direction(direction) or GEOMETRY_DIRECTION}"


def drawn_intervals(roads: DataFrame, intervals: DataFrame, road: str | None = None,
                    main_road_only: bool = True, direction: str | None = None) -> DataFrame:
    """Km intervals of the segments that are drawn, with their lines.

    A segment has a length exactly if it has a line; testing the length spares reading the
    lines where only the intervals are used.
    """
    segments = flt.geometry_direction(
        flt.main_road(flt.has_geometry(flt.on_road(roads, road), "length_m"), main_road_only),
        direction)
    return segment_intervals(
        segments.select("wegvak_id", F.col("road_number_norm").alias("road_number"), "geom_rd",
                        *[c for c in ("geom_parts",) if c in segments.columns]),
        intervals)


def km_extent(segments: DataFrame) -> DataFrame:
    """Lowest and highest official km per road."""
    return segments.groupBy("road_number").agg(
        F.min("beg_km").alias("km_min"), F.max("end_km").alias("km_max"))


def year_span(accidents: DataFrame, year_from: int | None = None,
              year_to: int | None = None) -> DataFrame:
    """Years covered per road, at least one; an open side takes the road's own bound."""
    years = accidents.where(F.col("road_number_norm").isNotNull()).groupBy(
        F.col("road_number_norm").alias("road_number")).agg(
        F.min("accident_year").alias("_lo"), F.max("accident_year").alias("_hi"))
    lo = F.col("_lo") if year_from is None else F.lit(year_from)
    hi = F.col("_hi") if year_to is None else F.lit(year_to)
    return years.select("road_number", F.coalesce(
        F.greatest(hi - lo + 1, F.lit(1)), F.lit(1)).cast("int").alias("year_span"))


def with_year_span(bins: DataFrame, accidents: DataFrame, year_from: int | None,
                   year_to: int | None) -> DataFrame:
    """year_span as a constant when both bounds are given, else from the accidents."""
    if year_from is not None and year_to is not None:
        return bins.withColumn("year_span", F.lit(max(1, year_to - year_from + 1)))
    return (bins.join(year_span(accidents, year_from, year_to), "road_number", "left")
            .withColumn("year_span", F.coalesce("year_span", F.lit(1))))


def bin_clips(segments: DataFrame, grid: DataFrame) -> DataFrame:
    """Pieces of the drawn intervals inside each bin."""
    usable = segments.where(F.abs(F.col("end_km") - F.col("beg_km")) > 0)
    return bn.clip_segments(usable, grid, "beg_km", "end_km")


def bin_parts(segments: DataFrame, grid: DataFrame) -> DataFrame:
    """Merged line parts of each bin, one row per part."""
    return merge_lines(bin_clips(segments, grid), KEYS, "geom_clip")


def flag_drawn(bins: DataFrame, segments: DataFrame, grid: DataFrame) -> DataFrame:
    """`bins` with is_drawn: some clip in the bin has a line to draw. Nothing is merged for it."""
    lines = bin_clips(segments, grid).where(geo.is_valid("geom_clip")).select(*KEYS).distinct()
    return bins.join(lines.withColumn("_drawn", F.lit(True)), list(KEYS), "left").withColumn(
        "is_drawn", F.coalesce("_drawn", F.lit(False))).drop("_drawn")


def placed_counts(accidents: DataFrame, roads: DataFrame, intervals: DataFrame, grid: DataFrame,
                  main_road_only: bool, direction: str | None) -> DataFrame:
    """Accident, death and injury counts per bin."""
    weights = flt.has_km(km_weights(accidents, roads, intervals, main_road_only, direction))
    return bn.bin_counts(bn.point_in_bin_join(weights, grid, "road_km", scale=1000.0))


def road_bins(roads: DataFrame, accidents: DataFrame, intervals: DataFrame,
              sizes: Sequence[int] = (1,), road: str | None = None,
              year_from: int | None = None, year_to: int | None = None,
              severities: Sequence[str] | None = None, main_road_only: bool = True,
              direction: str | None = None, staging: DataFrame | None = None,
              geometry: bool = True, drawn: bool = False) -> DataFrame:
    """Bins with counts and density for one road, or for all roads at once (`road` None).

    Without `geometry` the lines are not merged and the geometry columns are left out; with
    `drawn` a column is_drawn then says which bins have a line, those that a map shows.
    """
    segments = drawn_intervals(roads, intervals, road, main_road_only, direction)
    grid = bn.km_grid(km_extent(segments), sizes)
    chosen = attach_casualties(
        select_accidents(accidents, road, year_from, year_to, severities), staging)
    counts = placed_counts(chosen, roads, intervals, grid, main_road_only, direction)
    filled = bn.zero_fill(bn.bin_defs(grid), counts)
    spanned = with_year_span(filled, flt.on_road(accidents, road), year_from, year_to)

    span_km = F.col("bin_end") - F.col("bin_start")
    measured = spanned.select(
        bn.bin_id(suffix(main_road_only, direction)).alias("bin_id"), *KEYS,
        (F.col("bin_start") * 1000.0).alias("bin_start_m"),
        (F.col("bin_end") * 1000.0).alias("bin_end_m"),
        (span_km * 1000.0).alias("length_m"),
        "accident_count", "fatal_count", "injury_count", "year_span")
    dense = measured.withColumn("density_per_km_year", bn.density(
        F.col("accident_count"), F.col("length_m"), F.col("year_span")))
    if not geometry:
        return (flag_drawn(dense, segments, grid) if drawn else dense).drop("bin_idx")
    lines = collect_lines(bin_parts(segments, grid), KEYS)
    return with_drawing(dense.join(lines, list(KEYS), "left")).drop("bin_idx")


def requested_bins(roads: DataFrame, accidents: DataFrame, intervals: DataFrame, cfg: AppConfig, road: str,
                   size: int, direction: str | None = None, **filters) -> DataFrame:
    """Bins of one request: road name, size and direction are checked and put into their normal form first.

    An unknown road, size or direction is an error before any work starts; `filters` go on to `road_bins`.
    """
    name, size, direction = check_args(cfg, road, size, direction)
    return road_bins(roads, accidents, intervals, [size], name, direction=direction, **filters)


def quality(parts: Column, label: str) -> Column:
    return F.when(parts.isNull(), "empty").otherwise(label)


def with_drawing(bins: DataFrame, label: str = "hectometer_km") -> DataFrame:
    parts = F.col("geom_parts")
    return bins.withColumn("geometry_quality", quality(parts, label)).withColumn(
        "geojson", geo.parts_to_wgs84("geom_parts")).withColumn(
        "geojson", geo.as_geojson("geojson", "parts"))


def scored_accidents(accidents: DataFrame, roads: DataFrame, intervals: DataFrame,
                     main_road_only: bool = True, direction: str | None = None) -> DataFrame:
    """One row per (accident, interval) with its km: the row-level form of the counts."""
    joined = attach_intervals(on_segments(accidents, roads, main_road_only, direction), intervals)
    return road_km(joined)


def accidents_per_km(accidents: DataFrame, roads: DataFrame, intervals: DataFrame,
                     road: str | None = None, year_from: int | None = None,
                     year_to: int | None = None, severities: Sequence[str] | None = None,
                     main_road_only: bool = True, direction: str | None = None) -> DataFrame:
    """Accident count per road and whole official km; a NULL km groups rows without a place."""
    chosen = attach_casualties(
        select_accidents(accidents, road, year_from, year_to, severities), None)
    weights = km_weights(chosen, roads, intervals, main_road_only, direction)
    return weights.groupBy("road_number", F.floor("road_km").cast("int").alias("road_km")).agg(
        F.sum("accidents").alias("accident_count"))


def corridor_per_km(accidents: DataFrame, roads: DataFrame, intervals: DataFrame, lo: float,
                    hi: float, road: str | None = None, year_from: int | None = None,
                    year_to: int | None = None) -> DataFrame:
    """Counts per km inside a stretch; the bounds apply to the exact km, both inclusive."""
    chosen = attach_casualties(select_accidents(accidents, road, year_from, year_to), None)
    weights = flt.corridor(km_weights(chosen, roads, intervals), lo, hi)
    return weights.groupBy("road_number", F.floor("road_km").cast("int").alias("road_km")).agg(
        F.sum("accidents").alias("accident_count"))


def head_km(per_km: DataFrame, n: int = 8) -> DataFrame:
    """First n km of a road; rows without a km do not take part."""
    return flt.has_km(per_km).orderBy(F.col("road_km").asc_nulls_last(), "road_number").limit(n)


def tail_km(per_km: DataFrame, n: int = 5) -> DataFrame:
    """Last n km of a road; the group without a km takes part and sorts last."""
    return per_km.orderBy(F.col("road_km").desc_nulls_last(), "road_number").limit(n)
