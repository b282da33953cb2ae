"""Accidents: typing, location on the network, official km."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlines.config import HM_PER_KM, ColumnMap
from roadlines.functions import geometry as geo
from roadlines.functions.text import filled, safe_date, safe_double, safe_int
from roadlines.operators import filters as flt
from roadlines.operators.filters import role
from roadlines.operators.joins import lookup_join
from roadlines.operators.roads import best_point


def stage_accidents(raw: DataFrame, cmap: ColumnMap) -> DataFrame:
    """accidents_staging: typed columns, blanks as NULL, a point when coordinates are mapped."""
    c = cmap.accidents
    text = F.lit(None).cast("string")
    direct = F.lit(None).cast(geo.POINT_TYPE)
    if c.x_col and c.y_col:
        direct = flt.plausible_xy(safe_double(role(c.x_col)), safe_double(role(c.y_col)))
    return raw.select(
        role(c.accident_id_col).alias("accident_id"),
        safe_int(role(c.year_col)).alias("accident_year"),
        safe_date(role(c.date_col)).alias("accident_date"),
        safe_int(role(c.hour_col)).alias("accident_hour"),
        filled(role(c.severity_col)).alias("severity"),
        role(c.accident_type_col).alias("accident_type"),
        text.alias("road_number_raw"), text.alias("road_type_raw"), text.alias("road_number_norm"),
        filled(role(c.wegvak_id_col)).alias("wegvak_id"),
        filled(role(c.puntlocatie_id_col)).alias("point_id"),
        safe_double(filled(role(c.hm_col))).alias("hm"),
        safe_int(filled(role(c.fatal_count_col))).alias("fatal_count"),
        safe_int(filled(role(c.injury_count_col))).alias("injury_count"),
        direct.alias("geom_direct"))


def attach_location(staging: DataFrame, roads: DataFrame, points: DataFrame) -> DataFrame:
    """Left joins to the segment and to the best point; accidents are neither lost nor repeated
    as long as segment ids are unique.
    Lines are measured on the segment side, once per segment and not once per accident."""
    segment = roads.select(
        "wegvak_id", F.col("road_number_raw").alias("seg_road_raw"),
        F.col("road_number_norm").alias("seg_road_norm"), "is_target_a2",
        "start_hm", "end_hm", "length_m", geo.parts_measured(geo.parts_of(roads)).alias("seg_line"))
    spot = best_point(points.select("point_id", "wegvak_id", "hm", "geom_rd")).select(
        "point_id", F.col("geom_rd").alias("point_geom"))
    placed = lookup_join(staging, segment, "wegvak_id", "accident_id")
    return lookup_join(placed, spot, "point_id", "accident_id")


def locate_accidents(staging: DataFrame, roads: DataFrame, points: DataFrame,
                     casualties: bool = False) -> DataFrame:
    """accidents_norm: best available location of each accident and the label of its source.

    With `casualties` the death and injury counts ride along, which saves later joins back to
    the staging table.
    """
    joined = attach_location(staging, roads, points)
    begin, finish = F.col("start_hm"), F.col("end_hm")
    has_line = F.col("wegvak_id").isNotNull() & F.col("seg_line").isNotNull()
    by_measure = (F.col("hm") - F.least(begin, finish)) / F.abs(finish - begin)
    # without a usable measure range the hm is related to the segment length instead
    by_length = F.col("hm") / F.nullif(F.col("length_m"), F.lit(0.0)) * 1000.0
    share = F.when(begin.isNotNull() & finish.isNotNull() & (F.abs(finish - begin) > 0),
                   by_measure).otherwise(by_length)
    clamped = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    # one interpolation serves both line-based sources
    joined = joined.withColumn("_share", F.when(F.col("hm").isNotNull(), clamped).otherwise(0.5))
    spot = F.coalesce(
        F.col("geom_direct"), F.col("point_geom"),
        F.when(has_line, geo.on_measured("seg_line", "length_m", "_share")))
    quality = (
        F.when(F.col("geom_direct").isNotNull(), "direct_xy")
        .when(F.col("point_geom").isNotNull(), "puntlocatie")
        .when(has_line & F.col("hm").isNotNull(), "wegvak_hm_interpolated")
        .when(has_line, "wegvak_midpoint_fallback")
        .otherwise("unresolved"))
    extra = ["fatal_count", "injury_count"] if casualties else []
    placed = joined.select(
        "accident_id", "accident_year", "accident_date", "accident_hour", "severity",
        "accident_type", F.coalesce("seg_road_raw", "road_number_raw").alias("road_number_raw"),
        "road_type_raw", F.col("seg_road_norm").alias("road_number_norm"), "wegvak_id", "point_id",
        "hm", spot.alias("geom_rd"), quality.alias("location_quality"),
        F.coalesce("is_target_a2", F.lit(False)).alias("is_target_a2"), *extra)
    at = placed.columns.index("geom_rd") + 1
    wgs = geo.rd_point_to_wgs84("geom_rd").alias("geom_wgs84")
    return placed.select(*placed.columns[:at], wgs, *placed.columns[at:])


def accident_roads(staging: DataFrame, roads: DataFrame) -> DataFrame:
    """Accidents with the road of their segment but without a location.

    Counts along the official km need no geometry, so neither lines nor points are joined.
    """
    segment = roads.select("wegvak_id", "road_number_norm", "is_target_a2")
    bare = staging.drop("road_number_norm", "geom_direct")
    return lookup_join(bare, segment, "wegvak_id", "accident_id")


def attach_casualties(accidents: DataFrame, staging: DataFrame | None) -> DataFrame:
    """Death and injury counts by accident id; kept as they are when already present."""
    if {"fatal_count", "injury_count"} <= set(accidents.columns):
        return accidents
    if staging is None:
        return accidents.withColumns({"fatal_count": F.lit(None).cast("int"),
                                      "injury_count": F.lit(None).cast("int")})
    return accidents.join(
        staging.select("accident_id", "fatal_count", "injury_count"), "accident_id", "left")


def intervals_of(hectointervallen: DataFrame, cmap: ColumnMap | None = None) -> DataFrame:
    """Km intervals typed: wegvak_id, beg_km, end_km."""
    c = (cmap or ColumnMap()).hectointervallen
    return hectointervallen.select(
        role(c.wegvak_id_col).alias("wegvak_id"),
        safe_double(role(c.beg_km_col)).alias("beg_km"),
        safe_double(role(c.end_km_col)).alias("end_km"))


def on_segments(accidents: DataFrame, roads: DataFrame, main_road_only: bool = True,
                direction: str | None = None) -> DataFrame:
    """Accidents whose segment passes the road filters (one row per matching segment)."""
    kept = flt.accident_direction(flt.main_road(roads, main_road_only), direction)
    return accidents.join(kept.select("wegvak_id", "road_number_norm"),
                          ["wegvak_id", "road_number_norm"], "inner")


def attach_intervals(df: DataFrame, intervals: DataFrame, dedupe: bool = False) -> DataFrame:
    """Left join to the km intervals of the segment.

    A segment with several intervals repeats its rows; `dedupe` keeps its first interval only.
    """
    if dedupe:
        first = F.min(F.struct("beg_km", "end_km")).alias("i")
        intervals = intervals.groupBy("wegvak_id").agg(first).select("wegvak_id", "i.beg_km", "i.end_km")
    return df.join(intervals, "wegvak_id", "left")


def road_km(df: DataFrame) -> DataFrame:
    """Official km: the hm mark, else the middle of the interval."""
    return df.withColumn("road_km", F.coalesce(
        F.col("hm") / HM_PER_KM, (F.col("beg_km") + F.col("end_km")) / 2.0))


def select_accidents(accidents: DataFrame, road: str | None = None,
                     year_from: int | None = None, year_to: int | None = None,
                     severities: Sequence[str] | None = None) -> DataFrame:
    return flt.in_severities(flt.in_years(flt.on_road(accidents, road), year_from, year_to),
                             severities)


def km_weights(accidents: DataFrame, roads: DataFrame, intervals: DataFrame,
               main_road_only: bool = True, direction: str | None = None) -> DataFrame:
    """(road, km) with the summed counts of all (accident, interval) pairs, no pairs formed.

    An accident with an hm mark counts once per interval of its segment at the same km; one
    without counts once at the middle of each interval. Accidents are first summed per
    (segment, hm), intervals per segment and per (segment, middle), so the joins see one row
    per key on one side and a segment that holds most accidents shrinks before the shuffle.
    The km of rows without any position is NULL.
    """
    totals = ["accidents", "fatal", "injury"]
    grouped = accidents.groupBy("road_number_norm", "wegvak_id", "hm").agg(
        F.count(F.lit(1)).alias("accidents"),
        F.count_if(F.coalesce("fatal_count", F.lit(0)) > 0).alias("fatal"),
        F.count_if(F.coalesce("injury_count", F.lit(0)) > 0).alias("injury"))
    kept = flt.accident_direction(flt.main_road(roads, main_road_only), direction)
    segments = kept.groupBy("road_number_norm", "wegvak_id").agg(F.count(F.lit(1)).alias("copies"))
    on_road = grouped.join(segments, ["road_number_norm", "wegvak_id"], "inner")

    middle = (F.col("beg_km") + F.col("end_km")) / 2.0
    spots = intervals.groupBy("wegvak_id", middle.alias("middle")).agg(
        F.count(F.lit(1)).alias("spots"))
    repeats = spots.groupBy("wegvak_id").agg(F.sum("spots").alias("spots"))
    # one lookup for both kinds of accidents, so that they are read and grouped once
    places = spots.withColumn("marked", F.lit(False)).unionByName(
        repeats.withColumns({"marked": F.lit(True), "middle": F.lit(None).cast("double")}))
    placed = on_road.withColumn("marked", F.col("hm").isNotNull()).join(
        places, ["wegvak_id", "marked"], "left")
    weight = F.col("copies") * F.coalesce("spots", F.lit(1))
    km = F.coalesce(F.col("hm") / HM_PER_KM, F.col("middle"))
    return placed.groupBy(F.col("road_number_norm").alias("road_number"), km.alias("road_km")).agg(
        *[F.sum(F.col(c) * weight).alias(c) for c in totals])


def limit_points(df: DataFrame, n: int | None = None) -> DataFrame:
    """First n accidents by id (a top-k, not a sort of the whole table); all of them for None."""
    return df if n is None else df.orderBy("accident_id").limit(n)


def road_accidents(accidents: DataFrame, roads: DataFrame, road: str,
                   year_from: int | None = None, year_to: int | None = None,
                   severities: Sequence[str] | None = None, main_road_only: bool = True,
                   direction: str | None = None, limit: int | None = None) -> DataFrame:
    """Located accidents of a road as a point listing: all of them unless a `limit` is given."""
    chosen = flt.has_geometry(
        select_accidents(accidents, road, year_from, year_to, severities), "geom_wgs84")
    listed = on_segments(chosen, roads, main_road_only, direction)
    return limit_points(listed, limit).select(
        "accident_id", "accident_year", "severity", "location_quality", "road_number_norm",
        geo.as_geojson("geom_wgs84", "point").alias("geojson"))
