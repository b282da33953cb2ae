"""Road segments and road points in their normal form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlines.config import ColumnMap, TargetRules
from roadlines.functions import geometry as geo
from roadlines.functions.text import (
    general_road_number, safe_double, target_flag, target_road_number,
)
from roadlines.operators.filters import role
from roadlines.operators.joins import lookup_join
from roadlines.operators.scan import prefix_scan


def with_road_number(df: DataFrame, rules: TargetRules) -> DataFrame:
    """Add road_number_norm by the target rules."""
    return df.withColumn("road_number_norm", target_road_number(
        F.col("road_number_raw"), F.col("route_letter"), F.col("route_number"),
        F.col("road_number_alt"), rules))


def normalize_road(df: DataFrame) -> DataFrame:
    """Add road_number_norm by the general rules (any road, leading zeros dropped)."""
    return df.withColumn("road_number_norm", general_road_number(
        F.col("road_number_raw"), F.col("route_letter"), F.col("route_number")))


def is_target(df: DataFrame, rules: TargetRules) -> DataFrame:
    """Add the boolean is_target by the configured alternatives."""
    return df.withColumn("is_target", target_flag(
        F.col("road_number_norm"), F.col("road_number_raw"), F.col("road_type_raw"),
        F.col("route_letter"), F.col("route_number"), rules))


def orient_measures(df: DataFrame) -> DataFrame:
    """Swap start_hm and end_hm where they run backwards."""
    backwards = F.coalesce(F.col("start_hm") > F.col("end_hm"), F.lit(False))
    return df.withColumns({
        "start_hm": F.when(backwards, F.col("end_hm")).otherwise(F.col("start_hm")),
        "end_hm": F.when(backwards, F.col("start_hm")).otherwise(F.col("end_hm")),
    })


def segment_attributes(wegvakken: DataFrame, cmap: ColumnMap) -> DataFrame:
    c = cmap.wegvakken
    return wegvakken.select(
        role(c.id_col).alias("wegvak_id"),
        role(c.road_number_col).alias("road_number_raw"),
        role(c.road_type_col).alias("road_type_raw"),
        role(c.road_number_alt_col).alias("road_number_alt"),
        role(c.route_letter_col).alias("route_letter"),
        role(c.route_number_col).alias("route_number"),
        role(c.direction_col).alias("direction"),
        role(c.carriageway_col).alias("carriageway"),
        safe_double(role(c.from_hm_col)).alias("start_hm"),
        safe_double(role(c.to_hm_col)).alias("end_hm"),
        F.trim(role(c.fk_col or "FK_VELD1")).alias("_fk"))


def attach_geometry(segments: DataFrame, lines: DataFrame, cmap: ColumnMap) -> DataFrame:
    """Left join to the line table on the trimmed key; adds geom_rd, and geom_parts for lines of several parts.

    Segments without a key are spread out.
    """
    g = cmap.wegvakgeografie
    key = g.join_col or g.id_col or cmap.wegvakken.fk_col or "FK_VELD1"
    line = F.col(f"`{g.geometry_col or 'geom'}`")
    none = F.lit(None).cast(geo.MULTILINE_TYPE)
    parts = F.when(line.isNull() & (F.size("geom_parts") > 0), F.col("geom_parts")) if "geom_parts" in lines.columns else none
    lookup = lines.select(F.trim(role(key)).alias("_fk"), line.alias("geom_rd"), parts.alias("geom_parts"))
    return lookup_join(segments, lookup, "_fk", "wegvak_id")


def build_roads(wegvakken: DataFrame, lines: DataFrame, cmap: ColumnMap) -> DataFrame:
    """roads_norm: attributes, road number, oriented measures, line in RD and WGS84, GeoJSON.

    A line of several parts has its parts in geom_parts, and no geom_rd and geom_wgs84; its
    length is that of the parts, and its GeoJSON a MultiLineString.
    """
    attributes = segment_attributes(wegvakken, cmap)
    based = attach_geometry(attributes, lines, cmap)
    parts = geo.parts_of(based)
    named = orient_measures(with_road_number(based, cmap.target)).withColumn("_parts_wgs84", geo.parts_to_wgs84(parts))
    return named.select(
        "wegvak_id", "road_number_raw", "road_type_raw", "road_number_norm",
        F.col("road_type_raw").alias("road_type"), "direction", "carriageway",
        "start_hm", "end_hm", geo.parts_length(parts).alias("length_m"),
        (F.col("road_number_norm") == cmap.target.canonical_road_number).alias("is_target_a2"),
        "geom_rd", geo.rd_to_wgs84("geom_rd").alias("geom_wgs84"),
        geo.as_geojson("_parts_wgs84", "parts").alias("geojson"), "geom_parts")


def union_points(puntlocaties: DataFrame, hectopunten: DataFrame, cmap: ColumnMap) -> DataFrame:
    """Both point sources in one shape: coordinates from one, segment and hm from the other."""
    p, h = cmap.puntlocaties, cmap.hectopunten
    located = puntlocaties.select(
        role(p.point_id_col).alias("point_id"),
        F.lit(None).cast("string").alias("wegvak_id"),
        F.lit(None).cast("double").alias("hm"),
        safe_double(role(p.x_col)).alias("x_rd"),
        safe_double(role(p.y_col)).alias("y_rd"))
    marked = hectopunten.select(
        role(h.point_id_col).alias("point_id"),
        role(h.wegvak_id_col).alias("wegvak_id"),
        safe_double(role(h.hm_col)).alias("hm"),
        F.lit(None).cast("double").alias("x_rd"),
        F.lit(None).cast("double").alias("y_rd"))
    return located.unionByName(marked)


def dedupe_points(points: DataFrame) -> DataFrame:
    """One row per point id: coordinates first, then lowest hm, then lowest segment id.

    A minimum over a struct keeps one row per id in each map task, so a point id that holds
    most of the rows never gathers in one sort as it would under a row_number window.
    """
    def last_if_null(name: str) -> list:
        return [F.col(name).isNull().alias(f"_{name}_null"), F.col(name)]

    best = F.min(F.struct(
        F.col("x_rd").isNull().alias("_no_xy"), *last_if_null("hm"),
        *last_if_null("wegvak_id"), *last_if_null("x_rd"), *last_if_null("y_rd")))
    return (points.groupBy("point_id").agg(best.alias("b"))
            .select("point_id", "b.wegvak_id", "b.hm", "b.x_rd", "b.y_rd"))


def attach_road(points: DataFrame, roads: DataFrame) -> DataFrame:
    """Left join to the segments; adds road names and a point in RD."""
    lookup = roads.select("wegvak_id", "road_number_raw", "road_number_norm", "is_target_a2",
                          "start_hm", "end_hm", "length_m", geo.parts_measured(geo.parts_of(roads)).alias("_line"))
    joined = lookup_join(points, lookup, "wegvak_id", "point_id")
    begin, finish = F.coalesce("start_hm", F.lit(0.0)), F.coalesce("end_hm", F.lit(0.0))
    # a measure range of zero gives NULL, and greatest() skips it: the start of the line
    share = (F.col("hm") - begin) / F.nullif(F.abs(finish - begin), F.lit(0.0))
    placed = joined.withColumn("_share", F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
    return placed.withColumn(
        "geom_rd",
        F.when(F.col("x_rd").isNotNull() & F.col("y_rd").isNotNull(), geo.point("x_rd", "y_rd"))
        .when(F.col("wegvak_id").isNotNull() & F.col("hm").isNotNull()
              & F.col("_line").isNotNull(), geo.on_measured("_line", "length_m", "_share"))
    ).drop("_line", "_share", "length_m")


def build_points(puntlocaties: DataFrame, hectopunten: DataFrame, roads: DataFrame,
                 cmap: ColumnMap) -> DataFrame:
    """road_points_norm: one row per point id with its place on the network."""
    placed = attach_road(dedupe_points(union_points(puntlocaties, hectopunten, cmap)), roads)
    return placed.select(
        "point_id", "wegvak_id", "road_number_raw", "road_number_norm", "hm",
        F.coalesce("is_target_a2", F.lit(False)).alias("is_target_a2"), "geom_rd",
        geo.rd_point_to_wgs84("geom_rd").alias("geom_wgs84"))


def best_point(points: DataFrame) -> DataFrame:
    """One row per point id, a located one if there is any (ties: lowest segment id)."""
    payload = [c for c in points.columns if c not in ("point_id", "wegvak_id")]
    best = F.min_by(
        F.struct("wegvak_id", *payload),
        F.struct(F.col("geom_rd").isNull(), F.coalesce("wegvak_id", F.lit("")),
                 F.coalesce("hm", F.lit(0.0))))
    return (points.groupBy("point_id").agg(best.alias("b"))
            .select("point_id", "b.wegvak_id", *[f"b.{c}" for c in payload]))


def hm_chain(roads: DataFrame, bucket: int = 100, min_jump: float = 100.0) -> DataFrame:
    """Segments kept one per hm bucket (the longest), chained by hm, with the jump to the next."""
    hr = roads.where((F.coalesce("carriageway", F.lit("")) == "HR") & F.col("length_m").isNotNull())
    parts = geo.parts_of(hr)
    measured = hr.select(
        F.col("road_number_norm").alias("road_number"), "wegvak_id", geo.parts_start(parts).alias("first"),
        geo.parts_end(parts).alias("last"), F.col("length_m").alias("seg_len_m"),
        ((F.coalesce("start_hm", "end_hm", F.lit(0.0)) + F.coalesce("end_hm", "start_hm", F.lit(0.0)))
         / 2.0).alias("hm_mid"))
    longest = (
        measured.groupBy("road_number", F.floor(F.col("hm_mid") / bucket).alias("hm_bucket"))
        .agg(F.min(F.struct((-F.col("seg_len_m")).alias("neg"), "wegvak_id", "hm_mid",
                            "first", "last")).alias("s"))
        .select("road_number", "hm_bucket", "s.wegvak_id", "s.hm_mid", "s.first", "s.last",
                (-F.col("s.neg")).alias("seg_len_m")))
    chained = prefix_scan(longest, ["road_number"], ["hm_mid", "wegvak_id"], rank="seg_ord",
                          sums={"chain_end_m": "seg_len_m"})
    following = chained.select("road_number", (F.col("seg_ord") - 1).alias("seg_ord"),
                               F.col("first").alias("next"))
    return (
        chained.join(following, ["road_number", "seg_ord"], "left")
        .withColumn("chain_start_m", F.col("chain_end_m") - F.col("seg_len_m"))
        .withColumn("jump_m", geo.gap("last", "next"))
        .withColumn("is_gap", F.coalesce(F.col("jump_m") > min_jump, F.lit(False)))
        .drop("first", "last", "next"))


def hm_chain_gaps(roads: DataFrame, bucket: int = 100, min_jump: float = 100.0) -> DataFrame:
    """Per road: kept segments, chain length in km, gaps above `min_jump`, largest gap."""
    return hm_chain(roads, bucket, min_jump).groupBy("road_number").agg(
        F.count(F.lit(1)).alias("segments"),
        F.round(F.max("chain_end_m") / 1000.0, 1).alias("chain_km"),
        F.count_if("is_gap").alias("gaps"),
        F.round(F.max(F.when(F.col("is_gap"), F.col("jump_m"))), 0).alias("max_jump_m"))
