"""Checks over the finished tables, as rows (name, value, ok)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlines.functions import geometry as geo
from roadlines.operators import filters as flt
from roadlines.operators import stats
from roadlines.operators.joins import covered_km

# Plausible degrees.
LON_RANGE = (3.0, 8.0)
LAT_RANGE = (50.0, 54.0)
# End of fixed values.


def _row(name: str, value: Column, ok: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"),
                    ok.alias("ok"))


def _rows(df: DataFrame, rows: list[Column]) -> DataFrame:
    return df.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def same_count(raw: DataFrame, norm: DataFrame) -> DataFrame:
    """Raw and normalised accidents have to be equally many."""
    both = raw.select(F.lit(1).alias("r"), F.lit(0).alias("n")).unionByName(
        norm.select(F.lit(0).alias("r"), F.lit(1).alias("n")))
    sums = both.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("raw"),
                    F.coalesce(F.sum("n"), F.lit(0)).alias("norm"))
    yes = F.lit(True)
    return _rows(sums, [_row("raw_accidents", F.col("raw"), yes),
                        _row("normalized_accidents", F.col("norm"), F.col("raw") == F.col("norm"))])


def require_same_count(raw: DataFrame, norm: DataFrame) -> None:
    if not same_count(raw, norm).agg(F.bool_and("ok")).first()[0]:
        raise ValueError("accident row count mismatch: rows were dropped or repeated")


def has_segments(roads: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    sums = roads.agg(n.alias("n"), F.count_if(F.expr(geo.parts_of(roads)).isNull()).alias("lost"))
    return _rows(sums, [_row("segments", F.col("n"), F.col("n") > 0),
                        _row("segments_without_geometry", F.col("lost"), F.lit(True))])


def require_segments(roads: DataFrame) -> None:
    if roads.isEmpty():
        raise ValueError("no target road segments found; check the column map")


def invalid_geometry(bins: DataFrame, geom: str = "geom_rd") -> DataFrame:
    bad = ~F.coalesce(geo.is_valid(geom), F.lit(False))
    sums = bins.agg(F.count_if(F.col("bin_size_km") == 1).alias("n"), F.count_if(bad).alias("bad"))
    return _rows(sums, [_row("bins_1km", F.col("n"), F.lit(True)),
                        _row("invalid_bin_geometries", F.col("bad"), F.lit(True))])


def bbox_inside(roads: DataFrame) -> DataFrame:
    """WGS84 box with its plausibility, and the RD ranges."""
    wgs = stats.bbox(roads, "geom_wgs84")
    lon = F.col("xmin").between(*LON_RANGE) & F.col("xmax").between(*LON_RANGE)
    lat = F.col("ymin").between(*LAT_RANGE) & F.col("ymax").between(*LAT_RANGE)
    no, yes = F.lit(False), F.lit(True)
    degrees = _rows(wgs, [
        _row("lon_min", F.col("xmin"), F.coalesce(lon, no)),
        _row("lat_min", F.col("ymin"), F.coalesce(lat, no)),
        _row("lon_max", F.col("xmax"), F.coalesce(lon, no)),
        _row("lat_max", F.col("ymax"), F.coalesce(lat, no))])
    metres = _rows(stats.bbox(roads, "geom_rd"), [
        _row("rd_x_min", F.col("xmin"), yes), _row("rd_y_min", F.col("ymin"), yes),
        _row("rd_x_max", F.col("xmax"), yes), _row("rd_y_max", F.col("ymax"), yes)])
    return degrees.unionByName(metres)


def unresolved_share(accidents: DataFrame) -> DataFrame:
    """Accidents, unresolved ones and their share; rows may carry a count `n`."""
    weight = F.col("n") if "n" in accidents.columns else F.lit(1).cast("long")
    lost = F.when(F.col("location_quality") == stats.UNRESOLVED, weight)
    zero = F.lit(0).cast("long")
    sums = accidents.agg(F.coalesce(F.sum(weight), zero).alias("n"),
                         F.coalesce(F.sum(lost), zero).alias("lost"))
    share = 100.0 * F.col("lost") / F.greatest(F.col("n"), F.lit(1))
    return _rows(sums, [_row("accidents", F.col("n"), F.lit(True)),
                        _row("unresolved", F.col("lost"), F.lit(True)),
                        _row("unresolved_pct", share, F.lit(True))])


def _distribution(cube: DataFrame, key: str, prefix: str) -> DataFrame:
    named = F.concat(F.lit(prefix), F.coalesce(F.col(key).cast("string"), F.lit("(null)")))
    return cube.groupBy(named.alias("name")).agg(
        F.sum("n").cast("double").alias("value")).withColumn("ok", F.lit(True))


def validate(raw: DataFrame, accidents: DataFrame, roads: DataFrame,
             road: str, bins: DataFrame | None = None, top: DataFrame | None = None) -> DataFrame:
    """The full report of one road: counts, boxes, distributions, busiest bins."""
    # one small cube serves the share and all distributions; its exchange is planned once
    cube = flt.on_road(accidents, road).groupBy(
        "accident_year", "severity", "location_quality").agg(F.count(F.lit(1)).alias("n"))
    segments = flt.on_road(roads, road)
    parts = [same_count(raw, accidents), unresolved_share(cube), has_segments(segments),
             bbox_inside(segments), _distribution(cube, "accident_year", "year_"),
             _distribution(cube, "severity", "severity_"),
             _distribution(cube, "location_quality", "quality_")]
    if bins is not None:
        parts.append(invalid_geometry(bins.where(F.col("road_number") == road)))
    if top is not None:
        parts.append(top.where(F.col("road_number") == road).select(
            F.concat(F.lit("top_"), F.col("bin_id")).alias("name"),
            F.coalesce("accident_count", F.lit(0)).cast("double").alias("value"),
            F.lit(True).alias("ok")))
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report


def issues(report: DataFrame) -> DataFrame:
    return report.where(~F.col("ok"))


def uncovered_km(roads: DataFrame, intervals: DataFrame, road: str | None = None) -> DataFrame:
    """Whole km marks of each road's extent without a drawn-direction interval."""
    drawn = flt.geometry_direction(flt.main_road(flt.on_road(roads, road)))
    pieces = drawn.select("wegvak_id", F.col("road_number_norm").alias("road_number")).join(
        intervals, "wegvak_id")
    extent = pieces.groupBy("road_number").agg(
        F.floor(F.min("beg_km")).cast("long").alias("lo"),
        F.ceil(F.max("end_km")).cast("long").alias("hi"))
    marks = extent.where(F.col("lo") <= F.col("hi")).select(
        "road_number", F.explode(F.sequence("lo", "hi")).alias("km"))
    return marks.join(covered_km(pieces), ["road_number", "km"], "left_anti")
