"""Counts, distributions, extents and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlines.config import AppConfig
from roadlines.functions import geometry as geo
from roadlines.functions import shapes as sh
from roadlines.operators import filters as flt
from roadlines.operators.joins import cross_one

UNRESOLVED = "unresolved"


def row_counts(df: DataFrame, by: str | None = None) -> DataFrame:
    count = F.count(F.lit(1)).alias("rows")
    return df.agg(count) if by is None else df.groupBy(by).agg(count)


def count_by(df: DataFrame, key: str, by: Sequence[str] = ("road_number_norm",)) -> DataFrame:
    """Accident count per value of `key`; NULL is a group of its own."""
    return df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("accident_count"))


def by_count(df: DataFrame, key: str, count: str = "accident_count") -> DataFrame:
    """Most frequent first, ties by the value."""
    return df.orderBy(F.col(count).desc(), F.col(key).asc_nulls_last())


def by_start(df: DataFrame) -> DataFrame:
    return df.orderBy("road_number", "bin_size_km", "bin_start_m")


def severity_labelled(df: DataFrame, by: Sequence[str] = ("road_number_norm",)) -> DataFrame:
    return count_by(df.withColumn("severity", F.coalesce("severity", F.lit("(null)"))),
                    "severity", by)


def severities(df: DataFrame, road: str | None = None) -> DataFrame:
    """Distinct severities that occur, per road or of one road in order."""
    known = flt.on_road(df, road).where(F.col("severity").isNotNull())
    if road is None:
        return known.select("road_number_norm", "severity").distinct()
    return known.select("severity").distinct().orderBy("severity")


def bbox(df: DataFrame, geom: str = "geom_wgs84", by: Sequence[str] = ()) -> DataFrame:
    """Box around all lines, per group.

    Lines of several parts (`geom_parts`, in RD) take part in the box of geom_rd, and turned to
    degrees in that of geom_wgs84.
    """
    box = geo.envelope(geom)
    if "geom_parts" in df.columns and geom in ("geom_rd", "geom_wgs84"):
        parts = sh.parts_to_wgs84("geom_parts") if geom == "geom_wgs84" else "geom_parts"
        box = F.coalesce(box, geo.parts_envelope(parts))
    boxed = df.select(*by, box.alias("box"))
    edges = [F.min("box.xmin").alias("xmin"), F.min("box.ymin").alias("ymin"),
             F.max("box.xmax").alias("xmax"), F.max("box.ymax").alias("ymax")]
    if not by:
        return boxed.agg(*edges)
    # groups without a box go after they are summed up: a filter of rows would be moved down to the scan,
    # which would draw each line there once more for every edge of its box
    return boxed.groupBy(*by).agg(*edges, F.count("box").alias("_boxes")).where(F.col("_boxes") > 0).drop("_boxes")


def road_bbox(roads: DataFrame, intervals: DataFrame, road: str | None = None) -> DataFrame:
    """WGS84 box per road over drawn segments that have a km interval."""
    drawn = flt.geometry_direction(flt.main_road(flt.on_road(roads, road)))
    known = drawn.join(intervals.select("wegvak_id"), "wegvak_id", "left_semi")
    return bbox(known, "geom_wgs84", ["road_number_norm"])


def configured(df: DataFrame, cfg: AppConfig) -> DataFrame:
    """The configured roads as rows (a driver constant)."""
    return df.sparkSession.createDataFrame(
        [(r,) for r in cfg.roads], "road_number string")


def roads_summary(accidents: DataFrame, roads: DataFrame, intervals: DataFrame,
                  cfg: AppConfig) -> DataFrame:
    """Segments, accidents and box of every configured road, in one pass over each table."""
    def per_road(df: DataFrame, name: str) -> DataFrame:
        kept = df.where(F.col("road_number_norm").isin(*cfg.roads))
        return kept.groupBy(F.col("road_number_norm").alias("road_number")).agg(
            F.count(F.lit(1)).alias(name))

    boxes = road_bbox(roads.where(F.col("road_number_norm").isin(*cfg.roads)), intervals)
    return (
        configured(roads, cfg)
        .join(per_road(roads, "segment_count"), "road_number", "left")
        .join(per_road(accidents, "accident_count"), "road_number", "left")
        .join(boxes.withColumnRenamed("road_number_norm", "road_number"), "road_number", "left")
        .fillna(0, ["segment_count", "accident_count"])
        .withColumn("status", F.lit("implemented")))


def road_search(summary: DataFrame, q: str | None) -> DataFrame:
    """The summary, plus a row for the searched road when it is not among them."""
    if not q:
        return summary
    wanted = summary.sparkSession.createDataFrame([(q.strip().upper(),)], "road_number string")
    missing = wanted.join(summary.select("road_number"), "road_number", "left_anti").select(
        "road_number", F.lit(0).cast("long").alias("segment_count"),
        F.lit(0).cast("long").alias("accident_count"),
        F.lit("not_implemented_yet").alias("status"))
    return summary.unionByName(missing, allowMissingColumns=True)


def road_meta(accidents: DataFrame, roads: DataFrame, road: str | None = None,
              raw: DataFrame | None = None) -> DataFrame:
    """Per road: accidents, unresolved ones, segments, main segments, years, severities, total.

    The total counts the raw accidents, or the normalised ones when there are no raw ones. It
    is summed per partition and attached as a scalar.
    """
    a = flt.on_road(accidents, road).groupBy("road_number_norm").agg(
        F.count(F.lit(1)).alias("road_accident_count"),
        F.count_if(F.col("location_quality") == UNRESOLVED).alias("road_unresolved_count"),
        F.min("accident_year").alias("year_from"), F.max("accident_year").alias("year_to"),
        F.array_join(F.array_sort(F.collect_set("severity")), ",").alias("severities"))
    r = flt.on_road(roads, road).groupBy("road_number_norm").agg(
        F.count(F.lit(1)).alias("road_segment_count"),
        F.count_if(F.coalesce("carriageway", F.lit("")) == "HR")
        .alias("road_mainroad_segment_count"))
    total = (accidents if raw is None else raw).agg(
        F.count(F.lit(1)).alias("total_accident_count"))
    merged = a.join(r, "road_number_norm", "full").fillna(0, [
        "road_accident_count", "road_unresolved_count", "road_segment_count",
        "road_mainroad_segment_count"])
    return cross_one(merged, total)


def column_fill(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows, filled rows, minimum and maximum of each column."""
    checks = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        checks += [F.count(c).alias(f"{c}_filled"), F.min(c).alias(f"{c}_min"),
                   F.max(c).alias(f"{c}_max")]
    return df.groupBy(*by).agg(*checks) if by else df.agg(*checks)


def value_frequencies(df: DataFrame, columns: Sequence[str], n: int | None = 30) -> DataFrame:
    """Most frequent filled values of every column, from one pass over the table.

    The columns are turned to rows and counted with map-side partial sums; only distinct
    values are shuffled. `n` None keeps all values.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
        for c in columns])).alias("p")
    counted = (df.select(pairs).select("p.column", "p.value")
               .where(F.col("value").isNotNull() & (F.col("value") != ""))
               .groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows")))
    if n is None:
        return counted
    rank = Window.partitionBy("column").orderBy(F.col("rows").desc(), "value")
    return (counted.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= n)
            .drop("_rank"))


def geometry_types(df: DataFrame, geom: str, kind: str = "line") -> DataFrame:
    """Rows per geometry type; `geom` names a column or is SQL text for a line or its parts."""
    return df.groupBy(geo.geometry_type(geom, kind).alias("geometry_type")).agg(
        F.count(F.lit(1)).alias("rows"))


def bin_kpis(bins: DataFrame, by: Sequence[str] = ("road_number", "bin_size_km"),
             drawn: str = "geojson") -> DataFrame:
    """Accidents over all bins; mean density, number and peak over the bins with a geometry."""
    has = F.col(drawn).isNotNull()
    d = F.col("density_per_km_year")
    peak = F.max(F.when(has, F.struct(d.alias("d"), (-F.col("bin_start_m")).alias("s"),
                                      F.col("bin_end_m").alias("e"))))
    return (
        bins.groupBy(*by).agg(
            F.sum("accident_count").alias("total_accidents"),
            F.coalesce(F.avg(F.when(has, d)), F.lit(0.0)).alias("mean_density"),
            F.count_if(has).alias("bin_count"), peak.alias("p"))
        .select(*by, "total_accidents", "mean_density", "bin_count",
                F.col("p.d").alias("peak_density"), (-F.col("p.s")).alias("peak_start_m"),
                F.col("p.e").alias("peak_end_m")))


def bins_summary(bins: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Features (bins with geometry) and accidents (all bins)."""
    sums = [F.count("geojson").alias("feature_count"),
            F.coalesce(F.sum("accident_count"), F.lit(0)).alias("accident_count")]
    return bins.groupBy(*by).agg(*sums) if by else bins.agg(*sums)


def bin_health(bins: DataFrame, min_ratio: float = 0.5,
               by: Sequence[str] = ("road_number", "bin_size_km")) -> DataFrame:
    """Multi-part, empty and thin bins (drawn length below a share of the nominal one)."""
    parts, nominal = F.col("geom_parts"), F.col("length_m")
    thin = parts.isNull() | (nominal <= 0) | (
        geo.parts_length("geom_parts") < min_ratio * nominal)
    return bins.groupBy(*by).agg(
        F.count(F.lit(1)).alias("bins"),
        F.count_if(F.size(parts) > 1).alias("multi_part"),
        F.count_if(F.col("geometry_quality") == "empty").alias("empty"),
        F.count_if(F.coalesce(thin, F.lit(True))).alias("thin"),
        (F.min("bin_start_m") / 1000.0).alias("km_from"),
        (F.max("bin_end_m") / 1000.0).alias("km_to"),
        F.sum("accident_count").alias("accidents"))


def road_stats(accidents: DataFrame, road: str, top: DataFrame | None = None) -> dict[str, DataFrame]:
    """Totals, distributions and (when bins are given) the busiest bins of a road."""
    chosen = flt.on_road(accidents, road)
    stats = {
        "totals": chosen.agg(
            F.count(F.lit(1)).alias("total_accidents"),
            F.count_if(F.col("location_quality") == UNRESOLVED).alias("unresolved_accidents")),
        "by_year": count_by(chosen, "accident_year", ()).orderBy(
            F.col("accident_year").asc_nulls_last()),
        "by_severity": by_count(count_by(chosen, "severity", ()), "severity"),
        "by_location_quality": by_count(
            count_by(chosen, "location_quality", ()), "location_quality"),
    }
    if top is not None:
        stats["top_bins"] = top.where(F.col("road_number") == road.upper()).orderBy(
            F.col("accident_count").desc_nulls_last(), "bin_start_m")
    return stats
