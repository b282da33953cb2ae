"""Segment chains: order along a road's main axis, running length, accident chainage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlines.config import GEOMETRY_DIRECTION
from roadlines.functions import geometry as geo
from roadlines.functions import shapes as sh
from roadlines.operators import filters as flt
from roadlines.operators import joins
from roadlines.operators.scan import prefix_scan

AXIS_BUCKET_M = 100


def with_parts(roads: DataFrame) -> DataFrame:
    """`roads` with a column for lines of several parts, NULL where the table has none."""
    return roads if "geom_parts" in roads.columns else roads.withColumn(
        "geom_parts", F.lit(None).cast(geo.MULTILINE_TYPE))


def drawn_segments(roads: DataFrame, direction: str | None = GEOMETRY_DIRECTION,
                   road: str | None = None) -> DataFrame:
    """Main-carriageway segments with a line of one part or more; `direction` None keeps all directions."""
    kept = flt.main_road(flt.on_road(with_parts(roads), road)).where("geom_rd IS NOT NULL OR geom_parts IS NOT NULL")
    if direction is not None:
        kept = flt.geometry_direction(kept, direction)
    return kept.withColumn("road_number", F.col("road_number_norm"))


def with_centroid(segments: DataFrame) -> DataFrame:
    return segments.withColumn("centroid", geo.parts_centroid(geo.parts_of(segments)))


def road_axis(segments: DataFrame) -> DataFrame:
    """Per road: corner and unit vector of the diagonal of the centroids' box."""
    x, y = F.col("centroid.x"), F.col("centroid.y")
    box = with_centroid(segments).groupBy("road_number").agg(
        F.min(x).alias("min_x"), F.min(y).alias("min_y"),
        F.max(x).alias("max_x"), F.max(y).alias("max_y"))
    dx, dy = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    axis_len = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1.0))
    return box.select("road_number", "min_x", "min_y", (dx / axis_len).alias("ux"),
                      (dy / axis_len).alias("uy"))


def _along_axis() -> Column:
    return ((F.col("centroid.x") - F.col("min_x")) * F.col("ux")
            + (F.col("centroid.y") - F.col("min_y")) * F.col("uy"))


def on_axis(segments: DataFrame, axis: DataFrame) -> DataFrame:
    """Segments with `proj`, the position of their centroid on the road's axis."""
    return (joins.with_group_row(with_centroid(segments), axis)
            .withColumn("proj", _along_axis())
            .drop("centroid", "min_x", "min_y", "ux", "uy"))


SEGMENT = ("road_number", "wegvak_id", "geom_rd", "geom_parts", "start_hm", "end_hm", "seg_len_m")


def projected_segments(roads: DataFrame, direction: str = GEOMETRY_DIRECTION,
                       road: str | None = None) -> DataFrame:
    """Drawn segments with their axis position."""
    segments = drawn_segments(roads, direction, road)
    return on_axis(segments, road_axis(segments)).withColumnRenamed(
        "length_m", "seg_len_m").select(*SEGMENT, "proj")


def chain_order(projected: DataFrame) -> DataFrame:
    """Rank of each segment along its road (ties by id), without a per-road window."""
    return prefix_scan(projected, ["road_number"], ["proj", "wegvak_id"], rank="seg_ord")


def order_segments(roads: DataFrame, direction: str = GEOMETRY_DIRECTION,
                   road: str | None = None) -> DataFrame:
    """Segments of each road in order of their axis position."""
    return chain_order(projected_segments(roads, direction, road)).drop("proj")


def chain_measures(ordered: DataFrame) -> DataFrame:
    """Start and end metres of ranked segments."""
    summed = prefix_scan(ordered, ["road_number"], ["seg_ord"], sums={"chain_end_m": "seg_len_m"})
    return summed.withColumn("chain_start_m", F.col("chain_end_m") - F.col("seg_len_m"))


def build_chain(roads: DataFrame, direction: str = GEOMETRY_DIRECTION,
                road: str | None = None) -> DataFrame:
    """Chain of each road: segments by axis position, with rank and start and end metres.

    The same as chain_measures(order_segments(...)), with one scan for rank and sum.
    """
    scanned = prefix_scan(projected_segments(roads, direction, road), ["road_number"],
                          ["proj", "wegvak_id"], rank="seg_ord", sums={"chain_end_m": "seg_len_m"})
    return scanned.select(
        *SEGMENT, "seg_ord", (F.col("chain_end_m") - F.col("seg_len_m")).alias("chain_start_m"),
        "chain_end_m")


def chain_total(chain: DataFrame) -> DataFrame:
    """Chain length per road."""
    return chain.groupBy("road_number").agg(
        F.coalesce(F.max("chain_end_m"), F.lit(0.0)).alias("total_length_m"))


def canonical_min(bucketed: DataFrame) -> DataFrame:
    """Lowest segment id, as text, per road and axis bucket."""
    return bucketed.groupBy("road_number", "bucket").agg(F.min("wegvak_id").alias("_lowest"))


def canonical_segments(roads: DataFrame, chain: DataFrame, bucket_m: int = AXIS_BUCKET_M,
                       road: str | None = None) -> DataFrame:
    """Main-carriageway segment -> lowest chain segment id in its axis bucket, else itself.

    The axis here spans both directions, so it differs from the chain's own axis.
    """
    every = drawn_segments(roads, None, road)
    bucketed = on_axis(every, road_axis(every)).select(
        "road_number", "wegvak_id", F.floor(F.col("proj") / bucket_m).alias("bucket"))
    in_chain = bucketed.join(chain.select("road_number", "wegvak_id"),
                             ["road_number", "wegvak_id"], "inner")
    return bucketed.join(canonical_min(in_chain), ["road_number", "bucket"], "left").select(
        "road_number", "wegvak_id",
        F.coalesce("_lowest", "wegvak_id").alias("canonical_wegvak_id"))


def line_parts(chain: DataFrame) -> DataFrame:
    """Each part of each chain segment as a line of its own: its place in the order (seg_ord, part
    number) and the length of the segment's parts before it (part_at)."""
    parts = geo.parts_of(chain)
    sizes = F.transform(F.expr(parts), lambda _g: F.lit(0.0)) if "geom_parts" not in chain.columns else F.expr(
        f"transform({parts}, _g -> {sh.length('_g')})")
    split = chain.select("road_number", "seg_ord", "chain_start_m", "seg_len_m", F.col("wegvak_id").alias("chain_wegvak_id"),
                         sizes.alias("_sizes"), F.posexplode(F.expr(parts)).alias("_no", "geom"))
    before = F.aggregate(F.slice("_sizes", F.lit(1), F.col("_no")), F.lit(0.0), lambda t, x: t + x)
    return split.select("road_number", "geom", F.struct("seg_ord", "_no").alias("place"), before.alias("part_at"),
                        "chain_start_m", "seg_len_m", "chain_wegvak_id")


def snap_accidents(accidents: DataFrame, roads: DataFrame, chain: DataFrame,
                   cell: float = 250.0) -> DataFrame:
    """Accidents with geometry on main-carriageway segments -> place on the nearest chain segment."""
    hr = flt.main_road(roads).select("road_number_norm", "wegvak_id")
    located = joins.semi(flt.has_geometry(accidents), hr, ["road_number_norm", "wegvak_id"])
    spots = located.select(
        "accident_id", "accident_year", "severity", "wegvak_id", "fatal_count", "injury_count",
        F.col("road_number_norm").alias("road_number"),
        F.col("geom_rd.x").alias("x"), F.col("geom_rd.y").alias("y"))
    near = joins.nearest_join(spots.select("road_number", "x", "y"), line_parts(chain), ["road_number"], cell,
                              tie="place", carry=["part_at", "chain_start_m", "seg_len_m", "chain_wegvak_id"])
    share = F.when(F.col("seg_len_m") > 0, (F.col("part_at") + F.col("along")) / F.col("seg_len_m")).otherwise(0.0)
    return spots.join(near, ["road_number", "x", "y"], "inner").withColumn(
        "chain_m", F.col("chain_start_m") + share * F.col("seg_len_m"))


def measure_accidents(accidents: DataFrame, mapping: DataFrame, chain: DataFrame) -> DataFrame:
    """Accidents without geometry -> place on the chain by hm, else mid-segment, else NULL."""
    lost = accidents.where(F.col("geom_rd").isNull()).select(
        "accident_id", "accident_year", "severity", "wegvak_id", "hm", "fatal_count",
        "injury_count", F.col("road_number_norm").alias("road_number"))
    joined = joins.join_coalesced(
        lost, mapping, chain.select("road_number", "wegvak_id", "start_hm", "end_hm",
                                    "chain_start_m", "seg_len_m"))
    begin, finish = F.col("start_hm"), F.col("end_hm")
    width = F.abs(finish - begin)
    share = F.least(F.greatest((F.col("hm") - F.least(begin, finish)) / F.nullif(width, F.lit(0.0)),
                               F.lit(0.0)), F.lit(1.0))
    usable = F.col("hm").isNotNull() & begin.isNotNull() & finish.isNotNull() & (width > 0)
    fraction = F.when(usable, share).otherwise(0.5)
    return joined.withColumn("chain_m", F.col("chain_start_m") + fraction * F.col("seg_len_m"))


def union_chainage(snapped: DataFrame, fallback: DataFrame) -> DataFrame:
    columns = ["road_number", "accident_id", "accident_year", "severity", "wegvak_id", "chain_m",
               "fatal_count", "injury_count"]
    return snapped.select(*columns).unionByName(fallback.select(*columns))


def accident_chainage(accidents: DataFrame, roads: DataFrame, chain: DataFrame,
                      mapping: DataFrame | None = None, cell: float = 250.0) -> DataFrame:
    """Chain position of every accident of the chained roads (NULL when it has none)."""
    mapping = canonical_segments(roads, chain) if mapping is None else mapping
    on_roads = accidents.where(F.col("road_number_norm").isNotNull())
    return union_chainage(snap_accidents(on_roads, roads, chain, cell),
                          measure_accidents(on_roads, mapping, chain))
