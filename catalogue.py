"""The registered queries: one function per query over the tables of a scale-factor folder."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtures import SplitTables, Tables
from roadlines.config import AppConfig, ColumnMap
from roadlines.functions import geometry as geo
from roadlines.operators import accidents as ac
from roadlines.operators import bins as bn
from roadlines.operators import chain as ch
from roadlines.operators import classes as cl
from roadlines.operators import filters as flt
from roadlines.operators import joins as jn
from roadlines.operators import roads as rd
from roadlines.operators import stats as st
from roadlines.plans import chain_bins as cb
from roadlines.plans import export as ex
from roadlines.plans import live_bins as lb
from roadlines.plans import profile as pf
from roadlines.plans import validate as va
from roadlines.session import cut, shared_path
from roadlines.sources.delimited import TextFormat, read_delimited
from roadlines.sources.ingest import ingest_all, tables_ready

Query = Callable[[SparkSession, str], DataFrame]
CFG = AppConfig()
ROAD_TEXT = ("wegnr_hmp", "wegbehsrt", "wegnummer", "routeltr", "routenr")
_FUNCTIONS: dict[str, Callable[[Network], DataFrame]] = {}


class Network:
    """Normalised tables over one folder, each planned when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str, cmap: ColumnMap | None = None) -> None:
        self.spark = spark
        self.raw = Tables(spark, sf_dir)
        self.cmap = cmap or ColumnMap()

    @cached_property
    def attributes(self) -> DataFrame:
        return rd.segment_attributes(self.raw.wegvakken, self.cmap)

    @cached_property
    def lines(self) -> DataFrame:
        return self.raw.wegvakgeografie.where(F.col("geom").isNotNull())

    @cached_property
    def roads(self) -> DataFrame:
        return rd.build_roads(self.raw.wegvakken, self.raw.wegvakgeografie, self.cmap)

    @cached_property
    def points(self) -> DataFrame:
        return rd.build_points(self.raw.puntlocaties, self.raw.hectopunten, self.roads, self.cmap)

    @cached_property
    def staging(self) -> DataFrame:
        return ac.stage_accidents(self.raw.accidents, self.cmap)

    @cached_property
    def accidents(self) -> DataFrame:
        return ac.locate_accidents(self.staging, self.roads, self.points, casualties=True)

    @cached_property
    def counted(self) -> DataFrame:
        """Accidents with their road; enough for everything along the official km."""
        return ac.accident_roads(self.staging, self.roads)

    @cached_property
    def intervals(self) -> DataFrame:
        return ac.intervals_of(self.raw.hectointervallen, self.cmap)

    @cached_property
    def stored_roads(self) -> DataFrame:
        """Roads as a written table: the chain steps read them several times."""
        return cut(self.roads)

    @cached_property
    def chain(self) -> DataFrame:
        return cut(ch.build_chain(self.stored_roads))

    @cached_property
    def stored_accidents(self) -> DataFrame:
        """Located accidents as a written table, for the steps that read them twice."""
        points = rd.build_points(self.raw.puntlocaties, self.raw.hectopunten, self.stored_roads, self.cmap)
        return cut(ac.locate_accidents(self.staging, self.stored_roads, points, True))

    @cached_property
    def chainage(self) -> DataFrame:
        return ch.accident_chainage(self.stored_accidents, self.stored_roads, self.chain)

    @cached_property
    def chain_grid(self) -> DataFrame:
        return cb.grid_of(self.chain)

    def bins(self, **options) -> DataFrame:
        options = {"geometry": False, **options}
        return lb.road_bins(self.roads, self.counted, self.intervals, **options)

    @cached_property
    def sized_bins(self) -> DataFrame:
        return self.bins(sizes=CFG.bin_sizes_km)

    @cached_property
    def flagged_bins(self) -> DataFrame:
        """Bins of all sizes with the flag that tells the drawn ones, as a written table."""
        return cut(self.bins(sizes=CFG.bin_sizes_km, drawn=True))

    @cached_property
    def stored_bins(self) -> DataFrame:
        """Drawn bins of all sizes: those that classes, selections and most measures are about."""
        return self.flagged_bins.where("is_drawn")

    @cached_property
    def drawn_bins(self) -> DataFrame:
        return self.bins(sizes=[5], geometry=True)

    @cached_property
    def cube(self) -> DataFrame:
        return cb.chain_bin_cube(self.chainage, self.chain_grid)

    @cached_property
    def chain_defs(self) -> DataFrame:
        return bn.bin_defs(self.chain_grid).select(
            bn.bin_id().alias("bin_id"), "road_number", "bin_size_km", "bin_idx",
            F.col("bin_start").alias("bin_start_m"), F.col("bin_end").alias("bin_end_m"))


def query(fn: Callable[[Network], DataFrame]) -> Callable[[Network], DataFrame]:
    _FUNCTIONS[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    """Queries that start from the driver's tables."""
    return {name: (lambda spark, sf_dir, fn=fn: fn(Network(spark, sf_dir)))
            for name, fn in _FUNCTIONS.items()}


def functions() -> dict[str, Callable[[Network], DataFrame]]:
    """The same queries on a network, which may hold written tables."""
    return dict(_FUNCTIONS)


class StoredNetwork(Network):
    """A network whose tables are written once, as the batch job does, and then queried."""

    def build(self) -> StoredNetwork:
        """Write roads, accidents, chain, chainage and bin cube."""
        for table in (self.roads, self.accidents, self.chain, self.chainage):
            assert table.columns
        return self

    @cached_property
    def roads(self) -> DataFrame:
        built = rd.build_roads(self.raw.wegvakken, self.raw.wegvakgeografie, self.cmap)
        return clustered(built, "road_number_norm", "wegvak_id")

    @cached_property
    def stored_roads(self) -> DataFrame:
        return self.roads

    @cached_property
    def accidents(self) -> DataFrame:
        built = ac.locate_accidents(self.staging, self.roads, self.points, casualties=True)
        return clustered(built, "road_number_norm", "accident_id")

    @cached_property
    def stored_accidents(self) -> DataFrame:
        return self.accidents

    @cached_property
    def counted(self) -> DataFrame:
        return self.accidents

    @cached_property
    def intervals(self) -> DataFrame:
        return cut(ac.intervals_of(self.raw.hectointervallen, self.cmap))

    @cached_property
    def chainage(self) -> DataFrame:
        return cut(ch.accident_chainage(self.accidents, self.roads, self.chain))


def clustered(df: DataFrame, *order: str) -> DataFrame:
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order))


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def xy(prefix: str, digits: int = 4, x: str = "x", y: str = "y") -> list[Column]:
    return [r(f"{prefix}.x", digits).alias(x), r(f"{prefix}.y", digits).alias(y)]


BIN_COLUMNS = ["bin_id", "road_number", "bin_size_km", "bin_start_m", "bin_end_m", "length_m",
               "accident_count", "fatal_count", "injury_count", "year_span"]


def shown(bins: DataFrame) -> DataFrame:
    return bins.select(*BIN_COLUMNS, r("density_per_km_year").alias("density_per_km_year"))


# ---- roads, points, accidents ------------------------------------------------------------

@query
def roads_norm_attrs(n: Network) -> DataFrame:
    return n.roads.select("wegvak_id", "road_number_raw", "road_type_raw", "road_number_norm",
                          "direction", "carriageway", "start_hm", "end_hm", "is_target_a2")


@query
def road_number_general(n: Network) -> DataFrame:
    return rd.normalize_road(n.attributes).select("wegvak_id", "road_number_norm")


@query
def target_flag(n: Network) -> DataFrame:
    return rd.is_target(rd.normalize_road(n.attributes), n.cmap.target).select(
        "wegvak_id", "is_target")


@query
def orient_measures(n: Network) -> DataFrame:
    return rd.orient_measures(n.attributes).select("wegvak_id", "start_hm", "end_hm")


@query
def roads_norm(n: Network) -> DataFrame:
    g = "geom_wgs84"
    return n.roads.select("wegvak_id", "road_number_norm", r("length_m", 4).alias("length_m"),
                          geo.start(g).alias("a"), geo.end(g).alias("z")).select(
        "wegvak_id", "road_number_norm", "length_m",
        *xy("a", 6, "lon_start", "lat_start"), *xy("z", 6, "lon_end", "lat_end"))


@query
def points_dedupe(n: Network) -> DataFrame:
    return rd.dedupe_points(rd.union_points(n.raw.puntlocaties, n.raw.hectopunten, n.cmap))


@query
def best_point(n: Network) -> DataFrame:
    return rd.best_point(n.points.select("point_id", "wegvak_id", "hm", "geom_rd")).select(
        "point_id", "wegvak_id", "hm", *xy("geom_rd"))


@query
def road_points_norm(n: Network) -> DataFrame:
    return n.points.select("point_id", "wegvak_id", "road_number_raw", "road_number_norm", "hm",
                           "is_target_a2", *xy("geom_rd"), *xy("geom_wgs84", 6, "lon", "lat"))


@query
def accidents_staging(n: Network) -> DataFrame:
    return n.staging.select("accident_id", "accident_year", "accident_date", "accident_hour",
                            "severity", "accident_type", "wegvak_id", "point_id", "hm",
                            "fatal_count", "injury_count")


@query
def accidents_norm_attrs(n: Network) -> DataFrame:
    return n.accidents.select("accident_id", "accident_year", "severity", "road_number_raw",
                              "road_number_norm", "wegvak_id", "point_id", "hm",
                              "location_quality", "is_target_a2")


@query
def accidents_norm(n: Network) -> DataFrame:
    return n.accidents.select("accident_id", *xy("geom_rd"), *xy("geom_wgs84", 6, "lon", "lat"),
                              "location_quality")


@query
def accidents_direct_xy(n: Network) -> DataFrame:
    mapped = replace(n.cmap, accidents=replace(n.cmap.accidents, x_col="x_direct", y_col="y_direct"))
    staged = ac.stage_accidents(n.raw.accidents, mapped)
    return ac.locate_accidents(staged, n.roads, n.points).select(
        "accident_id", "location_quality", *xy("geom_rd"))


@query
def casualties(n: Network) -> DataFrame:
    bare = n.counted.drop("fatal_count", "injury_count")
    return flt.on_road(ac.attach_casualties(bare, n.staging), None).groupBy("road_number_norm").agg(
        F.sum("fatal_count").alias("deaths"), F.sum("injury_count").alias("injuries"))


# ---- geometry ----------------------------------------------------------------------------

@query
def line_length(n: Network) -> DataFrame:
    return n.lines.select("fk_veld1", r(geo.length("geom")).alias("length_m"))


@query
def line_centroid(n: Network) -> DataFrame:
    return n.lines.select("fk_veld1", geo.centroid("geom").alias("c")).select(
        "fk_veld1", *xy("c", 6, "cx", "cy"))


@query
def line_envelope(n: Network) -> DataFrame:
    return n.lines.select("fk_veld1", geo.envelope("geom").alias("b")).select(
        "fk_veld1", "b.*")


@query
def line_interpolate(n: Network) -> DataFrame:
    fractions = F.array(*[F.lit(f) for f in (0.0, 0.25, 0.5, 0.9, 1.0)])
    return (n.lines.withColumn("fraction", F.explode(fractions))
            .select("fk_veld1", "fraction",
                    geo.interpolate("geom", "fraction").alias("p"))
            .select("fk_veld1", "fraction", *xy("p")))


@query
def line_locate(n: Network) -> DataFrame:
    """Fraction and distance of a point beside the line (its centroid, moved)."""
    placed = n.lines.withColumn("c", geo.centroid("geom")).withColumn(
        "p", geo.point("c.x + 37D", "c.y - 11D"))
    g, p = "geom", "p"
    return placed.select("fk_veld1", r(geo.locate(g, p)).alias("fraction"),
                         r(geo.distance(g, p)).alias("dist"))


@query
def line_substring(n: Network) -> DataFrame:
    piece = geo.substring("geom", "0.2D", "0.75D")
    return n.lines.select("fk_veld1", piece.alias("g")).select(
        "fk_veld1", r(geo.length("g"), 4).alias("length_m"),
        F.size("g").alias("vertices"))


@query
def line_shape(n: Network) -> DataFrame:
    g = "geom"
    return n.lines.select(
        "fk_veld1", geo.geometry_type(g).alias("geometry_type"), geo.is_valid(g).alias("valid"),
        geo.start(g)["x"].alias("x_start"), geo.start(g)["y"].alias("y_start"),
        geo.end(g)["x"].alias("x_end"), geo.end(g)["y"].alias("y_end"))


@query
def rd_to_wgs84_round_trip(n: Network) -> DataFrame:
    wgs = n.lines.withColumn("w", geo.rd_to_wgs84("geom")).withColumn(
        "b", geo.wgs84_to_rd("w"))
    both = F.posexplode(F.arrays_zip("w", "b")).alias("seq", "v")
    return wgs.select("fk_veld1", both).select(
        "fk_veld1", "seq", *xy("v.w", 7, "lon", "lat"), *xy("v.b", 2, "x_back", "y_back"))


@query
def line_geojson(n: Network) -> DataFrame:
    """GeoJSON text of each line, read back to vertices."""
    text = n.lines.withColumn("t", geo.as_geojson("geom"))
    parts = text.withColumn("parts", geo.from_geojson_line("t"))
    one = geo.dump(parts.select("fk_veld1", "t", "parts"), "parts", "g")
    return one.select("fk_veld1", F.get_json_object("t", "$.type").alias("type"),
                      F.posexplode("g").alias("seq", "v")).select(
        "fk_veld1", "seq", "type", *xy("v"))


# ---- live bins ---------------------------------------------------------------------------

@query
def road_bins_flagship(n: Network) -> DataFrame:
    return shown(n.bins(sizes=[5], road="A2", year_from=1996, year_to=2000))


@query
def road_bins_all(n: Network) -> DataFrame:
    return shown(n.bins(sizes=[5]))


@query
def road_bins_filtered(n: Network) -> DataFrame:
    return shown(n.bins(sizes=[2], road="A2", year_from=1996, year_to=1999,
                        severities=["DOD", "LET"]))


@query
def road_bins_direction(n: Network) -> DataFrame:
    return shown(n.bins(sizes=[5], main_road_only=False, direction="T"))


@query
def road_bins_sizes(n: Network) -> DataFrame:
    return shown(n.sized_bins)


@query
def km_extent(n: Network) -> DataFrame:
    return lb.km_extent(lb.drawn_intervals(n.roads, n.intervals))


@query
def bin_defs(n: Network) -> DataFrame:
    return bn.bin_defs(bn.km_grid(km_extent(n)))


@query
def bins_clip(n: Network) -> DataFrame:
    segments = lb.drawn_intervals(n.roads, n.intervals)
    grid = bn.km_grid(lb.km_extent(segments), [5])
    clips = bn.clip_segments(segments.where(F.col("end_km") != F.col("beg_km")), grid,
                             "beg_km", "end_km")
    return clips.select("road_number", "bin_idx", "wegvak_id", r("beg_km", 4).alias("beg_km"),
                        r(geo.length("geom_clip"), 4).alias("clip_m"))


@query
def bins_geometry(n: Network) -> DataFrame:
    return n.drawn_bins.select("bin_id", "geometry_quality",
                               r(geo.parts_length("geom_parts"), 3).alias("drawn_m"),
                               F.size("geom_parts").alias("n_parts"))


@query
def bins_geojson(n: Network) -> DataFrame:
    features = ex.to_features(n.drawn_bins)
    field = lambda path: F.get_json_object("feature", path)
    return features.select(
        field("$.properties.bin_id").alias("bin_id"), field("$.geometry.type").alias("geometry_type"),
        field("$.properties.accident_count").cast("long").alias("accident_count"),
        field("$.type").alias("type"))


@query
def bins_summary(n: Network) -> DataFrame:
    return st.bins_summary(n.drawn_bins, ["road_number"])


@query
def bin_health(n: Network) -> DataFrame:
    return st.bin_health(n.drawn_bins)


def _ribbons(n: Network) -> DataFrame:
    segments = lb.drawn_intervals(n.roads, n.intervals)
    grid = bn.km_grid(lb.km_extent(segments), [5])
    parts = lb.bin_parts(segments, grid)
    dense = n.bins(sizes=[5]).withColumn(
        "bin_idx", F.substring_index(F.substring_index("bin_id", "km_", -1), "_", 1).cast("long"))
    return cl.bin_ribbons(parts.join(
        dense.select("bin_id", *lb.KEYS, "density_per_km_year"), list(lb.KEYS)))


@query
def bin_ribbons(n: Network) -> DataFrame:
    return _ribbons(n).select("bin_id", r("extrusion_height_m", 3).alias("extrusion_height_m"),
                              geo.as_geojson("polygon").alias("ring"))


@query
def bin_ribbon_counts(n: Network) -> DataFrame:
    """Ribbons and their height for each bin; a ribbon has the vertices of its line twice, and is closed."""
    closed = (F.element_at("polygon", 1) == F.element_at("polygon", -1)) & (F.size("polygon") == 2 * F.size("geom") + 1)
    return _ribbons(n).groupBy("bin_id").agg(
        r(F.max("extrusion_height_m"), 3).alias("extrusion_height_m"), F.count(F.lit(1)).alias("n_ribbons"),
        F.count_if(closed).alias("n_closed"))


@query
def segment_ribbons(n: Network) -> DataFrame:
    """The ring around the line of each segment, vertex by vertex."""
    # lines are small next to the work on their vertices: few splits of a file would be few tasks
    lines = n.lines.select("fk_veld1", "geom").repartition(F.xxhash64("fk_veld1", "geom"))
    rings = geo.ribbon(lines, "geom", 15.0)
    # no ring is empty; `posexplode` would have each computed three times, to leave out empty ones
    return rings.select("fk_veld1", F.posexplode_outer("polygon").alias("pos", "v")).select(
        "fk_veld1", "pos", r("v.x", 7).alias("lon"), r("v.y", 7).alias("lat"))


@query
def scored_accidents(n: Network) -> DataFrame:
    return lb.scored_accidents(flt.on_road(n.counted, None), n.roads, n.intervals).select(
        "accident_id", "road_number_norm", "road_km")


@query
def accidents_per_km(n: Network) -> DataFrame:
    return flt.has_km(lb.accidents_per_km(n.counted, n.roads, n.intervals))


@query
def corridor_per_km(n: Network) -> DataFrame:
    return lb.corridor_per_km(n.counted, n.roads, n.intervals, 15.0, 45.0)


def _a2_per_km(n: Network) -> DataFrame:
    return lb.accidents_per_km(n.counted, n.roads, n.intervals, "A2", 1996, 2000)


@query
def tail_km(n: Network) -> DataFrame:
    return lb.tail_km(_a2_per_km(n))


@query
def head_km(n: Network) -> DataFrame:
    return lb.head_km(_a2_per_km(n))


@query
def year_span(n: Network) -> DataFrame:
    return lb.year_span(n.counted)


# ---- listings, summaries, distributions --------------------------------------------------

@query
def road_accidents(n: Network) -> DataFrame:
    listed = ac.road_accidents(n.accidents, n.roads, "A2")
    spot = F.from_json(F.get_json_object("geojson", "$.coordinates"), "array<double>")
    return listed.withColumn("c", spot).select(
        "accident_id", "accident_year", "severity", "location_quality", "road_number_norm",
        r(F.get("c", F.lit(0))).alias("lon"), r(F.get("c", F.lit(1))).alias("lat"))


@query
def road_meta(n: Network) -> DataFrame:
    return st.road_meta(n.accidents, n.roads, raw=n.raw.accidents)


@query
def roads_summary(n: Network) -> DataFrame:
    s = st.roads_summary(n.counted, n.roads, n.intervals, CFG)
    return s.withColumns({c: r(c) for c in ("xmin", "ymin", "xmax", "ymax")})


@query
def road_search(n: Network) -> DataFrame:
    return st.road_search(roads_summary(n), " n231 ")


def _on_roads(n: Network) -> DataFrame:
    return flt.on_road(n.counted, None)


@query
def stats_by_year(n: Network) -> DataFrame:
    return st.count_by(_on_roads(n), "accident_year")


@query
def stats_by_severity(n: Network) -> DataFrame:
    return st.by_count(st.count_by(_on_roads(n), "severity"), "severity")


@query
def stats_by_quality(n: Network) -> DataFrame:
    return st.by_count(st.count_by(flt.on_road(n.accidents, None), "location_quality"), "location_quality")


@query
def severity_labelled(n: Network) -> DataFrame:
    return st.severity_labelled(_on_roads(n))


@query
def severities(n: Network) -> DataFrame:
    return st.severities(n.counted)


@query
def road_totals(n: Network) -> DataFrame:
    return st.road_stats(n.accidents, "A2")["totals"]


# ---- chains ------------------------------------------------------------------------------

@query
def road_axis(n: Network) -> DataFrame:
    axis = ch.road_axis(ch.drawn_segments(n.roads))
    return axis.select("road_number", r("min_x", 4).alias("min_x"), r("min_y", 4).alias("min_y"),
                       r("ux").alias("ux"), r("uy").alias("uy"))


@query
def segment_chain(n: Network) -> DataFrame:
    return n.chain.select("road_number", "wegvak_id", "seg_ord", *[
        r(c, 4).alias(c) for c in ("seg_len_m", "chain_start_m", "chain_end_m")])


@query
def ordered_segments(n: Network) -> DataFrame:
    return ch.chain_measures(ch.order_segments(n.stored_roads)).select(
        "road_number", "wegvak_id", "seg_ord", r("chain_start_m", 4).alias("chain_start_m"))


@query
def chain_total(n: Network) -> DataFrame:
    return ch.chain_total(n.chain).select("road_number", r("total_length_m", 4).alias("total_length_m"))


@query
def wegvak_canonical(n: Network) -> DataFrame:
    return ch.canonical_segments(n.stored_roads, n.chain)


@query
def successor_gaps(n: Network) -> DataFrame:
    return jn.successor_gaps(n.chain).withColumn("jump_m", r("jump_m", 4))


@query
def nearest_segment(n: Network) -> DataFrame:
    hr = flt.main_road(n.stored_roads).select("road_number_norm", "wegvak_id")
    spots = jn.semi(flt.has_geometry(n.stored_accidents), hr, ["road_number_norm", "wegvak_id"]).select(
        F.col("road_number_norm").alias("road_number"), F.col("geom_rd.x").alias("x"),
        F.col("geom_rd.y").alias("y"))
    lines = n.chain.select("road_number", F.col("geom_rd").alias("geom"), "seg_ord")
    near = jn.nearest_join(spots, lines, ["road_number"])
    return near.select("road_number", r("x", 4).alias("x"), r("y", 4).alias("y"), "seg_ord",
                       r("dist", 4).alias("dist"))


@query
def accident_chainage(n: Network) -> DataFrame:
    return n.chainage.select("road_number", "accident_id", "accident_year", "severity", "wegvak_id",
                             r("chain_m", 3).alias("chain_m"))


@query
def chain_bins(n: Network) -> DataFrame:
    return cb.chain_bins(n.chain).select(
        "bin_id", "road_number", "bin_size_km", r("bin_start_m", 4).alias("bin_start_m"),
        r("bin_end_m", 4).alias("bin_end_m"), r("length_m", 4).alias("length_m"),
        "geometry_quality")


@query
def chain_clips(n: Network) -> DataFrame:
    clips = cb.chain_clips(n.chain, n.chain_grid)
    return clips.select("road_number", "bin_size_km", "bin_idx", "wegvak_id",
                        r(geo.length("geom_clip"), 3).alias("clip_m"))


@query
def empty_bins(n: Network) -> DataFrame:
    return cb.empty_bins(n.chain).select("road_number", "bin_size_km", "bin_idx")


@query
def chain_bin_cube(n: Network) -> DataFrame:
    return n.cube.select("bin_id", "road_number", "bin_size_km", "accident_year", "severity",
                         "accident_count", "fatal_count", "injury_count")


@query
def top_bins(n: Network) -> DataFrame:
    top = cb.top_bins(n.chain_defs, n.cube)
    return top.withColumns({c: r(c, 4) for c in ("bin_start_m", "bin_end_m")})


# ---- measures and classes ----------------------------------------------------------------

@query
def bin_kpis(n: Network) -> DataFrame:
    flagged = n.flagged_bins.withColumn("_drawn", F.when(F.col("is_drawn"), True))
    return st.bin_kpis(flagged, drawn="_drawn").select(
        "road_number", "bin_size_km", "total_accidents", r("mean_density").alias("mean_density"),
        "bin_count", r("peak_density").alias("peak_density"), "peak_start_m")


@query
def density_breaks(n: Network) -> DataFrame:
    return cl.density_breaks(n.stored_bins)


@query
def density_classes(n: Network) -> DataFrame:
    return cl.classify(n.stored_bins, cl.density_breaks(n.stored_bins)).select(
        "bin_id", "density_class")


@query
def class_table(n: Network) -> DataFrame:
    return cl.class_table(cl.density_breaks(n.stored_bins)).select(
        "road_number", "bin_size_km", "class", "label", "colour")


@query
def bar_heights(n: Network) -> DataFrame:
    by_density = cl.bar_height(cut(n.sized_bins)).withColumnRenamed("height_pct", "height_density")
    both = cl.bar_height(by_density, "accidents").withColumnRenamed("height_pct", "height_count")
    return both.select("bin_id", r("height_density").alias("height_density"),
                       r("height_count").alias("height_count"))


@query
def selection_overlap(n: Network) -> DataFrame:
    return cl.select_bins(n.stored_bins, km=12).select("bin_id")


@query
def selection_bbox(n: Network) -> DataFrame:
    box = cl.selection_bbox(cl.select_bins(n.drawn_bins, km=12), by=["road_number"])
    return box.where(F.col("xmin").isNotNull()).select(
        "road_number", *[r(c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


@query
def drawn_flags(n: Network) -> DataFrame:
    return n.flagged_bins.select("bin_id", "is_drawn")


def _numbered(n: Network) -> DataFrame:
    index = F.substring_index(F.substring_index("bin_id", "km_", -1), "_", 1).cast("long")
    return n.sized_bins.withColumn("i", index)


@query
def density_repair(n: Network) -> DataFrame:
    """Bins with the density kept, replaced by the older measure, or missing, by turns."""
    d, i = F.col("density_per_km_year"), F.col("i") % 4
    damaged = _numbered(n).withColumns({
        "density_per_km": F.when(i == 1, d * F.col("year_span")),
        "density_per_km_year": F.when(i == 0, d).when(i == 1, float("nan")),
        "year_span": F.when(i != 3, F.col("year_span"))})
    return cl.repair_density(damaged).select(
        "bin_id", r("density_per_km_year").alias("density_per_km_year"), "year_span")


@query
def bin_enrich(n: Network) -> DataFrame:
    """Densities recomputed from bins whose length or span is missing by turns."""
    i = F.col("i")
    damaged = _numbered(n).withColumns({
        "length_m": F.when(i % 3 == 0, F.col("length_m")),
        "bin_end_m": F.when(i % 3 <= 1, F.col("bin_end_m")),
        "year_span": F.when(i % 2 == 0, F.col("year_span"))})
    return cl.enrich(damaged).select(
        "bin_id", r("density_per_km_year").alias("density_per_km_year"), "year_span")


# ---- lines of several parts --------------------------------------------------------------

class SplitNetwork(Network):
    """A network in which some road lines have two parts."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__(spark, sf_dir)
        self.raw = SplitTables(spark, sf_dir)


def _split(n: Network) -> SplitNetwork:
    return SplitNetwork(n.spark, n.raw.sf_dir)


@query
def multipart_roads(n: Network) -> DataFrame:
    roads = _split(n).roads
    parts = geo.parts_of(roads)
    ends = roads.select("wegvak_id", "road_number_norm", r("length_m", 4).alias("length_m"), F.size(F.expr(parts)).alias("n_parts"),
                        F.get_json_object("geojson", "$.type").alias("geojson_type"),
                        geo.parts_start(parts).alias("a"), geo.parts_end(parts).alias("z"))
    return ends.select("wegvak_id", "road_number_norm", "length_m", F.when(F.col("n_parts") > 0, F.col("n_parts")).alias("n_parts"),
                       "geojson_type", *xy("a", 4, "x_start", "y_start"), *xy("z", 4, "x_end", "y_end"))


@query
def multipart_accidents(n: Network) -> DataFrame:
    return accidents_norm(_split(n))


@query
def multipart_points(n: Network) -> DataFrame:
    return best_point(_split(n))


@query
def multipart_clips(n: Network) -> DataFrame:
    """Drawn length and number of pieces of each segment in each bin."""
    m = _split(n)
    segments = lb.drawn_intervals(m.roads, m.intervals)
    clips = lb.bin_clips(segments, bn.km_grid(lb.km_extent(segments), [5]))
    return clips.groupBy("road_number", "bin_idx", "wegvak_id", r("beg_km", 4).alias("beg_km")).agg(
        r(F.sum(geo.length("geom_clip")), 4).alias("clip_m"), F.count(F.lit(1)).alias("pieces"))


@query
def multipart_chain(n: Network) -> DataFrame:
    return segment_chain(_split(n))


@query
def multipart_chainage(n: Network) -> DataFrame:
    return accident_chainage(_split(n))


@query
def multipart_gaps(n: Network) -> DataFrame:
    return successor_gaps(_split(n))


@query
def multipart_types(n: Network) -> DataFrame:
    return geometry_types(_split(n))


@query
def multipart_boxes(n: Network) -> DataFrame:
    return roads_summary(_split(n))


# ---- sources -----------------------------------------------------------------------------

@query
def delimited_scan(n: Network) -> DataFrame:
    """The accident table written as delimited text, its format sniffed, read back as text."""
    path = shared_path(n.spark, "text")
    n.raw.accidents.write.csv(path, header=True, sep=";", quoteAll=True, emptyValue="",
                              ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = read_delimited(n.spark, path)
    names = [c for c in back.columns if not c.startswith("_")]
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in names])


# ---- profile, validation, export ---------------------------------------------------------

@query
def value_frequencies(n: Network) -> DataFrame:
    return st.value_frequencies(n.raw.wegvakken, ROAD_TEXT, 5)


@query
def road_candidates(n: Network) -> DataFrame:
    return pf.find_road_candidates(n.raw.wegvakken, n.cmap.target, ROAD_TEXT)


@query
def candidate_summary(n: Network) -> DataFrame:
    return pf.candidate_summary(road_candidates(n), n.cmap.target)


@query
def profile_columns(n: Network) -> DataFrame:
    return pf.profile_columns(n.raw.accidents)


@query
def geometry_types(n: Network) -> DataFrame:
    return st.geometry_types(n.roads, geo.parts_of(n.roads), "parts")


@query
def column_fill(n: Network) -> DataFrame:
    return st.column_fill(flt.main_road(n.roads), ["start_hm", "end_hm"], ["road_number_norm"])


@query
def uncovered_km(n: Network) -> DataFrame:
    return va.uncovered_km(n.roads, n.intervals)


@query
def hm_chain_gaps(n: Network) -> DataFrame:
    return rd.hm_chain_gaps(flt.on_road(n.roads, None))


@query
def validation_checks(n: Network) -> DataFrame:
    report = va.validate(n.raw.accidents, n.accidents, n.roads, "A2")
    return report.withColumn("value", r("value", 5))


def _stored(n: Network) -> dict[str, DataFrame]:
    return {"raw_nwb_wegvakken": n.raw.wegvakken, "raw_nwb_puntlocaties": n.raw.puntlocaties,
            "raw_nwb_hectopunten": n.raw.hectopunten,
            "raw_nwb_hectointervallen": n.raw.hectointervallen,
            "raw_bron_accidents": n.raw.accidents, "accidents_staging": n.staging,
            "road_points_norm": n.points, "roads_norm": n.roads, "accidents_norm": n.accidents}


@query
def serving_export_rows(n: Network) -> DataFrame:
    reduced = ex.serving_tables(_stored(n), CFG.roads)
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
              for name, df in reduced.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query
def raw_archive_counts(n: Network) -> DataFrame:
    return ex.archive_counts(_stored(n))


# ---- requests, reports, jobs -------------------------------------------------------------

@query
def bins_request(n: Network) -> DataFrame:
    return shown(lb.requested_bins(n.roads, n.counted, n.intervals, CFG, " a2 ", 5, "all", year_from=1996, year_to=2000, geometry=False))


@query
def road_top_bins(n: Network) -> DataFrame:
    """The busiest bins of the road's bundle of statistics."""
    top = st.road_stats(n.accidents, "A2", cb.top_bins(n.chain_defs, n.cube))["top_bins"]
    return top.withColumns({c: r(c, 4) for c in ("bin_start_m", "bin_end_m")})


@query
def validation_report(n: Network) -> DataFrame:
    """The whole report of the target road, with its chain bins and the busiest ten."""
    report = va.validate(n.raw.accidents, n.stored_accidents, n.stored_roads, "A2", cb.chain_bins(n.chain),
                         cb.top_bins(n.chain_defs, n.cube))
    return report.withColumn("value", r("value", 5))


@query
def target_roads(n: Network) -> DataFrame:
    return flt.target_subset(n.roads).select("wegvak_id", "road_number_raw")


@query
def bars_in_order(n: Network) -> DataFrame:
    """The first ten bars of a chart by count."""
    bins = n.stored_bins.where((F.col("road_number") == "A2") & (F.col("bin_size_km") == 5))
    return cl.bar_order(bins, "accidents").limit(10).select("bin_id", "accident_count")


@query
def first_bins(n: Network) -> DataFrame:
    return st.by_start(n.bins(sizes=[5])).limit(25).select("bin_id", "bin_start_m")


@query
def points_with_road(n: Network) -> DataFrame:
    marks = n.raw.hectopunten.select(F.col("fk_veld5").alias("point_id"), F.col("wvk_id").alias("wegvak_id"))
    return jn.using(marks, n.attributes.select("wegvak_id", "carriageway"), "wegvak_id").groupBy("carriageway").agg(
        F.count(F.lit(1)).alias("points"))


@query
def reattached_years(n: Network) -> DataFrame:
    """Binned accident ids with the year fetched by id."""
    placed = bn.point_in_bin_join(n.chainage.where(F.col("chain_m").isNotNull()).select("road_number", "accident_id", "chain_m"),
                                  n.chain_grid.where(F.col("bin_size_km") == 5), "chain_m")
    return jn.reattach_accidents(placed, n.counted).groupBy("road_number", "bin_idx", "accident_year").agg(
        F.count(F.lit(1)).alias("accident_count"))


@query
def ragged_scan(n: Network) -> DataFrame:
    """Text rows with too many and too few fields, read back without a loss."""
    k = F.col("vkl_nummer").cast("long") % 7
    line = F.when(k == 0, F.concat_ws(";", "vkl_nummer", "jaar_vkl", F.lit("extra;;x"))).when(k == 1, F.col("vkl_nummer")).otherwise(
        F.concat_ws(";", "vkl_nummer", "jaar_vkl"))
    path = shared_path(n.spark, "ragged")
    n.raw.accidents.select(line).write.text(path)
    back = read_delimited(n.spark, path, TextFormat(delimiter=";", header=False, columns=("a", "b")), surplus="keep")
    return back.select("column0", "column1", F.col("_surplus").alias("surplus"))


@query
def ingest_job(n: Network) -> DataFrame:
    """Text files to raw tables in a database of the run's own: rows of each table."""
    spark, before = n.spark, n.spark.catalog.currentDatabase()
    paths = {}
    for name in ("wegvakken", "puntlocaties", "hectopunten", "hectointervallen", "accidents"):
        paths[name] = shared_path(spark, name)
        getattr(n.raw, name).write.csv(paths[name], header=True, sep=";", quoteAll=True, emptyValue="")
    cmap = replace(ColumnMap(), wegvakgeografie=replace(n.cmap.wegvakgeografie, path=None), **{
        k: replace(getattr(n.cmap, k), path=p) for k, p in paths.items()})
    name = f"ingest_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    spark.catalog.setCurrentDatabase(name)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            counts = cut(ingest_all(spark, cmap))
        ready = tables_ready(spark)
    finally:
        spark.catalog.setCurrentDatabase(before)
        spark.sql(f"DROP DATABASE {name} CASCADE")
    return counts.withColumn("served", F.lit(ready))


def _read_back(n: Network, tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    return {name: n.spark.read.parquet(f"{folder}/{name}") for name in tables}


@query
def raw_archive_contents(n: Network) -> DataFrame:
    """Digests of the archive's copies."""
    tables = {k: df for k, df in _stored(n).items() if k.startswith("raw_")}
    folder = shared_path(n.spark, "archive")
    ex.export_raw(tables, folder)
    return ex.digests(_read_back(n, tables, folder))


SERVED_COLUMNS = {
    "roads_norm": ["wegvak_id", "road_number_norm", "direction", "carriageway"],
    "accidents_norm": ["accident_id", "accident_year", "severity", "road_number_norm", "wegvak_id", "point_id", "location_quality"],
    "raw_nwb_hectointervallen": ["wvk_id", "begkm", "endkm"],
    "accidents_staging": ["accident_id", "fatal_count", "injury_count"],
}


@query
def serving_export_contents(n: Network) -> DataFrame:
    """Digests of the copies that the query layer reads."""
    folder = shared_path(n.spark, "serving")
    ex.export_serving(_stored(n), folder, CFG.roads)
    return ex.digests(_read_back(n, SERVED_COLUMNS, folder), SERVED_COLUMNS)
