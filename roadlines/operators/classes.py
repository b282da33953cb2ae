"""Density repair, class breaks, classes, bar heights and selections over bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlines.functions import geometry as geo
from roadlines.operators.scan import prefix_scan

# Percentiles, default breaks, colours, lowest positive density, extrusion scale.
PERCENTILES = (25, 50, 75, 90)
DEFAULT_BREAKS = (6, 11, 16, 22)
CLASS_COLOURS = ("#e8e8e8", "#fee5d9", "#fcbba1", "#fc9272", "#fb6a4a", "#a50f15")
LOWEST = 0.01
MIN_BAR_PCT = 4.0
FALLBACK_SPAN = 10
EXTRUSION_M_PER_DENSITY = 1000.0
# End of fixed values.


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _have(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")


def bin_length_km(df: DataFrame) -> Column:
    """Length in km: length_m, else the bounds, else the nominal size, else zero."""
    length, lo, hi, size = (_have(df, n) for n in (
        "length_m", "bin_start_m", "bin_end_m", "bin_size_km"))
    return (F.when(_finite(length) & (length > 0), length / 1000.0)
            .when(_finite(lo) & _finite(hi) & (hi > lo), (hi - lo) / 1000.0)
            .when(_finite(size) & (size > 0), size).otherwise(0.0))


def enrich(df: DataFrame, span: int = FALLBACK_SPAN) -> DataFrame:
    """Recompute the density from count, length and span, with fallbacks for the latter two."""
    years = _have(df, "year_span")
    used = F.when(_finite(years) & (years > 0), years).otherwise(float(span))
    km = bin_length_km(df)
    count = F.coalesce(_have(df, "accident_count"), F.lit(0.0))
    return df.withColumns({
        "density_per_km_year": F.when(km > 0, count / km / used).otherwise(0.0),
        "year_span": used})


def repair_density(df: DataFrame) -> DataFrame:
    """Keep a finite density, else derive it from the older measure, else from the count."""
    now, older = _have(df, "density_per_km_year"), _have(df, "density_per_km")
    years = F.greatest(F.coalesce(F.nullif(_have(df, "year_span").cast("int"), F.lit(0)), F.lit(1)),
                       F.lit(1))
    count = F.coalesce(_have(df, "accident_count"), F.lit(0.0))
    length = F.coalesce(_have(df, "length_m"), F.lit(0.0))
    # the span is filled in only where the density had to come from the count
    derived = ~_finite(now) & ~_finite(older)
    return df.withColumns({
        "density_per_km_year": F.when(_finite(now), now).when(_finite(older), older / years)
        .when(length > 0, count / (length / 1000.0) / years).otherwise(0.0),
        "year_span": F.when(derived, F.coalesce(_have(df, "year_span").cast("int"), years))
        .otherwise(_have(df, "year_span").cast("int"))})


def _rounded(v: Column) -> Column:
    """Break value: at least one; whole below ten, even from ten on."""
    return (F.when(v <= 0, F.lit(1.0)).when(v < 10, F.greatest(F.lit(1.0), F.round(v)))
            .otherwise(F.round(v / 2.0) * 2.0)).cast("long")


def density_breaks(bins: DataFrame, by: Sequence[str] = ("road_number", "bin_size_km")) -> DataFrame:
    """Class breaks t1..t4 per group at exact nearest-rank percentiles of the densities.

    Equal densities are counted first, then ranked by a distributed running sum; a group of any
    size is never sorted in one task.
    """
    by = list(by)
    value = F.coalesce(F.col("density_per_km_year"), F.lit(0.0))
    counted = bins.groupBy(*by, value.alias("d")).agg(F.count(F.lit(1)).alias("n"))
    ranked = prefix_scan(counted, by, ["d"], sums={"upto": "n"})
    size = ranked.groupBy(*by).agg(F.max("upto").alias("size"))
    placed = ranked.join(size, by)
    picks = []
    for p in PERCENTILES:
        wanted = F.floor((F.col("size") - 1) * (p / 100.0) + 0.5) + 1
        hit = (F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted)
        picks.append(F.max(F.when(hit, F.col("d"))).alias(f"p{p}"))
    q = placed.groupBy(*by).agg(*picks)
    t1 = _rounded(F.col("p25"))
    with_1 = q.withColumn("t1", t1)
    with_2 = with_1.withColumn("t2", F.greatest(F.col("t1") + 1, _rounded(F.col("p50"))))
    with_3 = with_2.withColumn("t3", F.greatest(F.col("t2") + 1, _rounded(F.col("p75"))))
    return with_3.withColumn("t4", F.greatest(F.col("t3") + 1, _rounded(F.col("p90")))).select(
        *by, "t1", "t2", "t3", "t4")


def class_table(breaks: DataFrame, by: Sequence[str] = ("road_number", "bin_size_km")) -> DataFrame:
    """Legend rows per group: class 0 (zero) to 5, bounds, label and colour."""
    t = [F.col(f"t{i}").cast("double") for i in range(1, 5)]
    bounds = [(F.lit(0.0), F.lit(0.0)), (F.lit(LOWEST), t[0]), (t[0], t[1]), (t[1], t[2]),
              (t[2], t[3]), (t[3], F.lit(None).cast("double"))]
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("class"), lo.alias("min"), hi.alias("max"),
                 F.lit(CLASS_COLOURS[i]).alias("colour")) for i, (lo, hi) in enumerate(bounds)]))
    lo, hi = F.col("r.min").cast("long").cast("string"), F.col("r.max").cast("long").cast("string")
    label = (F.when(F.col("r.class") == 0, "0").when(F.col("r.max").isNull(), F.concat(lo, F.lit("+")))
             .when(F.col("r.class") == 1, F.concat(F.lit("< "), hi))
             .otherwise(F.concat(lo, F.lit("–"), hi)))
    return breaks.select(*by, rows.alias("r")).select(*by, "r.*", label.alias("label"))


def classify(bins: DataFrame, breaks: DataFrame | None = None,
             by: Sequence[str] = ("road_number", "bin_size_km")) -> DataFrame:
    """Add `density_class`: 0 for none, then the highest class whose break is reached."""
    d = F.coalesce(F.col("density_per_km_year"), F.lit(0.0))
    if breaks is None:
        joined = bins.withColumns({f"t{i + 1}": F.lit(b) for i, b in enumerate(DEFAULT_BREAKS)})
    else:
        joined = bins.join(breaks, list(by), "left")
        joined = joined.withColumns({
            f"t{i + 1}": F.coalesce(f"t{i + 1}", F.lit(b)) for i, b in enumerate(DEFAULT_BREAKS)})
    number = F.when(d <= 0, 0)
    for i in range(4, 0, -1):
        number = number.when(d >= F.col(f"t{i}"), i + 1)
    return joined.withColumn("density_class", number.otherwise(1)).drop("t1", "t2", "t3", "t4")


def bar_height(bins: DataFrame, mode: str = "km",
               by: Sequence[str] = ("road_number", "bin_size_km")) -> DataFrame:
    """Add `height_pct` relative to the group's highest value (density, or count)."""
    v = F.col("accident_count" if mode == "accidents" else "density_per_km_year").cast("double")
    # the maximum is taken by an aggregate with partial sums and joined back
    top = bins.groupBy(*by).agg(F.greatest(F.max(v), F.lit(1.0)).alias("_top"))
    share = v / F.col("_top") * 100.0
    return bins.join(top, list(by)).withColumn(
        "height_pct", F.greatest(share, F.when(v > 0, MIN_BAR_PCT).otherwise(0.0))).drop("_top")


def bar_order(bins: DataFrame, mode: str = "km") -> DataFrame:
    if mode == "accidents":
        return bins.orderBy(F.col("accident_count").desc(), "bin_start_m")
    return bins.orderBy("bin_start_m")


def select_bins(bins: DataFrame, bin_id: str | None = None, km: int | None = None) -> DataFrame:
    """The bin of an id, or all bins that overlap the km from `km` to `km` + 1; none without both."""
    if bin_id is not None:
        return bins.where(F.col("bin_id") == bin_id)
    if km is None:
        return bins.where(F.lit(False))
    return bins.where((F.col("bin_start_m") < (km + 1) * 1000.0)
                      & (F.col("bin_end_m") > km * 1000.0))


def selection_bbox(bins: DataFrame, parts: str = "geom_parts", by: Sequence[str] = ()) -> DataFrame:
    """Box in degrees of the finite coordinates of the chosen bins' line parts (RD); NULLs when there are none."""
    flat = F.flatten(F.col(parts))
    finite = F.filter(flat, lambda v: _finite(v["x"]) & _finite(v["y"]))
    boxed = bins.select(*by, finite.alias("v")).withColumn("v", geo.rd_to_wgs84("v")).select(*by, geo.envelope("v").alias("b"))
    edges = [F.min("b.xmin").alias("xmin"), F.min("b.ymin").alias("ymin"),
             F.max("b.xmax").alias("xmax"), F.max("b.ymax").alias("ymax")]
    return boxed.groupBy(*by).agg(*edges) if by else boxed.agg(*edges)


def bin_ribbons(bin_parts: DataFrame, half_width: float = 15.0) -> DataFrame:
    """Extruded ribbons of the line parts (`geom`, RD) with a height from the density."""
    d = F.coalesce(F.col("density_per_km_year"), F.lit(0.0))
    tall = bin_parts.withColumn(
        "extrusion_height_m", F.greatest(F.lit(0.0), d * EXTRUSION_M_PER_DENSITY))
    return geo.ribbon(tall, "geom", half_width)
