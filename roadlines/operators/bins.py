"""Uniform bins along a measure, and the joins of points and intervals to them.

A *grid* holds one row per road and bin size: origin, limit, step, n_bins. Bins of a grid are
arithmetic (bin i starts at origin + i*step), so points and intervals find their bins by
division, followed by a check against the exact bounds; no bin table has to be joined or
searched, and no nested loop is planned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlines.config import BIN_SIZES_KM
from roadlines.functions import geometry as geo
from roadlines.operators.joins import with_group_row

GRID = ("bin_size_km", "origin", "limit", "step", "n_bins")


def km_grid(extent: DataFrame, sizes: Sequence[int] = BIN_SIZES_KM) -> DataFrame:
    """Grid over official km: from km_min to km_max of each road, in km."""
    return _grid(extent.select("road_number", F.col("km_min").alias("origin"),
                               F.col("km_max").alias("limit")), sizes, 1.0)


def chain_grid(totals: DataFrame, sizes: Sequence[int] = BIN_SIZES_KM) -> DataFrame:
    """Grid over chain metres: from zero to the chain length of each road, in metres."""
    return _grid(totals.select("road_number", F.lit(0.0).alias("origin"),
                               F.col("total_length_m").alias("limit")), sizes, 1000.0)


def _grid(extent: DataFrame, sizes: Sequence[int], unit: float) -> DataFrame:
    sized = (extent.where(F.col("limit") > F.col("origin"))
             .withColumn("bin_size_km", F.explode(F.array(*[F.lit(int(s)) for s in sizes])))
             .withColumn("step", F.col("bin_size_km") * F.lit(unit)))
    count = F.greatest(
        F.ceil((F.col("limit") - F.col("origin")) / F.col("step")) - 1, F.lit(0)) + 1
    return sized.withColumn("n_bins", count.cast("long"))


def bin_start(i: Column) -> Column:
    return F.col("origin") + i * F.col("step")


def bin_end(i: Column) -> Column:
    return F.least(F.col("origin") + (i + 1) * F.col("step"), F.col("limit"))


def bin_defs(grid: DataFrame) -> DataFrame:
    """One row per bin: road_number, bin_size_km, bin_idx, bin_start, bin_end (grid units)."""
    last = F.greatest(F.col("n_bins") - 1, F.lit(0))
    return (grid.withColumn("bin_idx", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            .select("road_number", "bin_size_km", "bin_idx",
                    bin_start(F.col("bin_idx")).alias("bin_start"),
                    bin_end(F.col("bin_idx")).alias("bin_end")))


def bin_of(value: Column, scale: float | None = None) -> Column:
    """Index of the bin with start <= value < end on a row that carries the grid columns.

    The division may be off by one at a bound, so both neighbours are checked too. `scale`
    repeats a conversion of the bounds (times scale, then divided by it) in the comparison.
    """
    def bound(c: Column) -> Column:
        return c if scale is None else c * scale / scale

    def holds(i: Column) -> Column:
        return ((i >= 0) & (i < F.col("n_bins"))
                & (value >= bound(bin_start(i))) & (value < bound(bin_end(i))))

    guess = F.floor((value - F.col("origin")) / F.col("step")).cast("long")
    return (F.when(holds(guess), guess).when(holds(guess - 1), guess - 1)
            .when(holds(guess + 1), guess + 1))


def point_in_bin_join(points: DataFrame, grid: DataFrame, value: str,
                      scale: float | None = None) -> DataFrame:
    """Points with the bin they fall into, for every size of the grid; others are dropped.

    Points of a hot road are spread over many tasks.
    """
    sized = with_group_row(points, grid)
    return (sized.withColumn("bin_idx", bin_of(F.col(value), scale))
            .where(F.col("bin_idx").isNotNull())
            .drop("origin", "limit", "step", "n_bins"))


def overlap_join(segments: DataFrame, grid: DataFrame, lo: str, hi: str) -> DataFrame:
    """Segments with every bin they overlap: hi > bin_start and lo < bin_end."""
    first = F.floor((F.least(lo, hi) - F.col("origin")) / F.col("step")).cast("long") - 1
    last = F.floor((F.greatest(lo, hi) - F.col("origin")) / F.col("step")).cast("long") + 1
    low = F.greatest(first, F.lit(0))
    high = F.least(last, F.col("n_bins") - 1)
    i = F.col("bin_idx")
    return (
        with_group_row(segments, grid)
        .where(low <= high)
        .withColumn("bin_idx", F.explode(F.sequence(low, high)))
        .withColumn("bin_start", bin_start(i)).withColumn("bin_end", bin_end(i))
        .where((F.col(hi) > F.col("bin_start")) & (F.col(lo) < F.col("bin_end")))
        .drop("origin", "limit", "step", "n_bins"))


def clip_segments(segments: DataFrame, grid: DataFrame, lo: str, hi: str, geom: str = "geom_rd",
                  span: str | None = None) -> DataFrame:
    """Pieces of the segments inside each bin (geom_clip), one row for each line; empty pieces are dropped.

    Fractions relate the bin bounds to lo..hi; `span` names the divisor when it is not hi - lo.
    Of a line of several parts (`geom_parts`) each part that reaches into the bin is a piece.
    """
    overlaps = overlap_join(segments, grid, lo, hi)
    size = F.col(span) if span else F.col(hi) - F.col(lo)
    divisor = F.nullif(size, F.lit(0.0))
    if span:
        begin = (F.col("bin_start") - F.col(lo)) / divisor
        finish = (F.col("bin_end") - F.col(lo)) / divisor
    else:
        begin = (F.greatest("bin_start", lo) - F.col(lo)) / divisor
        finish = (F.least("bin_end", hi) - F.col(lo)) / divisor
    fractions = overlaps.withColumns({
        "_from": F.greatest(F.lit(0.0), begin), "_to": F.least(F.lit(1.0), finish)})
    if "geom_parts" not in segments.columns:
        return (fractions.withColumn("geom_clip", geo.substring(geom, "_from", "_to"))
                .where(F.col("geom_clip").isNotNull()).drop("_from", "_to", geom))
    one = F.col(geom).isNotNull()
    pieces = F.when(one, F.array(geo.substring(geom, "_from", "_to"))).otherwise(
        geo.parts_substring("geom_parts", "_from", "_to"))
    return (fractions.withColumn("geom_clip", F.explode(pieces))
            .where(F.col("geom_clip").isNotNull()).drop("_from", "_to", geom, "geom_parts"))


def bin_counts(placed: DataFrame) -> DataFrame:
    """Accidents, accidents with a death, accidents with an injury per bin."""
    return placed.groupBy("road_number", "bin_size_km", "bin_idx").agg(
        F.sum("accidents").alias("accident_count"), F.sum("fatal").alias("fatal_count"),
        F.sum("injury").alias("injury_count"))


def bin_cube(placed: DataFrame) -> DataFrame:
    """The same measures per bin, year and severity, from one row per accident."""
    return placed.groupBy(
        "road_number", "bin_size_km", "bin_idx", "accident_year", "severity").agg(
        F.count(F.lit(1)).alias("accident_count"),
        F.count_if(F.coalesce("fatal_count", F.lit(0)) > 0).alias("fatal_count"),
        F.count_if(F.coalesce("injury_count", F.lit(0)) > 0).alias("injury_count"))


def zero_fill(bins: DataFrame, counts: DataFrame) -> DataFrame:
    """All bins with their counts, zero where nothing was counted."""
    keys = ["road_number", "bin_size_km", "bin_idx"]
    joined = bins.join(counts, keys, "left")
    return joined.withColumns({
        c: F.coalesce(c, F.lit(0).cast("long"))
        for c in ("accident_count", "fatal_count", "injury_count")})


def bin_id(suffix: str = "") -> Column:
    number = F.col("bin_idx").cast("string")
    padded = F.lpad(number, 5, "0")
    return F.concat(F.col("road_number"), F.lit("_"), F.col("bin_size_km").cast("string"),
                    F.lit("km_"), padded, F.lit(suffix))


def density(count: Column, length_m: Column, span: Column) -> Column:
    """Accidents per km and year; zero for a bin without length."""
    return F.when(length_m > 0, count / (length_m / 1000.0) / span).otherwise(0.0)
