"""Geometry as Column functions: `length("geom")`, `interpolate("geom", "fraction")`, ...

Arguments are column names or SQL expression text; results are Columns that stay inside the
JVM. The formulas are in `shapes`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlines.functions import shapes as sh
from roadlines.functions.shapes import LINE_TYPE, MULTILINE_TYPE, POINT_TYPE

__all__ = ["LINE_TYPE", "MULTILINE_TYPE", "POINT_TYPE"]


def point(x: str, y: str) -> Column:
    return F.expr(sh.point(x, y))


def start(g: str) -> Column:
    return F.expr(sh.start(g))


def end(g: str) -> Column:
    return F.expr(sh.end(g))


def edges(g: str) -> Column:
    return F.expr(sh.edges(g))


def gap(a: str, b: str) -> Column:
    """Distance between two points."""
    return F.expr(sh.gap(a, b))


def length(g: str) -> Column:
    return F.expr(sh.length(g))


def parts_length(parts: str) -> Column:
    return F.expr(sh.parts_length(parts))


def interpolate(g: str, fraction: str) -> Column:
    return F.expr(sh.interpolate(g, fraction))


def parts_of(df: DataFrame, line: str = "geom_rd", parts: str = "geom_parts") -> str:
    """SQL text for the line parts of each row: of the line, or of the parts where there is no single line."""
    return sh.parts_of(line, parts if parts in df.columns else None)


def parts_start(parts: str) -> Column:
    return F.expr(sh.parts_start(parts))


def parts_end(parts: str) -> Column:
    return F.expr(sh.parts_end(parts))


def parts_measured(parts: str) -> Column:
    return F.expr(sh.parts_measured(parts))


def parts_interpolate(parts: str, fraction: str) -> Column:
    return F.expr(sh.parts_interpolate(parts, fraction))


def parts_closest(parts: str, p: str) -> Column:
    return F.expr(sh.parts_closest(parts, p))


def parts_substring(parts: str, lo: str, hi: str) -> Column:
    return F.expr(sh.parts_substring(parts, lo, hi))


def parts_centroid(parts: str) -> Column:
    return F.expr(sh.parts_centroid(parts))


def parts_envelope(parts: str) -> Column:
    return F.expr(sh.envelope(f"flatten({parts})"))


def measured(g: str) -> Column:
    return F.expr(sh.measured(g))


def on_measured(m: str, total: str, fraction: str) -> Column:
    return F.expr(sh.on_measured(m, total, fraction))


def closest(g: str, p: str) -> Column:
    return F.expr(sh.closest(g, p))


def locate(g: str, p: str) -> Column:
    """Fraction of the length at which the line is closest to the point."""
    c = closest(g, p)
    return F.when(c["total"] > 0, c["along"] / c["total"]).when(c["total"].isNotNull(), 0.0)


def distance(g: str, p: str) -> Column:
    return closest(g, p)["dist"]


def substring(g: str, lo: str, hi: str) -> Column:
    return F.expr(sh.substring(g, lo, hi))


def centroid(g: str) -> Column:
    return F.expr(sh.centroid(g))


def envelope(g: str) -> Column:
    return F.expr(sh.envelope(g))


def is_valid(g: str) -> Column:
    return F.expr(sh.is_valid(g))


def geometry_type(g: str, kind: str = "line") -> Column:
    """Type label; `kind` says how the column is stored: point, line or parts."""
    return F.expr(sh.geometry_type(g, kind))


def as_geojson(g: str, kind: str = "line") -> Column:
    return F.expr(sh.as_geojson(g, kind))


def from_geojson_line(text: str) -> Column:
    return F.expr(sh.from_geojson_line(text))


def rd_point_to_wgs84(p: str) -> Column:
    return F.expr(sh.rd_point_to_wgs84(f"{p}.x", f"{p}.y"))


def rd_to_wgs84(g: str) -> Column:
    """A line in RD metres as a line in degrees."""
    return F.expr(sh.rd_to_wgs84(g))


def wgs84_to_rd(g: str) -> Column:
    return F.expr(sh.wgs84_to_rd(g))


def parts_to_wgs84(parts: str) -> Column:
    return F.expr(sh.parts_to_wgs84(parts))


def dump(df: DataFrame, parts: str = "parts", out: str = "geom") -> DataFrame:
    """One row per line part, numbered from zero; rows without parts disappear."""
    keep = [c for c in df.columns if c != parts]
    return df.select(*keep, F.posexplode(parts).alias("part_no", out))


def ribbon(df: DataFrame, geom: str = "geom", half_width: float = 15.0,
           out: str = "polygon") -> DataFrame:
    """Polygon of `half_width` metres on both sides of an RD line, in degrees.

    Lines with fewer than two vertices are skipped.
    """
    ring = df.where(F.size(geom) >= 2).withColumn(out, F.expr(sh.ribbon(geom, half_width)))
    return ring.withColumn(out, rd_to_wgs84(out))
