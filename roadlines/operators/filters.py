"""Projections and filters shared by every query."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlines.config import (
    GEOMETRY_DIRECTION, MAIN_CARRIAGEWAY, RD_X_RANGE, RD_Y_RANGE, clean_direction,
)
from roadlines.functions.geometry import POINT_TYPE


def role(name: str | None, kind: str = "string") -> Column:
    """The column that plays a role, or a typed NULL for an unset role."""
    column = F.lit(None) if name is None else F.col(f"`{name}`")
    return column.cast(kind)


def project_roles(df: DataFrame, roles: dict[str, str | None]) -> DataFrame:
    """Select role -> physical column as text, typed NULL where the role is unset."""
    return df.select(*[role(column).alias(name) for name, column in roles.items()])


def on_road(df: DataFrame, road: str | None) -> DataFrame:
    """Rows of one road; None keeps all rows that have a road."""
    c = F.col("road_number_norm")
    return df.where(c.isNotNull() if road is None else c == road.upper())


def in_years(df: DataFrame, lo: int | None = None, hi: int | None = None) -> DataFrame:
    if lo is not None:
        df = df.where(F.col("accident_year") >= lo)
    if hi is not None:
        df = df.where(F.col("accident_year") <= hi)
    return df


def in_severities(df: DataFrame, values: Sequence[str] | None = None) -> DataFrame:
    return df.where(F.col("severity").isin(*values)) if values else df


def main_road(df: DataFrame, on: bool = True) -> DataFrame:
    return df.where(F.coalesce("carriageway", F.lit("")) == MAIN_CARRIAGEWAY) if on else df


def geometry_direction(df: DataFrame, direction: str | None = None,
                       default: str = GEOMETRY_DIRECTION) -> DataFrame:
    """Segments that are drawn: the requested direction, or the default one for both."""
    wanted = clean_direction(direction) or default
    return df.where(F.coalesce("direction", F.lit("")) == wanted)


def accident_direction(df: DataFrame, direction: str | None = None) -> DataFrame:
    """Segments whose accidents count: both directions unless one is requested."""
    wanted = clean_direction(direction)
    return df if wanted is None else df.where(F.coalesce("direction", F.lit("")) == wanted)


def has_geometry(df: DataFrame, geom: str = "geom_rd") -> DataFrame:
    return df.where(F.col(geom).isNotNull())


def has_km(df: DataFrame, km: str = "road_km") -> DataFrame:
    return df.where(F.col(km).isNotNull())


def plausible_xy(x: Column, y: Column) -> Column:
    """Point when both coordinates lie in the national grid, else NULL."""
    inside = x.between(*RD_X_RANGE) & y.between(*RD_Y_RANGE)
    return F.when(inside, F.struct(x.alias("x"), y.alias("y"))).cast(POINT_TYPE)


def target_subset(df: DataFrame, road: str | None = None) -> DataFrame:
    """Rows of the target road, or of any one road."""
    return df.where(F.col("is_target_a2")) if road is None else on_road(df, road)


def corridor(df: DataFrame, lo: float, hi: float, km: str = "road_km") -> DataFrame:
    return df.where(F.col(km).between(lo, hi))


def one_row_meta(frames: Iterable[DataFrame]) -> DataFrame:
    """Side-by-side columns of frames that have exactly one row each.

    The rows are folded to one wide row by an aggregate, so no product is formed.
    """
    frames = list(frames)
    names = [n for f in frames for n in f.columns]
    wide = [f.select(*[F.col(n) if n in f.columns else F.lit(None).cast(g.schema[n].dataType).alias(n)
                       for g in frames for n in g.columns]) for f in frames]
    stacked = wide[0]
    for f in wide[1:]:
        stacked = stacked.unionByName(f)
    return stacked.agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])
