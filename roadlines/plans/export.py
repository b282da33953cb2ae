"""Exports: raw archive, serving tables, GeoJSON features, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlines.operators.classes import repair_density

# Tables archived beside the raw ones, and tables the serving export needs.
ARCHIVE_EXTRA = ("accidents_staging", "road_points_norm")
SERVING_REQUIRED = ("roads_norm", "accidents_norm", "raw_nwb_hectointervallen")
# End of fixed values.

STAGING_SCHEMA = "accident_id string, fatal_count int, injury_count int"


def table_digest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """rows, hash_sum and hash_xor of a table, whatever the order of its rows.

    A row is the text of its columns (by name, or as listed) with ~ for NULL. Its digest's first
    60 bits are summed by their low half and combined by exclusive or, so that a changed, lost or
    repeated row shows.
    """
    names = columns or sorted(df.columns, key=str.lower)
    text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in names])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return df.select(bits.alias("b")).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("b") % (1 << 30)), F.lit(0)).alias("hash_sum"),
        F.coalesce(F.bit_xor("b"), F.lit(0)).cast("long").alias("hash_xor"))


def digests(tables: dict[str, DataFrame], columns: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """The digest of each of some tables, one row per table."""
    out = None
    for name, df in tables.items():
        one = table_digest(df, (columns or {}).get(name)).select(F.lit(name).alias("table"), "rows", "hash_sum", "hash_xor")
        out = one if out is None else out.unionByName(one)
    return out


def archive_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of every archived table; an error without any raw table."""
    names = [n for n in sorted(tables) if n.startswith("raw_")]
    if not names:
        raise ValueError("no raw_* tables to archive; run the ingest first")
    names += [n for n in ARCHIVE_EXTRA if n in tables]
    counts = None
    for name in names:
        one = tables[name].agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def export_raw(tables: dict[str, DataFrame], dst: str) -> DataFrame:
    """Write the archive as Parquet folders; returns rows per table, counted from the copies."""
    counts = archive_counts(tables)
    spark = counts.sparkSession
    written = {}
    for name in tables:
        if name.startswith("raw_") or name in ARCHIVE_EXTRA:
            tables[name].write.mode("overwrite").parquet(f"{dst}/{name}")
            written[name] = spark.read.parquet(f"{dst}/{name}")
    return archive_counts(written)


def serving_tables(tables: dict[str, DataFrame], roads: Sequence[str],
                   spark: SparkSession | None = None) -> dict[str, DataFrame]:
    """The reduced tables the query layer reads.

    Intervals and casualty counts are kept by inner joins: a repeated segment id repeats its
    intervals, as the full join would.
    """
    missing = [n for n in SERVING_REQUIRED if n not in tables]
    if missing:
        raise ValueError(f"missing tables: {', '.join(missing)}")
    wanted = [r.upper() for r in roads]
    kept_roads = tables["roads_norm"].where(F.col("road_number_norm").isin(*wanted))
    kept = tables["accidents_norm"].where(F.col("road_number_norm").isin(*wanted))
    intervals = tables["raw_nwb_hectointervallen"]
    key = next(c for c in intervals.columns if c.lower() == "wvk_id")
    kept_intervals = intervals.join(
        kept_roads.select("wegvak_id"), F.col(key).cast("string") == F.col("wegvak_id"), "inner"
    ).drop("wegvak_id")
    if "accidents_staging" in tables:
        casualties = tables["accidents_staging"].select(
            "accident_id", "fatal_count", "injury_count"
        ).join(kept.select("accident_id"), "accident_id", "inner")
    else:
        session = spark or kept.sparkSession
        casualties = session.createDataFrame([], STAGING_SCHEMA)
    return {"roads_norm": kept_roads, "accidents_norm": kept,
            "raw_nwb_hectointervallen": kept_intervals, "accidents_staging": casualties}


def export_serving(tables: dict[str, DataFrame], dst: str, roads: Sequence[str]) -> DataFrame:
    """Write the serving tables (ordered by road where they have one); returns rows per table."""
    reduced = serving_tables(tables, roads)
    counts = None
    for name, df in reduced.items():
        if "road_number_norm" in df.columns:
            order = ["road_number_norm", "wegvak_id"]
            df = df.repartitionByRange(*order).sortWithinPartitions(*order)
        df.write.mode("overwrite").parquet(f"{dst}/{name}")
        one = df.sparkSession.read.schema(df.schema).parquet(f"{dst}/{name}").agg(
            F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def to_features(df: DataFrame, geometry: str = "geojson", repair: bool = True) -> DataFrame:
    """One GeoJSON Feature text per row with a geometry; all flat columns become properties.

    Nested columns are left out. Null properties stay, as consumers expect every key.
    """
    if repair and "density_per_km_year" in df.columns:
        df = repair_density(df)
    flat = [f.name for f in df.schema.fields
            if f.name != geometry and f.dataType.typeName() not in ("array", "struct", "map")]
    properties = F.to_json(F.struct(*[
        F.col(n).cast("double").alias(n) if df.schema[n].dataType.typeName() == "decimal"
        else F.col(n) for n in flat]), {"ignoreNullFields": "false"})
    text = F.concat(F.lit('{"type":"Feature","geometry":'), F.col(geometry),
                    F.lit(',"properties":'), properties, F.lit("}"))
    return df.where(F.col(geometry).isNotNull()).select(text.alias("feature"))


def write_features(df: DataFrame, path: str, geometry: str = "geojson") -> None:
    """Features as newline-delimited text, written in parallel."""
    to_features(df, geometry).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
