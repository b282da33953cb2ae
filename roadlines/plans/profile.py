"""Profile of raw tables: columns, hints, frequent values, target-road candidates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlines.config import TargetRules
from roadlines.functions.text import general_road_number, target_flag
from roadlines.operators.stats import geometry_types, value_frequencies
from roadlines.sources.delimited import read_delimited, sniff_format
from roadlines.sources.shapefile import crs_of

# Column-name hints and the patterns of target-road spellings.
HINTS = {
    "likely_id": r"(^id$|_id$|^id_|nummer|code|fk_)",
    "likely_road_number": r"(weg|road|route|nummer|number|wegnum|wegnr|routeltr|routenr|wegbh|beh|hmp)",
    "likely_year_date": r"(jaar|year|datum|date)",
    "likely_geometry": r"(geom|wkt|x_coord|y_coord|lon|lat|coord)",
}
ROAD_COLUMNS = ("WEGNR_HMP", "WEGNUMMER", "ROUTELTR", "ROUTENR", "WEGBEHSRT")
TARGET_PATTERN = r"(?i)a\s*2|002|^2$|rijksweg\s*2|autosnelweg\s*2|a2"
KEY_COLUMN = "WEGNR_HMP"
# End of fixed values.

SAMPLE_ROWS = 3
FREQUENT_VALUES = 15


def classify_columns(columns: Sequence[str]) -> dict[str, list[str]]:
    """Column names by what they probably hold."""
    return {hint: [c for c in columns if re.search(pattern, c, re.I)]
            for hint, pattern in HINTS.items()}


def road_columns(columns: Sequence[str]) -> list[str]:
    like = set(classify_columns(columns)["likely_road_number"])
    return [c for c in columns if c in like or c.upper() in ROAD_COLUMNS]


def _matches(value: Column, rules: TargetRules) -> Column:
    none = F.lit(None).cast("string")
    return F.regexp_like(value, F.lit(TARGET_PATTERN)) | target_flag(
        general_road_number(value, none, none), value, none, none, none, rules)


def find_road_candidates(df: DataFrame, rules: TargetRules,
                         columns: Sequence[str] | None = None) -> DataFrame:
    """Values of road-like columns that may denote the target road, with their row counts.

    The test runs on distinct values, after they have been counted.
    """
    searched = list(columns) if columns else road_columns(df.columns)
    trimmed = df.select(*[F.trim(F.col(f"`{c}`").cast("string")).alias(c) for c in searched])
    counted = value_frequencies(trimmed, searched, n=None)
    return counted.where(_matches(F.col("value"), rules))


def candidate_summary(candidates: DataFrame, rules: TargetRules,
                      key: str = KEY_COLUMN) -> DataFrame:
    """One row: candidate columns, rows of the key column, reliability, recommended key."""
    target = rules.canonical_road_number
    keyed = F.when((F.upper("column") == key.upper()) & (F.col("value") == target), F.col("rows"))
    found = candidates.agg(
        F.array_join(F.array_sort(F.collect_set("column")), ",").alias("candidate_columns"),
        F.coalesce(F.sum(keyed), F.lit(0)).alias("key_rows"))
    return found.withColumn("reliable", F.col("key_rows") > 0).withColumn(
        "recommended_key", F.when(F.col("key_rows") > 0, f"{key} = '{target}'")
        .otherwise("manual mapping required"))


def profile_columns(df: DataFrame) -> DataFrame:
    """Per column: position, rows, filled rows, distinct filled values, hints.

    Distinct values are counted from grouped (column, value) pairs, so that no set of values is
    held in one place.
    """
    columns = [c for c in df.columns if not c.startswith("_")]
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
        for c in columns])).alias("p")
    filled = F.coalesce(F.col("value") != "", F.lit(False))
    grouped = df.select(pairs).select("p.*").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"))
    hints = classify_columns(columns)
    label = F.lit(None).cast("string")
    for hint in reversed(list(HINTS)):
        if hints[hint]:
            label = F.when(F.col("column").isin(*hints[hint]), hint).otherwise(label)
    return grouped.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("filled_rows"),
        F.count_if(filled).alias("distinct_values")).withColumn("hint", label)


def sample_rows(df: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    return df.limit(n)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Name and bytes of the files under a folder; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            .select(F.element_at(F.split("path", "/"), -1).alias("name"),
                    F.col("length").alias("size_bytes")))


def profile(spark: SparkSession, paths: Sequence[str], rules: TargetRules) -> dict[str, dict]:
    """Per file: its format and lazy DataFrames for columns, samples, values and candidates."""
    report: dict[str, dict] = {}
    for path in paths:
        entry: dict = {"files": file_sizes(spark, path)}
        if path.lower().endswith(".shp"):
            from roadlines.sources.ingest import read_lines
            df = read_lines(spark, path)
            entry.update(type="shapefile", crs=crs_of(path),
                         geometry_types=geometry_types(df, "geom_parts", "parts"))
            text = df.drop("geom", "geom_parts", "_source_file", "_ingested_at")
        else:
            fmt = sniff_format(spark, path)
            df = read_delimited(spark, path, fmt)
            entry.update(type="text", format=fmt)
            text = df.drop("_source_file", "_ingested_at")
        hints = classify_columns(text.columns)
        likely = hints["likely_road_number"]
        entry.update(
            hints=hints, columns=profile_columns(text), samples=sample_rows(df),
            road_values=value_frequencies(text, likely, FREQUENT_VALUES) if likely else None)
        if road_columns(text.columns):
            found = find_road_candidates(text, rules)
            entry.update(candidates=found, candidate_summary=candidate_summary(found, rules))
        report[path] = entry
    return report
