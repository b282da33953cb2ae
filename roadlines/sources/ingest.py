"""Raw files to raw tables, and the tables the query layer needs."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlines.config import ColumnMap
from roadlines.sources.delimited import read_delimited
from roadlines.sources.shapefile import register

# Raw table names and their column-map entries.
TEXT_TABLES = {
    "wegvakken": "raw_nwb_wegvakken",
    "puntlocaties": "raw_nwb_puntlocaties",
    "hectopunten": "raw_nwb_hectopunten",
    "hectointervallen": "raw_nwb_hectointervallen",
    "juncties": "raw_nwb_juncties",
    "junctiehectometrering": "raw_nwb_junctiehectometrering",
}
LINE_TABLE = "raw_nwb_wegvakgeografie"
ACCIDENT_TABLE = "raw_bron_accidents"
SERVED = ("roads_norm", "accidents_norm")
# End of fixed values.


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists; Spark's own file listing decides, on any file system."""
    listed = spark.read.format("binaryFile").load
    try:
        listed(path).schema
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return False
        raise
    return True


def write_table(df: DataFrame, name: str, cluster_by: Sequence[str] = ()) -> None:
    """Replace a Parquet table.

    `cluster_by` orders the rows over all files, so that a road predicate skips files and row
    groups by their statistics. A second, unique column splits a hot road over many files;
    unlike folders per road this keeps blank and missing names apart and makes no tiny files.
    """
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    df.write.mode("overwrite").format("parquet").saveAsTable(name)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    name = path.rsplit("/", 1)[-1]
    return (spark.read.format("shp_lines").load(path)
            .withColumn("_source_file", F.lit(name))
            .withColumn("_ingested_at", F.current_timestamp()))


def ingest_all(spark: SparkSession, cmap: ColumnMap) -> DataFrame:
    """Load all mapped files; returns one row per table with its row count.

    Missing network files are skipped with a warning, a missing accident file is an error.
    """
    loaded = []
    accidents = cmap.accidents.path
    if not accidents or not path_exists(spark, accidents):
        raise FileNotFoundError(f"accident file not found: {accidents}")
    for entry, table in TEXT_TABLES.items():
        path = getattr(cmap, entry).path
        if path and path_exists(spark, path):
            write_table(read_delimited(spark, path), table)
            loaded.append(table)
        else:
            warnings.warn(f"missing {path}, skipping {table}", stacklevel=2)
    lines = cmap.wegvakgeografie.path
    if lines and path_exists(spark, lines):
        write_table(read_lines(spark, lines), LINE_TABLE)
        loaded.append(LINE_TABLE)
    else:
        warnings.warn(f"missing {lines}, skipping {LINE_TABLE}", stacklevel=2)
    write_table(read_delimited(spark, accidents), ACCIDENT_TABLE)
    loaded.append(ACCIDENT_TABLE)
    return table_counts(spark, loaded)


def table_counts(spark: SparkSession, tables: list[str]) -> DataFrame:
    """Row count per table, as one union of counts."""
    counts = None
    for name in tables:
        one = spark.table(name).agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


def tables_ready(spark: SparkSession) -> bool:
    return all(spark.catalog.tableExists(t) for t in SERVED)
