"""Session settings and lineage cuts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names in spark.checkpoint.dir.

    Where it is unset, a session of one machine takes a folder in its warehouse. On a cluster that
    is an error: a folder made up here could be local to each machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_cuts")


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the file system drop `path` when this application ends."""
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def cut_at(df: DataFrame) -> tuple[DataFrame, str]:
    """As `cut`, with the path, for a caller who knows when its last reader is done (`drop_cuts`)."""
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    df.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from the written table.

    Later branches read one and the same result, lost executors recompute nothing before it,
    and as a Parquet table it can be pruned and its size is known to the planner.
    """
    return cut_at(df)[0]


def drop_cuts(spark: SparkSession, *paths: str) -> None:
    """Delete written cuts that no plan still to be run reads."""
    sc = spark.sparkContext
    for path in paths:
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
