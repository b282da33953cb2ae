"""Written cuts can be dropped once their last reader is done."""

from pathlib import Path

from pyspark.sql import functions as F

from roadlines.session import cut, cut_at, drop_cuts


def test_a_dropped_cut_is_gone_and_others_stay(spark):
    first, path = cut_at(spark.range(10))
    kept = cut(first.groupBy((F.col("id") % 3).alias("k")).count())
    drop_cuts(spark, path)
    assert not Path(path.removeprefix("file:")).exists()
    assert sorted(map(tuple, kept.collect())) == [(0, 4), (1, 3), (2, 3)]
    drop_cuts(spark, path)  # a second call finds nothing, and is no error
