"""Results that are not cut short."""

from pyspark.sql import functions as F

from roadlines.config import MAX_ACCIDENT_POINTS
from roadlines.operators import accidents as ac


def test_road_accidents_are_all_listed(spark):
    n = MAX_ACCIDENT_POINTS + 5
    accidents = spark.range(n).select(
        F.col("id").cast("string").alias("accident_id"), F.lit(2020).alias("accident_year"),
        F.lit("fatal").alias("severity"), F.lit("xy").alias("location_quality"), F.lit("A2").alias("road_number_norm"),
        F.lit("w").alias("wegvak_id"), F.struct(F.lit(5.0).alias("x"), F.lit(52.0).alias("y")).alias("geom_wgs84"))
    roads = spark.createDataFrame([("w", "A2", "HR", "H")], "wegvak_id string, road_number_norm string, carriageway string, direction string")
    listed = ac.road_accidents(accidents, roads, "A2")
    assert listed.count() == n
    assert ac.road_accidents(accidents, roads, "A2", limit=7).count() == 7
