from pyspark.sql import functions as F

from roadlines.config import ColumnMap
from roadlines.operators import chain as ch
from roadlines.plans import profile as pf
from roadlines.plans.chain_bins import chain_bins, empty_bins
from roadsupport import ROAD_SCHEMA, road


def test_bins_of_invalid_clips_are_empty(spark):
    roads = spark.createDataFrame([road("s1", 0, (0.0, 10.0)), road("s2", 1000, (10.0, 10.0))], ROAD_SCHEMA)
    chain = ch.build_chain(roads)
    spot = F.transform("geom_rd", lambda p: F.get("geom_rd", F.lit(0)))
    chain = chain.withColumn("geom_rd", F.when(F.col("wegvak_id") == "s2", spot).otherwise(F.col("geom_rd")))
    got = {r.bin_id: r.geometry_quality for r in chain_bins(chain, [1]).collect()}
    assert got == {"A2_1km_00000": "linesubstring", "A2_1km_00001": "empty"}
    assert [r.bin_idx for r in empty_bins(chain, [1]).collect()] == [1]


def test_all_road_like_columns_are_profiled(spark, tmp_path):
    names = [f"WEGNR{i}" for i in range(11)]
    (tmp_path / "x.csv").write_text(";".join(names) + "\n" + ";".join(f"A{i}" for i in range(11)) + "\n")
    path = str(tmp_path / "x.csv")
    values = pf.profile(spark, [path], ColumnMap().target)[path]["road_values"]
    found = {x for r in values.collect() for x in r if isinstance(x, str)}
    assert {f"A{i}" for i in range(11)} <= found
