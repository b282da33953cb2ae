"""A cross-section of the registered queries against their SQL, on the smallest tables.

`python check.py` runs all of them on any folder.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, norm
from roadsupport import SF

SAMPLE = ["roads_norm", "accidents_direct_xy", "line_locate", "road_bins_flagship", "bins_geometry", "tail_km",
          "road_search", "multipart_clips", "drawn_flags", "ragged_scan", "ingest_job", "raw_archive_contents", "accident_chainage", "chain_bins", "density_classes", "validation_checks", "hm_chain_gaps"]
EQUI_JOINED = ["road_bins_all", "accidents_norm", "bins_clip", "road_meta"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rel = duck.execute(entry.oracle_sql()[name])
    names = sorted(d[0] for d in rel.description)
    order = [d[0] for d in rel.description]
    assert sorted(df.columns) == names
    want = sorted(tuple(norm(r[order.index(c)]) for c in names) for r in rel.fetchall())
    got = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "geojson" in df.columns


@pytest.mark.parametrize("name", EQUI_JOINED)
def test_no_nested_loops(spark, name):
    """Even with automatic broadcasts off, every join has an equality to shuffle on."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
