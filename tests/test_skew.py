"""Hot roads fill many tasks, as the plans and the rows of the final stages show."""

import random
import re

import pytest
from pyspark.sql import functions as F

from roadlines.functions.shapes import LINE_TYPE
from roadlines.operators import bins as bn
from roadlines.operators import chain as ch
from roadlines.operators.joins import with_group_row
from roadlines.operators.roads import attach_geometry
from roadlines.config import ColumnMap
from roadlines.plans.chain_bins import chain_bin_cube


@pytest.fixture
def many_tasks(spark):
    """More partitions than a hot key, and no broadcasts that would hide the exchanges."""
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield 8
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def road_alone(plan):
    """Exchanges of rows by the road number and nothing else."""
    return re.findall(r"hashpartitioning\(road_number#\d+, \d+\)", plan)


def spread(df):
    """Rows in each task."""
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def hot_points(spark, n=20_000):
    rng = random.Random(2)
    rows = [("A2" if i % 100 else "A4", rng.uniform(0, 90_000), i, 2000 + i % 9, "DOD", i % 2, 0) for i in range(n)]
    return spark.createDataFrame(rows, "road_number string, chain_m double, accident_id int, accident_year int, severity string, "
                                       "fatal_count int, injury_count int")


def test_points_of_a_hot_road_fill_all_tasks(spark, many_tasks):
    points = hot_points(spark)
    grid = bn.chain_grid(spark.createDataFrame([("A2", 90_000.0), ("A4", 90_000.0)], "road_number string, total_length_m double"))
    placed = bn.point_in_bin_join(points, grid, "chain_m")
    sizes = spread(placed)
    assert len(sizes) == many_tasks and sizes[-1] < 3 * sum(sizes) / len(sizes)
    cube = chain_bin_cube(points, grid)
    plan = final_plan(cube)
    final = plan.split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in plan and not road_alone(final) and "_salt" in final
    # the aggregate sums up in the tasks of the join, then meets by bin
    assert len(re.findall("HashAggregate", final)) >= 2 and re.search(r"hashpartitioning\(road_number#\d+, bin_size_km#\d+", final)
    want = points.join(grid, "road_number").groupBy("bin_size_km").count().collect()
    got = cube.groupBy("bin_size_km").agg(F.sum("accident_count").alias("count")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_segments_of_a_hot_road_fill_all_tasks(spark, many_tasks):
    rng = random.Random(3)
    rows = []
    for i in range(4000):
        lo = rng.uniform(0, 900)
        rows.append((i, "A2" if i % 100 else "A4", lo, lo + rng.choice([0.1, 3.0, 40.0]), [(lo, 0.0), (lo + 1, 1.0), (lo + 2, 0.0)]))
    segments = spark.createDataFrame(rows, f"wegvak_id int, road_number string, lo double, hi double, geom_rd {LINE_TYPE}")
    grid = bn.km_grid(spark.createDataFrame([("A2", 0.0, 950.0), ("A4", 0.0, 950.0)], "road_number string, km_min double, km_max double"), [1, 5])
    clips = bn.clip_segments(segments, grid, "lo", "hi")
    sizes = spread(clips)
    assert len(sizes) == many_tasks and sizes[-1] < 3 * sum(sizes) / len(sizes)
    assert not road_alone(final_plan(clips))
    roads = segments.selectExpr("cast(wegvak_id as string) wegvak_id", "road_number road_number_norm", "'HR' carriageway",
                                "'H' direction", "lo start_hm", "hi end_hm", "2D length_m", "geom_rd")
    placed = ch.on_axis(ch.drawn_segments(roads), ch.road_axis(ch.drawn_segments(roads)))
    sizes = spread(placed)
    assert placed.count() == 4000 and len(sizes) == many_tasks and sizes[-1] < 3 * sum(sizes) / len(sizes)


def test_segments_without_a_key_are_spread(spark, many_tasks):
    segments = spark.range(8000).selectExpr("cast(id as string) wegvak_id", "if(id % 50 = 0, cast(id as string), null) _fk")
    lines = spark.createDataFrame([(str(i), [(0.0, 0.0), (1.0, float(i))]) for i in range(0, 8000, 100)], f"FK_VELD1 string, geom {LINE_TYPE}")
    joined = attach_geometry(segments, lines, ColumnMap())
    assert joined.count() == 8000 and joined.where("geom_rd is not null").count() == 80
    sizes = spread(joined)
    assert len(sizes) == many_tasks and sizes[-1] < 3 * sum(sizes) / len(sizes)


def test_groups_without_a_row_are_dropped(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "road_number string, v int")
    one = spark.createDataFrame([("a", 10), ("c", 30)], "road_number string, w int")
    assert [tuple(r) for r in with_group_row(df, one).collect()] == [("a", 1, 10)]
    assert with_group_row(df.limit(0), one).count() == with_group_row(df, one.limit(0)).count() == 0
