"""Line formulas against plain-Python twins on random and degenerate lines."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roadlines.functions import geometry as geo
from roadlines.functions.shapes import LINE_TYPE


def walk(line):
    at, out = 0.0, []
    for (x1, y1), (x2, y2) in zip(line, line[1:]):
        d = math.dist((x1, y1), (x2, y2))
        out.append((at, d, x1, y1, x2, y2))
        at += d
    return out, at


def py_interpolate(line, f):
    edges, total = walk(line)
    goal, best = f * total, line[0]
    for at, d, x1, y1, x2, y2 in edges:
        if at <= goal and d > 0:
            t = min((goal - at) / d, 1.0)
            best = (x1 + t * (x2 - x1), y1 + t * (y2 - y1))
    return best


def py_closest(line, p):
    edges, total = walk(line)
    best = (math.inf, 0.0)
    for at, d, x1, y1, x2, y2 in edges:
        t = 0.0
        if d > 0:
            t = max(0.0, min(1.0, ((p[0] - x1) * (x2 - x1) + (p[1] - y1) * (y2 - y1)) / (d * d)))
        dist = math.dist(p, (x1 + t * (x2 - x1), y1 + t * (y2 - y1)))
        if dist < best[0] - 1e-12:
            best = (dist, at + t * d)
    return best[0], best[1], total


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(7)
    rows = []
    for i in range(60):
        line = [(rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(rng.randint(2, 9))]
        if i % 7 == 0:
            line.insert(1, line[0])
        lo, hi = sorted((rng.random(), rng.random()))
        rows.append((i, line, (rng.uniform(-200, 1100), rng.uniform(-200, 1100)), lo, hi))
    return rows


@pytest.fixture(scope="module")
def frame(spark, cases):
    schema = f"id int, g {LINE_TYPE}, p struct<x:double,y:double>, lo double, hi double"
    return spark.createDataFrame(cases, schema)


def test_length_interpolate_locate(frame, cases):
    got = frame.select(
        "id", geo.length("g").alias("len"), geo.interpolate("g", "lo").alias("at"),
        geo.closest("g", "p").alias("c"), geo.locate("g", "p").alias("f")).collect()
    for row in got:
        _, line, p, lo, _ = cases[row["id"]]
        assert row["len"] == pytest.approx(walk(line)[1])
        assert tuple(row["at"]) == pytest.approx(py_interpolate(line, lo))
        dist, along, total = py_closest(line, p)
        assert row["c"]["dist"] == pytest.approx(dist)
        assert row["c"]["along"] == pytest.approx(along)
        assert row["f"] == pytest.approx(along / total)


def test_substrings_add_up_and_meet(frame):
    cut = frame.withColumns({"a": geo.substring("g", "0D", "lo"), "b": geo.substring("g", "lo", "hi"),
                             "c": geo.substring("g", "hi", "1D")})
    row = cut.select(
        (geo.length("a") + geo.length("b") + geo.length("c")).alias("sum"), geo.length("g").alias("all"),
        (geo.end("a") == geo.start("b")).alias("ab"), (geo.end("b") == geo.start("c")).alias("bc"),
        (geo.start("a") == geo.start("g")).alias("first"), (geo.end("c") == geo.end("g")).alias("last"))
    for r in row.collect():
        assert r["sum"] == pytest.approx(r["all"])
        assert r["ab"] and r["bc"] and r["first"] and r["last"]


def test_locate_undoes_interpolate(frame):
    simple = frame.withColumn("g", F.expr("array(get(g, 0), get(g, size(g) - 1))"))
    back = simple.withColumn("q", geo.interpolate("g", "hi")).select("hi", geo.locate("g", "q").alias("f"))
    for r in back.collect():
        assert r["f"] == pytest.approx(r["hi"])


def test_degenerate_lines(spark):
    rows = [(1, [(5.0, 5.0), (5.0, 5.0)]), (2, [(1.0, 2.0)]), (3, None), (4, [(0.0, 0.0), (3.0, 4.0)])]
    df = spark.createDataFrame(rows, f"id int, g {LINE_TYPE}")
    got = {r["id"]: r for r in df.select(
        "id", geo.length("g").alias("len"), geo.centroid("g").alias("c"), geo.is_valid("g").alias("ok"),
        geo.interpolate("g", "0.5D").alias("mid"), geo.substring("g", "0.6D", "0.4D").alias("back"),
        geo.envelope("g").alias("box"), geo.geometry_type("g").alias("kind"),
        geo.distance("g", "named_struct('x', 1D, 'y', 0D)").alias("d")).collect()}
    assert got[1]["len"] == 0 and tuple(got[1]["c"]) == (5.0, 5.0) and got[1]["ok"] is False
    assert tuple(got[2]["mid"]) == (1.0, 2.0) and got[2]["d"] == 2.0
    assert all(got[3][k] is None for k in ("len", "c", "mid", "box", "kind", "d"))
    assert got[4]["len"] == 5.0 and tuple(got[4]["mid"]) == (1.5, 2.0) and got[4]["ok"] is True
    assert got[4]["back"] is None and tuple(got[4]["box"]) == (0.0, 0.0, 3.0, 4.0)


def test_projection_known_points_and_round_trip(spark):
    known = [(120700.723, 487525.502, 4.88352559, 52.37453254), (233883.131, 582065.167, 6.56820053, 53.21938317)]
    df = spark.createDataFrame(known, "x double, y double, lon double, lat double")
    got = df.withColumn("p", geo.rd_point_to_wgs84("named_struct('x', x, 'y', y)")).withColumn(
        "b", geo.wgs84_to_rd("array(p)")).collect()
    for r in got:
        assert r["p"]["x"] == pytest.approx(r["lon"], abs=2e-8)
        assert r["p"]["y"] == pytest.approx(r["lat"], abs=2e-8)
        assert r["b"][0]["x"] == pytest.approx(r["x"], abs=0.5)
        assert r["b"][0]["y"] == pytest.approx(r["y"], abs=0.5)


def test_geojson_both_ways(spark):
    parts = [[(1.0, 2.0), (3.0, 4.5)], [(5.0, 6.0), (7.0, 8.0)]]
    df = spark.createDataFrame([(parts,), (parts[:1],)], "parts array<array<struct<x:double,y:double>>>")
    rows = df.withColumn("t", geo.as_geojson("parts", "parts")).withColumn(
        "back", geo.from_geojson_line("t")).collect()
    assert rows[0]["t"] == ('{"type":"MultiLineString","coordinates":[[[1.0,2.0],[3.0,4.5]],[[5.0,6.0],[7.0,8.0]]]}')
    assert rows[1]["t"] == '{"type":"LineString","coordinates":[[1.0,2.0],[3.0,4.5]]}'
    assert all(r["back"] == r["parts"] for r in rows)
    dumped = geo.dump(df, "parts", "g").collect()
    assert [r["part_no"] for r in dumped] == [0, 1, 0]


def test_ribbon_keeps_its_distance(spark):
    line = [(155000.0, 463000.0), (155100.0, 463000.0)]
    df = spark.createDataFrame([(line,), ([line[0]],)], f"geom {LINE_TYPE}")
    rows = geo.ribbon(df, "geom", 15.0).withColumn("m", geo.wgs84_to_rd("polygon")).collect()
    assert len(rows) == 1
    ring = [(p["x"], p["y"]) for p in rows[0]["m"]]
    assert ring[0] == ring[-1] and len(ring) == 5
    assert sorted({round(y) for _, y in ring}) == [462985, 463015]
