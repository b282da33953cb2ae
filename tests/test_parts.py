"""Lines of several parts, and measures of long lines."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from roadlines.functions import geometry as geo
from roadlines.functions import shapes as sh
from roadlines.operators import chain as ch
from roadlines.plans import live_bins as lb
from roadsupport import ROAD_SCHEMA, road


def edges_of(parts):
    return [(a, b, math.dist(a, b)) for g in parts for a, b in zip(g, g[1:])]


def slow_point(parts, fraction):
    total = sum(n for *_, n in edges_of(parts))
    at, spot = 0.0, None
    for a, b, n in edges_of(parts):
        if at <= total * fraction:
            t = min((total * fraction - at) / n, 1.0) if n else 0.0
            spot = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
        at += n
    return spot


def slow_piece(parts, lo, hi):
    """Parts of the stretch between two fractions, by walking along each part."""
    total = sum(n for *_, n in edges_of(parts))
    lo, hi, at, out = lo * total, hi * total, 0.0, []
    for g in parts:
        piece = []
        for a, b, n in edges_of([g]):
            s, e = max(lo, at), min(hi, at + n)
            if s < e:
                for m in ([s] if not piece else []) + [e]:
                    t = (m - at) / n
                    piece.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
            at += n
        if piece:
            out.append(piece)
    return out or None


def near(a, b):
    return a == b or all(math.dist(p, q) < 1e-6 for p, q in zip(a, b, strict=True))


def test_measures_along_parts(spark):
    rng = random.Random(4)
    rows = []
    for i in range(80):
        parts = [[(rng.uniform(0, 100), rng.uniform(0, 100)) for _ in range(rng.randint(2, 6))] for _ in range(rng.randint(1, 4))]
        lo, hi = sorted((rng.random(), rng.random()))
        rows.append((i, parts, lo, hi, (rng.uniform(0, 100), rng.uniform(0, 100))))
    df = spark.createDataFrame(rows, f"id int, p {sh.MULTILINE_TYPE}, lo double, hi double, q {sh.POINT_TYPE}")
    got = df.select(
        "id", geo.parts_length("p").alias("n"), geo.parts_interpolate("p", "lo").alias("at"), geo.parts_substring("p", "lo", "hi").alias("cut"),
        geo.parts_closest("p", "q").alias("c"), geo.parts_centroid("p").alias("m"), geo.parts_envelope("p").alias("b"),
        geo.parts_start("p").alias("a"), geo.parts_end("p").alias("z"))
    for r in got.collect():
        _, parts, lo, hi, q = rows[r.id]
        edges = edges_of(parts)
        total = sum(n for *_, n in edges)
        assert r.n == pytest.approx(total) and near([tuple(r["at"])], [slow_point(parts, lo)])
        want = slow_piece(parts, lo, hi)
        assert len(r.cut) == len(want) and all(near([tuple(v) for v in g], w) for g, w in zip(r.cut, want))
        assert near([tuple(r.a), tuple(r.z)], [parts[0][0], parts[-1][-1]])
        assert tuple(r.m) == pytest.approx(tuple(sum(n * (a[k] + b[k]) / 2 for a, b, n in edges) / total for k in (0, 1)))
        xs, ys = zip(*[v for g in parts for v in g])
        assert tuple(r.b) == (min(xs), min(ys), max(xs), max(ys))
        dists = [min(math.dist(q, slow_point([[a, b]], k / 2000)) for k in range(2001)) for a, b, _ in edges]
        assert r.c.dist == pytest.approx(min(dists), abs=0.05) and r.c.total == pytest.approx(total)


def test_ends_and_nulls_of_parts(spark):
    two = [[(0.0, 0.0), (3.0, 4.0)], [(10.0, 4.0), (10.0, 10.0)]]
    df = spark.createDataFrame([(two, 0.0, 1.0), (two, 0.5, 0.5), (two, 0.0, 5.0 / 11.0), (None, 0.1, 0.9), (two, None, 0.9)],
                               f"p {sh.MULTILINE_TYPE}, lo double, hi double")
    cut = [r[0] for r in df.select(geo.parts_substring("p", "lo", "hi")).collect()]
    assert cut[1] is None and cut[3] is None and cut[4] is None and len(cut[0]) == 2
    assert [[tuple(v) for v in g] for g in cut[2]] == [two[0]]
    where_parts_meet = df.limit(1).select(geo.parts_interpolate("p", "5D/11D")).first()[0]
    assert tuple(where_parts_meet) == (10.0, 4.0)
    assert spark.range(1).select(F.expr(sh.running("array(1D, 2D, 4D, 8D, 16D)"))).first()[0] == [1, 3, 7, 15, 31]
    assert spark.range(1).select(F.expr(sh.running("cast(array() AS array<double>)"))).first()[0] == []


def test_two_part_roads_keep_clips_and_accident_places(spark):
    whole = [road("s1", 0, (0.0, 10.0)), road("s2", 1000, (10.0, 20.0))]
    parts = [[(2000.0, 0.0), (2600.0, 0.0)], [(2600.0, 500.0), (3000.0, 500.0)]]
    roads = spark.createDataFrame(
        [(*w, None) for w in whole] + [(*road("s3", 2000, (20.0, 30.0))[:-1], None, parts)], f"{ROAD_SCHEMA}, geom_parts {sh.MULTILINE_TYPE}")
    iv = spark.createDataFrame([("s1", 0.0, 1.0), ("s2", 1.0, 2.0), ("s3", 2.0, 3.0)], "wegvak_id string, beg_km double, end_km double")
    acc = spark.createDataFrame([], "accident_id string, accident_year int, severity string, wegvak_id string, hm double, fatal_count int, "
                                    "injury_count int, road_number_norm string")
    bins = {r.bin_id: r for r in lb.road_bins(roads, acc, iv, [2]).collect()}
    assert len(bins["A2_2km_00001_HR_H"].geom_parts) == 2 and bins["A2_2km_00001_HR_H"].geometry_quality != "empty"
    flags = lb.road_bins(roads, acc, iv, [2], geometry=False, drawn=True)
    assert {r.bin_id: r.is_drawn for r in flags.collect()} == dict.fromkeys(bins, True)
    chain = ch.build_chain(roads)
    assert {r.wegvak_id: (r.chain_start_m, r.chain_end_m) for r in chain.collect()} == {
        "s1": (0.0, 1000.0), "s2": (1000.0, 2000.0), "s3": (2000.0, 3000.0)}
    spots = spark.createDataFrame([("a", 2020, "L", "s3", 0, 0, "A2", (2800.0, 490.0)), ("b", 2020, "L", "s3", 0, 0, "A2", (2300.0, 10.0))],
                                  "accident_id string, accident_year int, severity string, wegvak_id string, fatal_count int, "
                                  f"injury_count int, road_number_norm string, geom_rd {sh.POINT_TYPE}")
    snapped = ch.snap_accidents(spots, roads, chain).collect()
    assert {r.accident_id: (r.chain_m, r.dist) for r in snapped} == {"a": (2800.0, 10.0), "b": (2300.0, 10.0)}


def test_long_lines_cost_their_length(spark):
    def seconds(n, column):
        line = spark.sql(f"SELECT transform(sequence(0, {n}), v -> named_struct('x', cast(v AS double), 'y', cast(v % 7 AS double))) g FROM range(1)")
        times = []
        for _ in range(3):
            t0 = time.perf_counter()
            line.select(column).collect()
            times.append(time.perf_counter() - t0)
        return min(times)

    for column in (F.size(geo.measured("g")), F.size(geo.substring("g", "0.1D", "0.9D"))):
        seconds(1000, column)
        # the square would be a hundredfold
        assert seconds(100_000, column) < 30 * seconds(10_000, column) + 0.5
