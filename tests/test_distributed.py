"""Distributed operators against brute-force twins, with hot groups."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from roadlines.functions.shapes import LINE_TYPE
from roadlines.operators import bins as bn
from roadlines.operators import joins as jn
from roadlines.operators.merge import merge_lines
from roadlines.operators.scan import prefix_scan


def test_prefix_scan_equals_window(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 5}", rng.randint(0, 50), str(i), float(rng.randint(1, 9)))
            for i in range(600)]
    df = spark.createDataFrame(rows, "k string, o int, id string, v double")
    w = Window.partitionBy("k").orderBy("o", "id")
    want = df.withColumn("r", F.row_number().over(w)).withColumn(
        "s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = prefix_scan(df, ["k"], ["o", "id"], rank="r", sums={"s": "v"}, slices=7)
    key = lambda r: r["id"]
    assert [(r["id"], r["r"], r["s"]) for r in sorted(got.collect(), key=key)] == [
        (r["id"], r["r"], r["s"]) for r in sorted(want.collect(), key=key)]


def grid(spark, rows):
    return bn.km_grid(spark.createDataFrame(rows, "road_number string, km_min double, km_max double"), [1, 2, 5])


def test_points_fall_into_one_bin_each(spark):
    g = grid(spark, [("A", 0.1, 33.3), ("B", -3.0, 4.0), ("C", 2.0, 2.0)])
    rng = random.Random(5)
    pts = [("A", round(0.1 + k * 0.1, 10)) for k in range(-3, 340)]
    pts += [("B", v) for v in (-3.0, -3.0000001, 3.9999999, 4.0, 0.0)] + [("C", 2.0)]
    pts += [("A", rng.uniform(0, 34)) for _ in range(200)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id int, road_number string, v double")
    defs = bn.bin_defs(g)
    brute = df.join(defs, "road_number").where(
        (F.col("v") >= F.col("bin_start")) & (F.col("v") < F.col("bin_end")))
    want = {(r["id"], r["bin_size_km"], r["bin_idx"]) for r in brute.collect()}
    got = [(r["id"], r["bin_size_km"], r["bin_idx"]) for r in bn.point_in_bin_join(df, g, "v").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_overlaps_equal_nested_loop(spark):
    g = grid(spark, [("A", 0.1, 33.3), ("B", -3.0, 4.0)])
    rng = random.Random(6)
    rows = []
    for i in range(150):
        lo = rng.choice([rng.uniform(-2, 35), round(rng.uniform(0, 30)) + 0.1])
        rows.append((i, rng.choice("AB"), lo, lo + rng.choice([0.0, 0.5, 1.0, 7.3, -0.4, 60.0])))
    segs = spark.createDataFrame(rows, "id int, road_number string, lo double, hi double")
    brute = segs.join(bn.bin_defs(g), "road_number").where(
        (F.col("hi") > F.col("bin_start")) & (F.col("lo") < F.col("bin_end")))
    want = {(r["id"], r["bin_size_km"], r["bin_idx"]) for r in brute.collect()}
    got = [(r["id"], r["bin_size_km"], r["bin_idx"]) for r in bn.overlap_join(segs, g, "lo", "hi").collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("cell", [50.0, 3000.0])
def test_nearest_equals_brute_force(spark, cell):
    rng = random.Random(11)
    lines, points = [], []
    for i in range(60):
        x, y = rng.uniform(0, 5000), rng.uniform(0, 5000)
        g = [(x, y)] + [(x + rng.uniform(-300, 300), y + rng.uniform(-300, 300)) for _ in range(rng.randint(1, 4))]
        lines.append(("A" if i % 3 else "B", g, i))
    lines += [("A", lines[1][1], 900 + k) for k in range(20)]      # copies of one line
    lines.append(("A", [(100.0, 100.0), (4900.0, 4800.0)], 500))   # one very long line
    lines.append(("C", [(9.0, 9.0)], 1))                           # a line of a single vertex
    for i in range(200):
        points.append((rng.choice("AB"), rng.uniform(-500, 5500), rng.uniform(-500, 5500)))
    points += [("A", 777.0, 777.0)] * 100                          # a hot location
    points += [("A", 90000.0, -40000.0), ("C", 12.0, 13.0), ("D", 1.0, 1.0)]
    p = spark.createDataFrame(points, "road_number string, x double, y double")
    ln = spark.createDataFrame(lines, f"road_number string, geom {LINE_TYPE}, seg_ord int")
    fast = jn.nearest_join(p, ln, ["road_number"], cell)
    slow = jn.nearest_brute(p, ln, ["road_number"])
    key = lambda r: (r["road_number"], r["x"], r["y"])
    a, b = sorted(fast.collect(), key=key), sorted(slow.collect(), key=key)
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    assert len(a) == 203


def test_covered_marks(spark):
    iv = spark.createDataFrame([("A", 0.5, 3.0), ("A", 3.0, 3.0), ("A", 5.0, 5.2), ("A", 8.2, 8.9)],
                               "road_number string, beg_km double, end_km double")
    assert sorted(r["km"] for r in jn.covered_km(iv).collect()) == [1, 2, 5]


def py_parts(lines):
    """Reference merge: vertex multisets of the parts of one group."""
    ends = defaultdict(list)
    for i, g in enumerate(lines):
        ends[g[0]].append((i, 0))
        ends[g[-1]].append((i, 1))
    link = {}
    for pair in ends.values():
        if len(pair) == 2 and pair[0][0] != pair[1][0]:
            link[pair[0]], link[pair[1]] = pair[1], pair[0]
    seen, parts = set(), []

    def follow(i, side):
        out = [i]
        while (i, side) in link:
            j, s = link[(i, side)]
            if j in out:
                break
            out.append(j)
            i, side = j, 1 - s
        return out

    for i in range(len(lines)):
        if i not in seen:
            group = set(follow(i, 0)) | set(follow(i, 1))
            seen |= group
            parts.append(frozenset(group))
    return parts


def merged(spark, groups):
    rows = [(k, g) for k, lines in groups.items() for g in lines]
    df = spark.createDataFrame(rows, f"k string, g {LINE_TYPE}")
    out = defaultdict(list)
    for r in merge_lines(df, ["k"], "g").collect():
        out[r["k"]].append([(p["x"], p["y"]) for p in r["geom"]])
    return out


def test_merge_joins_at_nodes_of_degree_two(spark):
    chain = [[(float(i), 0.0), (i + 0.5, 1.0), (i + 1.0, 0.0)] for i in range(70)]
    rng = random.Random(1)
    messy = [g[::-1] if rng.random() < 0.3 else g for g in chain]
    rng.shuffle(messy)
    square = [[(0.0, 0.0), (1.0, 0.0)], [(1.0, 0.0), (1.0, 1.0)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 1.0), (0.0, 0.0)]]
    star = [[(0.0, 0.0), (1.0, 0.0)], [(0.0, 0.0), (0.0, 1.0)], [(0.0, 0.0), (-1.0, 0.0)]]
    twins = [[(0.0, 0.0), (5.0, 5.0), (9.0, 0.0)], [(0.0, 0.0), (5.0, -5.0), (9.0, 0.0)]]
    loop = [[(0.0, 0.0), (1.0, 1.0), (2.0, 0.0), (0.0, 0.0)]]
    copies = [[(0.0, 0.0), (1.0, 0.0)]] * 5 + [[(1.0, 0.0), (2.0, 0.0)]]
    got = merged(spark, {"chain": messy, "square": square, "star": star, "twins": twins, "loop": loop,
                         "copies": copies, "point": [[(3.0, 3.0), (3.0, 3.0)]]})
    assert got["chain"] == [[p for g in chain for p in g[:2]] + [(70.0, 0.0)]]
    assert len(got["square"]) == 1 and got["square"][0][0] == got["square"][0][-1] and len(got["square"][0]) == 5
    assert len(got["star"]) == 3 and len(got["copies"]) == 6
    assert len(got["twins"]) == 1 and len(got["twins"][0]) == 5
    assert got["loop"] == loop and "point" not in got


def test_merge_random_networks(spark):
    rng = random.Random(23)
    groups = {}
    for k in range(12):
        nodes = [(float(rng.randint(0, 6)), float(rng.randint(0, 6))) for _ in range(14)]
        lines = []
        for i in range(rng.randint(3, 16)):
            a, b = rng.sample(nodes, 2)
            lines.append([a, (100.0 + i, float(k)), b])            # a middle vertex names the line
        groups[f"g{k}"] = lines
    got = merged(spark, groups)
    for k, lines in groups.items():
        want = sorted(sorted(parts) for parts in py_parts(lines))
        mine = sorted(sorted(int(x - 100) for x, _ in part if x >= 100) for part in got[k])
        assert mine == want, k
        for part in got[k]:
            steps = {frozenset((a, b)) for a, b in zip(part, part[1:])}
            known = {frozenset(s) for g in lines for s in zip(g, g[1:])}
            assert steps <= known
