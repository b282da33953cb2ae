"""Rings, boxes and bars of all rows, with no line drawn twice for a filter."""

import math

from pyspark.sql import functions as F

import catalogue
from roadlines.functions import geometry as geo
from roadlines.functions import shapes as sh
from roadlines.functions.shapes import LINE_TYPE
from roadlines.operators import stats

LINES = [("1", [(155000.0, 463000.0), (155100.0, 463000.0), (155100.0, 463200.0)]), ("2", [(155000.0, 463000.0)] * 2),
         ("3", [(155000.0, 463000.0)]), ("4", None), (None, [(160000.0, 470000.0), (160300.0, 470400.0)])]


def filters(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Filter " in line]


def ring_of(line, width=15.0):
    def side(w):
        for i, (x, y) in enumerate(line):
            (bx, by), (ax, ay) = line[max(i - 1, 0)], line[min(i + 1, len(line) - 1)]
            span = math.hypot(ax - bx, ay - by)
            yield (x + w * (by - ay) / span, y + w * (ax - bx) / span) if span else (x, y)

    left, right = list(side(width)), list(side(-width))
    return left + right[::-1] + left[:1]


class Lines:
    def __init__(self, lines):
        self.lines = lines


def test_ribbons_of_segments_are_drawn_once(spark):
    made = spark.createDataFrame(LINES, f"fk_veld1 string, g {LINE_TYPE}").repartition(2)
    lines = made.select("fk_veld1", F.expr("transform(g, p -> named_struct('x', p.x, 'y', p.y))").alias("geom"))
    rings = catalogue.segment_ribbons(Lines(lines))
    assert all(line.count("transform(") < 4 for line in filters(rings))
    want = {(k, i): p for k, line in LINES if line and len(line) > 1 for i, p in enumerate(ring_of(line))}
    back = rings.withColumn("m", F.expr(sh.wgs84_point_to_rd("lon", "lat")))
    got = {(r.fk_veld1, r.pos): (r.m.x, r.m.y) for r in back.collect()}
    assert got.keys() == want.keys()
    assert all(math.dist(got[k], want[k]) < 1 for k in want)


def test_boxes_leave_lines_to_the_sums(spark):
    rows = [("A1", *LINES[0]), ("A1", *LINES[4]), ("A2", *LINES[3])]
    made = spark.createDataFrame(rows, f"road string, id string, g {LINE_TYPE}").repartition(2)
    boxes = stats.bbox(made.withColumn("geom_wgs84", geo.rd_to_wgs84("g")), by=["road"])
    assert not any("transform(" in line for line in filters(boxes))
    (box,) = boxes.collect()  # a road without a line has no box
    assert box.road == "A1" and boxes.columns == ["road", "xmin", "ymin", "xmax", "ymax"]
    assert abs(box.xmin - 5.387206) < 1e-4 and box.xmin < box.xmax and box.ymin < box.ymax
    assert stats.bbox(made.where("road = 'A2'").withColumn("geom_wgs84", geo.rd_to_wgs84("g"))).collect() == [(None,) * 4]


def test_bars_of_all_bins(spark):
    class Bins(catalogue.Network):
        flagged_bins = spark.createDataFrame(
            [("a", "A2", 5, 1, 2.0, True), ("b", "A2", 5, 4, 8.0, False), ("c", "A2", 5, 0, 0.0, False)],
            "bin_id string, road_number string, bin_size_km int, accident_count long, density_per_km_year double, is_drawn boolean")
        sized_bins = flagged_bins.drop("is_drawn")

    got = {r.bin_id: (r.height_density, r.height_count) for r in catalogue.bar_heights(Bins(spark, "")).collect()}
    assert got == {"a": (25.0, 25.0), "b": (100.0, 100.0), "c": (0.0, 0.0)}
