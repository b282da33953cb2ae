"""Safe typing and road names."""

import datetime

from pyspark.sql import functions as F

from roadlines.config import TargetRules
from roadlines.functions import text as tx
from roadlines.operators.roads import is_target, normalize_road, orient_measures, with_road_number


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_safe_numbers(spark):
    assert values(spark, ["2.5", "-2.5", " 3 ", "1e2", "2.7", "x", "", None, "1d", "99999999999"], tx.safe_int) == [
        3, -3, 3, 100, 3, None, None, None, None, None]
    assert values(spark, ["1.5", " 2 ", "7f", "", None], tx.safe_double) == [1.5, 2.0, None, None, None]


def test_safe_dates(spark):
    day = datetime.date(2020, 1, 2)
    assert values(spark, ["2020-01-02", "2020-1-2", "2020/01/02", "2020-01-02 10:00:00", "2020", "02-01-2020x", ""],
                  tx.safe_date) == [day, day, day, day, None, None, None]


NAMES = [  # raw, letter, number, alt, type -> general name, target-rule name
    ("A2", None, None, None, "P", "A2", "A2"),
    (" a 02 ", None, None, None, "P", "A2", "A02"),
    ("002", None, None, None, "P", "002", "A2"),
    ("N 231", None, None, None, "P", "N231", "N231"),
    ("Rijksweg 2", None, None, None, "R", "A2", "RIJKSWEG2"),
    ("autosnelweg 012", None, None, None, "R", "A12", "AUTOSNELWEG012"),
    ("", "A", "02", None, "R", "A2", "A2"),
    (None, "A", None, "002", "R", None, "A2"),
    (None, "A", "", "002", "R", None, None),
    ("  ", None, None, None, "R", None, ""),
    ("S100", "A", "9", None, "P", "S100", "S100"),
    ("A000", None, None, None, "P", "A0", "A000"),
]


def test_road_names_and_target(spark):
    df = spark.createDataFrame(
        [(i, *n) for i, n in enumerate(NAMES)],
        "i int, road_number_raw string, route_letter string, route_number string, road_number_alt string, "
        "road_type_raw string, general string, target string")
    rules = TargetRules()
    general = {r["i"]: r["road_number_norm"] for r in normalize_road(df).collect()}
    target = {r["i"]: r["road_number_norm"] for r in with_road_number(df, rules).collect()}
    for i, n in enumerate(NAMES):
        assert general[i] == n[5], n
        assert target[i] == n[6], n
    flags = {r["i"]: r["is_target"] for r in is_target(normalize_road(df), rules).collect()}
    assert [i for i, f in flags.items() if f] == [0, 1, 2, 4, 6]


def test_measures_are_oriented(spark):
    df = spark.createDataFrame([(5.0, 2.0), (1.0, 2.0), (None, 2.0), (3.0, None)], "start_hm double, end_hm double")
    assert [tuple(r) for r in orient_measures(df).collect()] == [(2.0, 5.0), (1.0, 2.0), (None, 2.0), (3.0, None)]
