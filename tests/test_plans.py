"""Whole queries on hand data and on the small driver tables."""

import json

import pytest
from pyspark.sql import functions as F

import catalogue
from roadlines.config import AppConfig, ColumnMap, NotImplementedRoad, check_args, check_map, clean_direction
from roadlines.operators import chain as ch
from roadlines.operators import classes as cl
from roadlines.operators import filters as flt
from roadlines.operators import stats as st
from roadlines.operators.accidents import attach_intervals, locate_accidents
from roadlines.operators.joins import cross_one
from roadlines.plans import build, export as ex, live_bins as lb, validate as va
from roadlines.plans.chain_bins import chain_bins
from roadlines.sources.ingest import tables_ready
from roadsupport import ACC_SCHEMA, ROAD_SCHEMA, SF, road


def test_config_checks():
    cfg = AppConfig()
    assert check_args(cfg, " a2 ", 5, "h") == ("A2", 5, "H")
    for bad in ({"size": 3}, {"direction": "X"}):
        with pytest.raises(ValueError):
            check_args(cfg, "A2", **bad)
    with pytest.raises(NotImplementedRoad):
        check_args(cfg, "N231")
    assert clean_direction("ALL") is None
    assert check_map(ColumnMap()) == []
    tree = {"nwb": {"wegvakken": {"id_col": "X", "notes": 1}}, "bron": {"accidents": {"year_col": "Y"}},
            "a2": {"allowed_raw_road_number_values": ["A2", 2]}}
    cmap = ColumnMap.from_dict(tree)
    assert cmap.wegvakken.id_col == "X" and cmap.wegvakken.direction_col is None
    assert cmap.target.allowed_raw_road_number_values == ("A2", "2")
    assert check_map(cmap) == ["wegvakken.road_number_col is not set", "accidents.accident_id_col is not set",
                               "accidents.wegvak_id_col is not set"]
    assert AppConfig.from_dict({"target_road": "a9"}).roads == ("A9",)


def test_unset_roles_become_typed_nulls(spark):
    df = spark.createDataFrame([("1",)], "a string")
    out = flt.project_roles(df, {"id": "a", "hour": None})
    assert out.dtypes == [("id", "string"), ("hour", "string")] and tuple(out.first()) == ("1", None)


def test_location_cascade(spark):
    roads = spark.createDataFrame(
        [road("w1", 0, (10.0, 20.0)), road("w2", 5000), road("w3", 0, geom=False)], ROAD_SCHEMA)
    points = spark.createDataFrame(
        [("p1", "w1", 1.0, (7.0, 8.0)), ("p2", None, None, None)],
        "point_id string, wegvak_id string, hm double, geom_rd struct<x:double,y:double>")
    rows = [("a", "w1", "p1", 15.0, (1.0, 1.0)), ("b", "w1", "p1", 15.0, None), ("c", "w1", "p2", 15.0, None),
            ("d", "w2", None, 0.25, None), ("e", "w2", None, None, None), ("f", "w3", None, 3.0, None),
            ("g", None, None, 3.0, None), ("h", "w1", None, 99.0, None), ("i", "w9", "p9", None, None)]
    staging = spark.createDataFrame(
        rows, "accident_id string, wegvak_id string, point_id string, hm double, geom_direct struct<x:double,y:double>"
    ).withColumns({c: F.lit(None).cast(t) for c, t in {
        "accident_year": "int", "accident_date": "date", "accident_hour": "int", "severity": "string",
        "accident_type": "string", "road_number_raw": "string", "road_type_raw": "string"}.items()})
    got = {r["accident_id"]: r for r in locate_accidents(staging, roads, points).collect()}
    assert len(got) == len(rows)
    assert [got[k]["location_quality"] for k in "abcdefghi"] == [
        "direct_xy", "puntlocatie", "wegvak_hm_interpolated", "wegvak_hm_interpolated",
        "wegvak_midpoint_fallback", "unresolved", "unresolved", "wegvak_hm_interpolated", "unresolved"]
    assert got["c"]["geom_rd"]["x"] == 500.0 and got["h"]["geom_rd"]["x"] == 1000.0
    assert got["d"]["geom_rd"]["x"] == 5250.0      # 0.25 / 1000 m * 1000, the unit quirk is kept
    assert got["e"]["geom_rd"]["x"] == 5500.0


def test_chainage_without_geometry(spark):
    roads = spark.createDataFrame(
        [road("s1", 0, (0.0, 10.0)), road("s2", 1000, (10.0, 10.0)), road("t1", 20, direction="T")], ROAD_SCHEMA)
    chain = ch.build_chain(roads)
    assert [(r["wegvak_id"], r["seg_ord"], r["chain_start_m"], r["chain_end_m"]) for r in chain.orderBy("seg_ord").collect()] == [
        ("s1", 1, 0.0, 1000.0), ("s2", 2, 1000.0, 2000.0)]
    mapping = {r["wegvak_id"]: r["canonical_wegvak_id"] for r in ch.canonical_segments(roads, chain).collect()}
    assert mapping == {"s1": "s1", "s2": "s2", "t1": "s1"}
    acc = spark.createDataFrame(
        [("a", 2020, "L", "s1", None, 5.0, 0, 0, "A2", None), ("b", 2020, "L", "s2", None, 5.0, 0, 0, "A2", None),
         ("c", 2020, "L", "t1", None, 99.0, 0, 0, "A2", None), ("d", 2020, "L", "zz", None, 5.0, 0, 0, "A2", None),
         ("e", 2020, "L", "t1", None, None, 1, 0, "A2", (1600.0, 40.0))], ACC_SCHEMA)
    got = {r["accident_id"]: r["chain_m"] for r in ch.accident_chainage(acc, roads, chain).collect()}
    assert got == {"a": 500.0, "b": 1500.0, "c": 1000.0, "d": None, "e": 1600.0}
    bins = {r["bin_id"]: r for r in chain_bins(chain, [1, 5]).collect()}
    assert sorted(bins) == ["A2_1km_00000", "A2_1km_00001", "A2_5km_00000"]
    assert [tuple(p) for p in bins["A2_5km_00000"]["geom_rd"]] == [(0.0, 0.0), (1000.0, 0.0), (2000.0, 0.0)]


def test_live_counts_keep_the_fan_out(spark):
    """Weighted counts equal the row-level join in which an accident repeats per interval."""
    roads = spark.createDataFrame([road("s1", 0), road("s2", 1000), road("v", 0, lane="VWG")], ROAD_SCHEMA)
    iv = spark.createDataFrame([("s1", 0.0, 1.0), ("s1", 0.5, 1.5), ("s2", 1.0, 4.0), ("s2", None, 2.0)],
                               "wegvak_id string, beg_km double, end_km double")
    rows = [(f"h{i}", 2020, "D", "s1", None, 12.0, 1, None, "A2", None) for i in range(50)]
    rows += [("m1", 2020, "L", "s1", None, None, 0, 2, "A2", None), ("m2", 2020, "L", "s2", None, None, 0, 2, "A2", None),
             ("z", 2020, "L", "v", None, 3.0, 0, 2, "A2", None)]
    acc = spark.createDataFrame(rows, ACC_SCHEMA)
    scored = lb.scored_accidents(acc, roads, iv)
    slow = {r["km"]: r["n"] for r in scored.groupBy(F.floor("road_km").alias("km")).agg(F.count("*").alias("n")).collect()}
    fast = {r["road_km"]: r["accident_count"] for r in lb.accidents_per_km(acc, roads, iv).collect()}
    assert fast == slow == {1: 101, 0: 1, 2: 1, None: 1}
    assert attach_intervals(acc, iv, dedupe=True).count() == acc.count()
    bins = {r["bin_id"]: r for r in lb.road_bins(roads, acc, iv, [2]).collect()}
    first = bins["A2_2km_00000_HR_H"]
    assert (first["accident_count"], first["fatal_count"], first["injury_count"]) == (102, 100, 2)
    assert first["year_span"] == 1 and first["density_per_km_year"] == 51.0
    assert json.loads(first["geojson"])["type"] in ("LineString", "MultiLineString")


def test_density_classes_and_breaks(spark):
    bins = spark.createDataFrame([("A", 1, float(d)) for d in [0, 0, 3, 5, 8, 12, 13, 21, 30, 31]],
                                 "road_number string, bin_size_km int, density_per_km_year double")
    b = cl.density_breaks(bins).first()
    assert (b["t1"], b["t2"], b["t3"], b["t4"]) == (3, 12, 22, 30)
    labels = [r["label"] for r in cl.class_table(cl.density_breaks(bins)).orderBy("class").collect()]
    assert labels == ["0", "< 3", "3–12", "12–22", "22–30", "30+"]
    some = spark.createDataFrame([(0.0,), (0.005,), (6.0,), (10.9,), (22.0,), (None,)], "density_per_km_year double")
    assert [r["density_class"] for r in cl.classify(some).collect()] == [0, 1, 2, 2, 5, 0]
    assert cl.select_bins(bins).count() == 0


def test_features_and_density_repair(spark):
    df = spark.createDataFrame(
        [("b1", None, None, 10, 2000.0, 2, '{"type":"Point","coordinates":[1,2]}'),
         ("b2", float("nan"), 6.0, 10, 2000.0, 2, '{"type":"Point","coordinates":[1,2]}'), ("b3", 1.0, None, 1, 1.0, 1, None)],
        "bin_id string, density_per_km_year double, density_per_km double, accident_count int, length_m double, "
        "year_span int, geojson string")
    got = [json.loads(r["feature"]) for r in ex.to_features(df).collect()]
    assert [f["properties"]["density_per_km_year"] for f in got] == [2.5, 3.0]
    assert got[0]["type"] == "Feature" and got[0]["properties"]["density_per_km"] is None


def test_small_joins(spark):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    one = spark.createDataFrame([("x", 7)], "s string, n int")
    assert [tuple(r) for r in cross_one(df, one).orderBy("a").collect()] == [(1, "x", 7), (2, "x", 7)]
    meta = flt.one_row_meta([df.agg(F.count("*").alias("rows")), one])
    assert tuple(meta.first()) == (2, "x", 7)


def test_validation_reports_problems(spark):
    roads = spark.createDataFrame([], ROAD_SCHEMA).withColumn("geom_wgs84", F.col("geom_rd"))
    acc = spark.createDataFrame([], ACC_SCHEMA).withColumn("location_quality", F.lit("unresolved"))
    raw = spark.range(1)
    failed = {r["name"] for r in va.issues(va.validate(raw, acc, roads, "A2")).collect()}
    assert failed == {"normalized_accidents", "segments", "lon_min", "lat_min", "lon_max", "lat_max"}
    with pytest.raises(ValueError):
        va.require_same_count(raw, acc)
    with pytest.raises(ValueError):
        va.require_segments(roads)


def test_road_search_and_archive_errors(spark):
    summary = spark.createDataFrame([("A2", 1, 2, "implemented")],
                                    "road_number string, segment_count bigint, accident_count bigint, status string")
    assert st.road_search(summary, " a2").count() == 1
    assert {r["status"] for r in st.road_search(summary, "n1").collect()} == {"implemented", "not_implemented_yet"}
    with pytest.raises(ValueError):
        ex.archive_counts({"roads_norm": summary})
    with pytest.raises(ValueError):
        ex.serving_tables({"roads_norm": summary}, ["A2"])


def test_tables_are_built_and_exported(spark, own_database, tmp_path):
    n = catalogue.Network(spark, SF)
    for name, df in {"raw_nwb_wegvakken": n.raw.wegvakken, "raw_nwb_wegvakgeografie": n.raw.wegvakgeografie,
                     "raw_nwb_puntlocaties": n.raw.puntlocaties, "raw_nwb_hectopunten": n.raw.hectopunten,
                     "raw_nwb_hectointervallen": n.raw.hectointervallen, "raw_bron_accidents": n.raw.accidents}.items():
        df.write.mode("overwrite").saveAsTable(name)
    build.normalize(spark, ColumnMap())
    assert tables_ready(spark)
    blank = spark.table("roads_norm").where("road_number_norm = ''").count()
    assert blank == n.roads.where("road_number_norm = ''").count()
    build.build_bins(spark, "A2", [1, 5])
    cube = spark.table("accident_bin_counts_a2")
    placed = spark.table("accidents_a2_chainage").where("chain_m is not null").count()
    at_end = spark.table("accidents_a2_chainage").crossJoin(spark.table("a2_total")).where(
        "chain_m >= total_length_m").count()
    for size in (1, 5):
        assert cube.where(F.col("bin_size_km") == size).agg(F.sum("accident_count")).first()[0] == placed - at_end
    tables = {t: spark.table(t) for t in (
        "raw_nwb_wegvakken", "raw_nwb_hectointervallen", "raw_bron_accidents", "roads_norm", "accidents_norm",
        "accidents_staging", "road_points_norm")}
    counts = {r["table"]: r["rows"] for r in ex.export_raw(tables, str(tmp_path / "raw")).collect()}
    assert counts["raw_bron_accidents"] == spark.table("accidents_norm").count()
    served = {r["table"]: r["rows"] for r in ex.export_serving(tables, str(tmp_path / "serve"), ["A2", "A4"]).collect()}
    assert served["accidents_staging"] == served["accidents_norm"] > 0
    ex.write_report(va.same_count(tables["raw_bron_accidents"], tables["accidents_norm"]), str(tmp_path / "report"))
    bins = lb.road_bins(spark.table("roads_norm"), spark.table("accidents_norm"), n.intervals, [5], "A2")
    ex.write_features(bins, str(tmp_path / "features"))
    for r in spark.read.text(str(tmp_path / "features")).collect():
        assert json.loads(r["value"])["geometry"]["type"].endswith("LineString")
