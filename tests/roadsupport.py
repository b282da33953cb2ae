"""Schemas and rows that several test modules build on."""

from roadlines.functions.shapes import LINE_TYPE

SF = "/root/testdata/sf0.001"

ROAD_SCHEMA = ("wegvak_id string, road_number_raw string, road_number_norm string, direction string, carriageway string, "
               "start_hm double, end_hm double, length_m double, is_target_a2 boolean, geom_rd " + LINE_TYPE)
ACC_SCHEMA = ("accident_id string, accident_year int, severity string, wegvak_id string, point_id string, hm double, "
              "fatal_count int, injury_count int, road_number_norm string, geom_rd struct<x:double,y:double>")


def road(i, x, hm=(None, None), direction="H", lane="HR", geom=True, name="A2"):
    line = [(float(x), 0.0), (float(x) + 1000.0, 0.0)] if geom else None
    return (i, name, name, direction, lane, *hm, 1000.0 if geom else None, name == "A2", line)
