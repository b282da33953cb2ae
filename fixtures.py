"""Road-network and accident tables derived from the driver's tables.

The same rules are written once for Spark (DataFrames) and once for DuckDB (CTEs). Every
source row takes part: a part is a road segment (with zero to two km intervals and, but for
one in thirteen, a line), an order is an accident, customers and suppliers are road points.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

WEGVAKKEN = """
SELECT CAST(p_partkey AS VARCHAR(20)) AS wvk_id, CAST(p_partkey + 500000 AS VARCHAR(20)) AS fk_veld1,
 CASE p_partkey % 10 WHEN 0 THEN 'A2' WHEN 1 THEN ' a2 ' WHEN 2 THEN '002' WHEN 3 THEN 'A 12' WHEN 4 THEN 'A1'
   WHEN 5 THEN 'a4' WHEN 6 THEN 'N231' WHEN 7 THEN '' WHEN 8 THEN NULL ELSE 'E25' END AS wegnr_hmp,
 CASE WHEN p_partkey % 10 IN (7, 8) THEN 'R' ELSE 'P' END AS wegbehsrt,
 CASE WHEN p_partkey % 20 = 7 THEN '002' END AS wegnummer,
 CASE WHEN p_partkey % 20 IN (7, 8) THEN 'A' END AS routeltr,
 CASE WHEN p_partkey % 20 = 8 THEN '02' END AS routenr,
 CASE p_size % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'T' END AS rijrichtng,
 CASE WHEN p_size % 4 = 0 THEN 'VWG' ELSE 'HR' END AS bst_code,
 CAST((p_partkey % 200) * 5 AS VARCHAR(20)) AS klok_beg,
 CASE WHEN p_partkey % 29 = 0 THEN 'x'
   ELSE CAST((p_partkey % 200) * 5 + (p_size % 7 - 2) * 5 AS VARCHAR(20)) END AS klok_end
FROM {part}
"""

HECTOINTERVALLEN = """
SELECT CAST(p_partkey AS VARCHAR(20)) AS wvk_id,
 CAST((p_partkey % 200) * 0.5 + k * 0.25 AS VARCHAR(20)) AS begkm,
 CAST((p_partkey % 200) * 0.5 + k * 0.25 + 0.5 * (p_partkey % 3) AS VARCHAR(20)) AS endkm
FROM {part} {twice}
WHERE (k = 0 AND p_partkey % 17 <> 0) OR (k = 1 AND p_size % 5 = 0)
"""

ACCIDENTS = """
SELECT CAST(o_orderkey AS VARCHAR(20)) AS vkl_nummer, CAST(year(o_orderdate) AS VARCHAR(20)) AS jaar_vkl,
 CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) AS datum_vkl,
 CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_orderkey % 24 AS VARCHAR(20)) END AS uur,
 CASE o_orderstatus WHEN 'F' THEN 'DOD' WHEN 'O' THEN ' LET '
   WHEN 'P' THEN CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE 'UMS' END END AS ap3_code,
 o_orderpriority AS aol_id,
 CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE CAST(o_custkey AS VARCHAR(20)) END AS wvk_id,
 CASE WHEN o_orderkey % 4 = 0 THEN CAST(CAST(floor(o_custkey / 4) AS BIGINT) AS VARCHAR(20)) ELSE '' END AS fk_veld5,
 CASE WHEN o_orderkey % 3 = 0 THEN ''
   ELSE CAST((o_custkey % 200) * 5 + o_orderkey % 5 AS VARCHAR(20)) END AS hectometer,
 CASE WHEN o_orderstatus = 'F' THEN CAST(1 + o_orderkey % 2 AS VARCHAR(20)) ELSE '' END AS antl_dod,
 CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderkey % 3 AS VARCHAR(20)) ELSE NULL END AS antl_gzh,
 CASE WHEN o_orderkey % 10 = 3 THEN CAST(20000 + (o_custkey % 200) * 500 + o_orderkey % 97 AS VARCHAR(20)) END AS x_direct,
 CASE WHEN o_orderkey % 20 = 13 THEN '0'
   ELSE CAST(400000 + (o_custkey % 200) * 100 + o_orderkey % 53 AS VARCHAR(20)) END AS y_direct
FROM {orders}
"""

PUNTLOCATIES = """
SELECT CAST(s_suppkey AS VARCHAR(20)) AS fk_veld5,
 CAST(20000 + (s_suppkey % 200) * 500 + s_suppkey % 7 * 10 AS VARCHAR(20)) AS x_coord,
 CASE WHEN s_nationkey % 9 = 0 THEN ''
   ELSE CAST(400060 + (s_suppkey % 200) * 100 + s_suppkey % 11 AS VARCHAR(20)) END AS y_coord
FROM {supplier}
"""

HECTOPUNTEN = """
SELECT CAST(CAST(floor(c_custkey / 4) AS BIGINT) AS VARCHAR(20)) AS fk_veld5,
 CAST(c_custkey AS VARCHAR(20)) AS wvk_id,
 CAST((c_custkey % 200) * 5 + c_nationkey % 6 AS VARCHAR(20)) AS hectometer
FROM {customer}
"""

# one to three edges per line; parallel tracks 40 m apart; consecutive positions touch
LINES_SPARK = """
SELECT CAST(p_partkey + 500000 AS VARCHAR(20)) AS fk_veld1,
 CASE WHEN p_partkey % 13 <> 0 THEN transform(sequence(0, CAST(1 + p_partkey % 3 AS INT)), v -> named_struct(
   'x', 20000.0D + (p_partkey % 200) * 500.0D + v * 500.0D / (1 + p_partkey % 3),
   'y', 400000.0D + (p_partkey % 200) * 100.0D + (p_size % 2) * 40.0D + v * 100.0D / (1 + p_partkey % 3)
     + CASE WHEN v = 1 AND p_partkey % 3 > 0 THEN 150.0D ELSE 0.0D END)) END AS geom
FROM {part}
"""

# every fourth line of two edges and more in two parts: after its first edge it goes on beside itself
IS_SPLIT = "({fk} - 500000) % 4 = 1 AND ({fk} - 500000) % 3 > 0"
SPLIT_SHIFT = (60.0, -25.0)

VERTICES_DUCK = """
SELECT CAST(p_partkey + 500000 AS VARCHAR(20)) AS fk_veld1, v AS seq,
 20000.0e0 + (p_partkey % 200) * 500.0e0 + v * 500.0e0 / (1 + p_partkey % 3) AS x,
 400000.0e0 + (p_partkey % 200) * 100.0e0 + (p_size % 2) * 40.0e0 + v * 100.0e0 / (1 + p_partkey % 3)
   + CASE WHEN v = 1 AND p_partkey % 3 > 0 THEN 150.0e0 ELSE 0.0e0 END AS y
FROM part CROSS JOIN (VALUES (0), (1), (2), (3)) t(v)
WHERE p_partkey % 13 <> 0 AND v <= 1 + p_partkey % 3
"""

_SPARK_TWICE = "LATERAL VIEW explode(array(0, 1)) t AS k"
_DUCK_TWICE = "CROSS JOIN (VALUES (0), (1)) t(k)"


# read with a given schema, so that planning opens no file
SCHEMAS = {
    "part": "p_partkey bigint, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "customer": "c_custkey bigint, c_nationkey int",
}


class Tables:
    """Raw tables as DataFrames, one attribute per table, read when first asked for."""

    _texts = {
        "wegvakken": WEGVAKKEN, "wegvakgeografie": LINES_SPARK, "puntlocaties": PUNTLOCATIES,
        "hectopunten": HECTOPUNTEN, "hectointervallen": HECTOINTERVALLEN, "accidents": ACCIDENTS,
    }

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        text = self._texts.get(name)
        if text is None:
            raise AttributeError(name)
        table = text.split("{", 1)[1].split("}", 1)[0]
        base = self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.sf_dir}/{table}.parquet")
        frame = self.spark.sql(text.replace("{twice}", _SPARK_TWICE), **{table: base})
        setattr(self, name, frame)
        return frame


class SplitTables(Tables):
    """The same tables, in which some road lines have two parts."""

    @cached_property
    def wegvakgeografie(self) -> DataFrame:
        lines = Tables.__getattr__(self, "wegvakgeografie")
        split = IS_SPLIT.format(fk="CAST(fk_veld1 AS BIGINT)")
        dx, dy = SPLIT_SHIFT
        rest = (f"transform(slice(geom, 2, size(geom) - 1), v -> named_struct('x', v.x + {dx}D, 'y', v.y + ({dy}D)))")
        return lines.selectExpr(
            "fk_veld1", f"CASE WHEN NOT ({split}) THEN geom END AS geom",
            f"CASE WHEN {split} AND geom IS NOT NULL THEN array(slice(geom, 1, 2), {rest}) END AS geom_parts")


def split_edges() -> str:
    """The edges of the lines in two parts, as the body of the expression that lists edges."""
    dx, dy = SPLIT_SHIFT
    return f"""
SELECT fk, seq, x1 + d * {dx}e0 AS x1, y1 + d * ({dy}e0) AS y1, x2 + d * {dx}e0 AS x2, y2 + d * ({dy}e0) AS y2 FROM (
 SELECT fk_veld1 AS fk, seq, lag(x) OVER w AS x1, lag(y) OVER w AS y1, x AS x2, y AS y2,
  CASE WHEN {IS_SPLIT.format(fk="CAST(fk_veld1 AS BIGINT)")} AND seq >= 2 THEN 1 ELSE 0 END AS d
 FROM fx_vertices WINDOW w AS (PARTITION BY fk_veld1 ORDER BY seq))"""


def duck_ctes() -> dict[str, str]:
    """The same tables as DuckDB CTE bodies."""
    def text(sql: str) -> str:
        for table in ("part", "orders", "supplier", "customer"):
            sql = sql.replace("{" + table + "}", table)
        return sql.replace("{twice}", _DUCK_TWICE).strip()

    return {
        "fx_wegvakken": text(WEGVAKKEN),
        "fx_hectointervallen": text(HECTOINTERVALLEN),
        "fx_accidents": text(ACCIDENTS),
        "fx_puntlocaties": text(PUNTLOCATIES),
        "fx_hectopunten": text(HECTOPUNTEN),
        "fx_vertices": text(VERTICES_DUCK),
    }
