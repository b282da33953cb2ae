"""Independent SQL for the registered queries, run by DuckDB on the driver's tables.

Common table expressions below are written over edges (one row per line edge) and plain
joins; each query text gets the expressions it names, directly or through others.
"""

from __future__ import annotations

import re

from fixtures import IS_SPLIT, duck_ctes, split_edges
from roadlines.config import ROADS
from roadlines.functions import projection as pr


def _poly(terms, u: str, v: str) -> str:
    return " + ".join(f"({f!r}::DOUBLE) * pow({u}, {p}) * pow({v}, {q})" for p, q, f in terms)


def lon(x: str, y: str) -> str:
    u, v = f"(({x}) - 155000.0) * 1e-5", f"(({y}) - 463000.0) * 1e-5"
    return f"(5.38720621::DOUBLE + ({_poly(pr.LON_TERMS, u, v)}) / 3600.0)"


def lat(x: str, y: str) -> str:
    u, v = f"(({x}) - 155000.0) * 1e-5", f"(({y}) - 463000.0) * 1e-5"
    return f"(52.15517440::DOUBLE + ({_poly(pr.LAT_TERMS, u, v)}) / 3600.0)"


def rd_x(lo: str, la: str) -> str:
    u, v = f"(0.36 * (({la}) - 52.15517440))", f"(0.36 * (({lo}) - 5.38720621))"
    return f"(155000.0::DOUBLE + {_poly(pr.X_TERMS, u, v)})"


def rd_y(lo: str, la: str) -> str:
    u, v = f"(0.36 * (({la}) - 52.15517440))", f"(0.36 * (({lo}) - 5.38720621))"
    return f"(463000.0::DOUBLE + {_poly(pr.Y_TERMS, u, v)})"


def rnd(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0e0)"


CTES: dict[str, str] = {
    **duck_ctes(),
    # ---- roads
    "seg_attr": """
SELECT wvk_id AS wegvak_id, fk_veld1 AS fk, wegnr_hmp AS road_number_raw, wegbehsrt AS road_type_raw,
 wegnummer AS alt, routeltr AS letter, routenr AS number, rijrichtng AS direction, bst_code AS carriageway,
 TRY_CAST(klok_beg AS DOUBLE) AS hm_a, TRY_CAST(klok_end AS DOUBLE) AS hm_b
FROM fx_wegvakken""",
    "road_attr": """
SELECT wegvak_id, fk, road_number_raw, road_type_raw, direction, carriageway,
 CASE WHEN upper(trim(coalesce(road_number_raw, ''))) IN ('A2', '002', '2', '02')
        OR (upper(trim(coalesce(letter, ''))) = 'A'
            AND TRY_CAST(nullif(regexp_replace(coalesce(number, alt, ''), '\\D', '', 'g'), '') AS INTEGER) = 2)
        OR upper(replace(coalesce(road_number_raw, ''), ' ', '')) = 'A2' THEN 'A2'
      WHEN road_number_raw <> '' THEN upper(replace(trim(road_number_raw), ' ', '')) END AS road,
 CASE WHEN hm_a > hm_b THEN hm_b ELSE hm_a END AS start_hm,
 CASE WHEN hm_a > hm_b THEN hm_a ELSE hm_b END AS end_hm
FROM seg_attr""",
    "edges0": """
SELECT fk_veld1 AS fk, seq, lag(x) OVER w AS x1, lag(y) OVER w AS y1, x AS x2, y AS y2
FROM fx_vertices WINDOW w AS (PARTITION BY fk_veld1 ORDER BY seq)""",
    "edges1": """
SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS len FROM edges0 WHERE x1 IS NOT NULL""",
    "edges": """
SELECT *, coalesce(sum(len) OVER (PARTITION BY fk ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS walked
FROM edges1""",
    "line": """
SELECT fk, sum(len) AS total, sum(len * (x1 + x2) / 2) / sum(len) AS cx, sum(len * (y1 + y2) / 2) / sum(len) AS cy,
 arg_min(x1, seq) AS xa, arg_min(y1, seq) AS ya, arg_max(x2, seq) AS xz, arg_max(y2, seq) AS yz, count(*) + 1 AS n
FROM edges GROUP BY fk""",
    "road": """
SELECT a.*, l.total AS length_m, l.cx, l.cy, l.xa, l.ya, l.xz, l.yz FROM road_attr a LEFT JOIN line l ON l.fk = a.fk""",
    "normal0": """
SELECT fk_veld1, x, y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY fk_veld1) AS n,
 coalesce(lag(x) OVER w, x) AS xa, coalesce(lag(y) OVER w, y) AS ya, coalesce(lead(x) OVER w, x) AS xb, coalesce(lead(y) OVER w, y) AS yb
FROM fx_vertices WINDOW w AS (PARTITION BY fk_veld1 ORDER BY seq)""",
    "normal": """
SELECT *, coalesce(15 * (ya - yb) / nullif(sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)), 0), 0e0) AS mx,
 coalesce(15 * (xb - xa) / nullif(sqrt((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)), 0), 0e0) AS my
FROM normal0 WHERE n >= 2""",
    "ribbon_ring": """
SELECT fk_veld1, i AS pos, x + mx AS x, y + my AS y FROM normal
UNION ALL SELECT fk_veld1, 2 * n - 1 - i, x - mx, y - my FROM normal
UNION ALL SELECT fk_veld1, 2 * n, x + mx, y + my FROM normal WHERE i = 0""",
    "iv": """
SELECT wvk_id AS wegvak_id, TRY_CAST(begkm AS DOUBLE) AS b, TRY_CAST(endkm AS DOUBLE) AS e FROM fx_hectointervallen""",
    # ---- points
    "pt_all": """
SELECT fk_veld5 AS point_id, NULL::VARCHAR AS wegvak_id, NULL::DOUBLE AS hm,
 TRY_CAST(x_coord AS DOUBLE) AS x, TRY_CAST(y_coord AS DOUBLE) AS y FROM fx_puntlocaties
UNION ALL SELECT fk_veld5, wvk_id, TRY_CAST(hectometer AS DOUBLE), NULL, NULL FROM fx_hectopunten""",
    "pt_one": """
SELECT * FROM pt_all QUALIFY row_number() OVER (PARTITION BY point_id
 ORDER BY x IS NULL, hm NULLS LAST, wegvak_id NULLS LAST) = 1""",
    "pt_goal": """
SELECT p.*, r.road_number_raw, r.road, r.fk, r.length_m,
 least(greatest((p.hm - coalesce(r.start_hm, 0)) / nullif(abs(coalesce(r.end_hm, 0) - coalesce(r.start_hm, 0)), 0), 0e0), 1e0) AS f
FROM pt_one p LEFT JOIN road r ON r.wegvak_id = p.wegvak_id""",
    "pt": """
SELECT g.point_id, g.wegvak_id, g.road_number_raw, g.road, g.hm,
 CASE WHEN g.x IS NOT NULL AND g.y IS NOT NULL THEN g.x WHEN g.hm IS NOT NULL AND g.length_m IS NOT NULL THEN
   e.x1 + least((g.f * g.length_m - e.walked) / e.len, 1e0) * (e.x2 - e.x1) END AS px,
 CASE WHEN g.x IS NOT NULL AND g.y IS NOT NULL THEN g.y WHEN g.hm IS NOT NULL AND g.length_m IS NOT NULL THEN
   e.y1 + least((g.f * g.length_m - e.walked) / e.len, 1e0) * (e.y2 - e.y1) END AS py
FROM pt_goal g LEFT JOIN edges e ON e.fk = g.fk AND e.walked <= g.f * g.length_m
QUALIFY row_number() OVER (PARTITION BY g.point_id ORDER BY e.seq DESC NULLS LAST) = 1""",
    # ---- accidents
    "stg": """
SELECT vkl_nummer AS accident_id, TRY_CAST(jaar_vkl AS INTEGER) AS accident_year,
 TRY_CAST(datum_vkl AS DATE) AS accident_date, TRY_CAST(uur AS INTEGER) AS accident_hour,
 nullif(trim(ap3_code), '') AS severity, aol_id AS accident_type, nullif(trim(wvk_id), '') AS wegvak_id,
 nullif(trim(fk_veld5), '') AS point_id, TRY_CAST(hectometer AS DOUBLE) AS hm,
 TRY_CAST(antl_dod AS INTEGER) AS fatal_count, TRY_CAST(antl_gzh AS INTEGER) AS injury_count,
 TRY_CAST(x_direct AS DOUBLE) AS xd, TRY_CAST(y_direct AS DOUBLE) AS yd
FROM fx_accidents""",
    "acc_attr": """
SELECT s.*, r.road_number_raw, r.road, coalesce(r.road = 'A2', false) AS is_target,
 CASE WHEN p.px IS NOT NULL THEN 'puntlocatie' WHEN r.length_m IS NOT NULL AND s.hm IS NOT NULL THEN 'wegvak_hm_interpolated'
  WHEN r.length_m IS NOT NULL THEN 'wegvak_midpoint_fallback' ELSE 'unresolved' END AS location_quality,
 p.px AS ptx, p.py AS pty, r.fk, r.length_m,
 CASE WHEN s.hm IS NULL THEN 0.5e0 ELSE least(greatest(CASE WHEN r.end_hm - r.start_hm > 0
   THEN (s.hm - r.start_hm) / (r.end_hm - r.start_hm) ELSE s.hm / r.length_m * 1000 END, 0e0), 1e0) END AS f
FROM stg s LEFT JOIN road r ON r.wegvak_id = s.wegvak_id LEFT JOIN pt p ON p.point_id = s.point_id""",
    "acc": """
SELECT a.*, coalesce(ptx, e.x1 + least((f * length_m - e.walked) / e.len, 1e0) * (e.x2 - e.x1)) AS gx,
 coalesce(pty, e.y1 + least((f * length_m - e.walked) / e.len, 1e0) * (e.y2 - e.y1)) AS gy
FROM acc_attr a LEFT JOIN edges e ON e.fk = a.fk AND e.walked <= a.f * a.length_m
QUALIFY row_number() OVER (PARTITION BY a.accident_id ORDER BY e.seq DESC NULLS LAST) = 1""",
    # ---- chains
    "drawn_h": """
SELECT * FROM road WHERE length_m IS NOT NULL AND road IS NOT NULL AND coalesce(carriageway, '') = 'HR' AND coalesce(direction, '') = 'H'""",
    "drawn_any": """
SELECT * FROM road WHERE length_m IS NOT NULL AND road IS NOT NULL AND coalesce(carriageway, '') = 'HR'""",
    "axis_h": """
SELECT road, min(cx) AS mx, min(cy) AS my, max(cx) - min(cx) AS dx, max(cy) - min(cy) AS dy,
 greatest(sqrt(pow(max(cx) - min(cx), 2) + pow(max(cy) - min(cy), 2)), 1e0) AS al FROM drawn_h GROUP BY road""",
    "axis_any": """
SELECT road, min(cx) AS mx, min(cy) AS my, max(cx) - min(cx) AS dx, max(cy) - min(cy) AS dy,
 greatest(sqrt(pow(max(cx) - min(cx), 2) + pow(max(cy) - min(cy), 2)), 1e0) AS al FROM drawn_any GROUP BY road""",
    "chain0": """
SELECT d.*, row_number() OVER (PARTITION BY d.road
  ORDER BY (cx - mx) * (dx / al) + (cy - my) * (dy / al), wegvak_id) AS seg_ord
FROM drawn_h d JOIN axis_h a ON a.road = d.road""",
    "chain": """
SELECT *, sum(length_m) OVER (PARTITION BY road ORDER BY seg_ord ROWS UNBOUNDED PRECEDING) AS ce,
 sum(length_m) OVER (PARTITION BY road ORDER BY seg_ord ROWS UNBOUNDED PRECEDING) - length_m AS cs FROM chain0""",
    "total": "SELECT road, max(ce) AS total FROM chain GROUP BY road",
    "bucketed": """
SELECT d.road, d.wegvak_id, floor(((cx - mx) * (dx / al) + (cy - my) * (dy / al)) / 100) AS bucket
FROM drawn_any d JOIN axis_any a ON a.road = d.road""",
    "canon": """
SELECT b.road, b.wegvak_id, coalesce(m.lowest, b.wegvak_id) AS canonical
FROM bucketed b LEFT JOIN (SELECT b.road, bucket, min(b.wegvak_id) AS lowest FROM bucketed b
  JOIN chain c ON c.road = b.road AND c.wegvak_id = b.wegvak_id GROUP BY ALL) m ON m.road = b.road AND m.bucket = b.bucket""",
    "hr_acc": """
SELECT a.* FROM acc a WHERE a.gx IS NOT NULL AND a.road IS NOT NULL AND EXISTS (
 SELECT 1 FROM road r WHERE r.wegvak_id = a.wegvak_id AND r.road = a.road AND coalesce(r.carriageway, '') = 'HR')""",
    "spot": "SELECT DISTINCT road, gx, gy FROM hr_acc",
    "foot": """
SELECT s.road, s.gx, s.gy, c.wegvak_id, c.seg_ord, c.cs, e.walked, e.len,
 greatest(0e0, least(1e0, ((s.gx - e.x1) * (e.x2 - e.x1) + (s.gy - e.y1) * (e.y2 - e.y1))
   / ((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1)))) AS t, e.x1, e.y1, e.x2, e.y2, e.seq
FROM spot s JOIN chain c ON c.road = s.road JOIN edges e ON e.fk = c.fk""",
    "foot_d": """
SELECT *, sqrt(pow(CASE WHEN t >= 1 THEN x2 ELSE x1 + t * (x2 - x1) END - gx, 2)
             + pow(CASE WHEN t >= 1 THEN y2 ELSE y1 + t * (y2 - y1) END - gy, 2)) AS d FROM foot""",
    "near": """
SELECT road, gx, gy, wegvak_id, seg_ord, d, cs + walked + t * len AS chain_m FROM foot_d
QUALIFY row_number() OVER (PARTITION BY road, gx, gy ORDER BY d, seg_ord, seq) = 1""",
    "chainage": """
SELECT a.road, a.accident_id, a.accident_year, a.severity, a.wegvak_id, n.chain_m, a.fatal_count, a.injury_count
FROM hr_acc a JOIN near n ON n.road = a.road AND n.gx = a.gx AND n.gy = a.gy
UNION ALL
SELECT a.road, a.accident_id, a.accident_year, a.severity, a.wegvak_id,
 c.cs + CASE WHEN a.hm IS NOT NULL AND c.end_hm - c.start_hm > 0
   THEN least(greatest((a.hm - c.start_hm) / (c.end_hm - c.start_hm), 0e0), 1e0) ELSE 0.5e0 END * c.length_m,
 a.fatal_count, a.injury_count
FROM acc a LEFT JOIN canon m ON m.road = a.road AND m.wegvak_id = a.wegvak_id
LEFT JOIN chain c ON c.road = a.road AND c.wegvak_id = coalesce(m.canonical, a.wegvak_id)
WHERE a.gx IS NULL AND a.road IS NOT NULL""",
    "size": "SELECT unnest([1, 2, 5, 10, 20]) AS s",
    "cbin": """
SELECT road, s, i, i * s * 1000e0 AS bs, least((i + 1) * s * 1000e0, total) AS be FROM (
 SELECT road, total, s, unnest(generate_series(0, greatest(CAST(ceil(total / (s * 1000e0)) AS BIGINT) - 1, 0))) AS i
 FROM total, size WHERE total > 0)""",
    "cube": """
SELECT b.road, b.s, b.i, a.accident_year, a.severity, count(*) AS n,
 count(*) FILTER (coalesce(a.fatal_count, 0) > 0) AS f, count(*) FILTER (coalesce(a.injury_count, 0) > 0) AS j
FROM cbin b JOIN chainage a ON a.road = b.road AND a.chain_m >= b.bs AND a.chain_m < b.be GROUP BY ALL""",
    # ---- validation of names
    "frequency": """
SELECT col, v, count(*) AS n FROM (
 SELECT unnest(['wegnr_hmp', 'wegbehsrt', 'wegnummer', 'routeltr', 'routenr']) AS col,
        unnest([wegnr_hmp, wegbehsrt, wegnummer, routeltr, routenr]) AS v FROM fx_wegvakken)
WHERE v <> '' GROUP BY ALL""",
}


def live_ctes(tag: str, sizes: str = "[5]", where_road: str = "true", years: tuple | None = None,
              severities: str | None = None, main: bool = True, direction: str | None = None) -> dict[str, str]:
    """Expressions of the live bins for one parameter set, named <tag>_..."""
    hr = "coalesce(r.carriageway, '') = 'HR'" if main else "true"
    geom_dir = f"coalesce(r.direction, '') = '{direction or 'H'}'"
    acc_dir = f"coalesce(r.direction, '') = '{direction}'" if direction else "true"
    when = f"a.accident_year BETWEEN {years[0]} AND {years[1]}" if years else "true"
    what = f"a.severity IN ({severities})" if severities else "true"
    span = str(years[1] - years[0] + 1) if years else "y.span"
    return {
        f"{tag}_seg": f"""
SELECT r.road, r.wegvak_id, r.fk, r.length_m, iv.b, iv.e FROM road r JOIN iv ON iv.wegvak_id = r.wegvak_id
WHERE r.length_m IS NOT NULL AND r.road IS NOT NULL AND {where_road} AND {hr} AND {geom_dir}""",
        f"{tag}_ext": f"SELECT road, min(b) AS lo, max(e) AS hi FROM {tag}_seg GROUP BY road",
        f"{tag}_bin": f"""
SELECT road, s, i, lo + i * s AS bs, least(lo + (i + 1) * s, hi) AS be FROM (
 SELECT road, lo, hi, s, unnest(generate_series(0, greatest(CAST(ceil((hi - lo) / s) AS BIGINT) - 1, 0))) AS i
 FROM {tag}_ext, (SELECT unnest({sizes}) AS s) WHERE hi > lo)""",
        f"{tag}_km": f"""
SELECT a.accident_id, a.road, a.fatal_count, a.injury_count, coalesce(a.hm / 10.0, (iv.b + iv.e) / 2.0) AS km
FROM acc_attr a JOIN road r ON r.wegvak_id = a.wegvak_id AND r.road = a.road
LEFT JOIN iv ON iv.wegvak_id = r.wegvak_id
WHERE {where_road} AND {when} AND {what} AND {hr} AND {acc_dir}""",
        f"{tag}_cnt": f"""
SELECT b.road, b.s, b.i, count(*) AS n, count(*) FILTER (coalesce(k.fatal_count, 0) > 0) AS f,
 count(*) FILTER (coalesce(k.injury_count, 0) > 0) AS j
FROM {tag}_bin b JOIN {tag}_km k ON k.road = b.road AND k.km >= b.bs * 1000.0 / 1000.0 AND k.km < b.be * 1000.0 / 1000.0
GROUP BY ALL""",
        f"{tag}_span": """
SELECT road, greatest(max(accident_year) - min(accident_year) + 1, 1) AS span FROM acc_attr GROUP BY road""",
        f"{tag}_out": f"""
SELECT b.road || '_' || b.s || 'km_' || lpad(CAST(b.i AS VARCHAR), 5, '0') || '{'_HR' if main else ''}_{direction or 'H'}' AS bin_id,
 b.road AS road_number, CAST(b.s AS INTEGER) AS bin_size_km, b.i, b.bs * 1000.0 AS bin_start_m, b.be * 1000.0 AS bin_end_m,
 (b.be - b.bs) * 1000.0 AS length_m, CAST(coalesce(n, 0) AS BIGINT) AS accident_count,
 CAST(coalesce(f, 0) AS BIGINT) AS fatal_count, CAST(coalesce(j, 0) AS BIGINT) AS injury_count,
 CAST(coalesce({span}, 1) AS INTEGER) AS year_span,
 CASE WHEN b.be > b.bs THEN coalesce(n, 0) / ((b.be - b.bs) * 1000.0 / 1000.0) / coalesce({span}, 1) ELSE 0 END AS density_per_km_year
FROM {tag}_bin b LEFT JOIN {tag}_cnt c ON c.road = b.road AND c.s = b.s AND c.i = b.i
LEFT JOIN {tag}_span y ON y.road = b.road""",
        f"{tag}_clip": f"""
SELECT b.road, b.s, b.i, g.wegvak_id, g.fk, g.length_m, g.b, g.e,
 greatest(0e0, (greatest(b.bs, g.b) - g.b) / (g.e - g.b)) AS lo, least(1e0, (least(b.be, g.e) - g.b) / (g.e - g.b)) AS hi
FROM {tag}_bin b JOIN {tag}_seg g ON g.road = b.road AND g.e > b.bs AND g.b < b.be WHERE abs(g.e - g.b) > 0""",
    }


for _tag, _args in {
    "la": {},
    "lf": {"sizes": "[5]", "where_road": "r.road = 'A2'", "years": (1996, 2000)},
    "lv": {"sizes": "[2]", "where_road": "r.road = 'A2'", "years": (1996, 1999), "severities": "'DOD', 'LET'"},
    "lt": {"sizes": "[5]", "direction": "T", "main": False},
    "ls": {"sizes": "[1, 2, 5, 10, 20]"},
}.items():
    CTES.update(live_ctes(_tag, **_args))


def with_ctes(sql: str, **instead: str) -> str:
    """Prefix a query with every expression it needs, in dependency order; `instead` replaces some."""
    needed: list[str] = []
    bodies = CTES | instead

    def visit(text: str) -> None:
        for name in bodies:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                visit(bodies[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    parts = ",\n".join(f"{n} AS ({bodies[n].strip()})" for n in needed)
    return f"WITH {parts}\n{sql.strip()}"


BIN_COLUMNS = ("bin_id, road_number, bin_size_km, bin_start_m, bin_end_m, length_m, accident_count, "
               "fatal_count, injury_count, year_span, " + rnd("density_per_km_year") + " AS density_per_km_year")

_GENERAL = """
CASE WHEN regexp_matches(t, '^(A|N|E)[0-9]+$')
      THEN substr(t, 1, 1) || regexp_replace(substr(t, 2), '^0+([0-9])', '\\1')
     WHEN regexp_matches(t, '^(RIJKSWEG|AUTOSNELWEG)[0-9]+$')
      THEN 'A' || regexp_replace(regexp_replace(t, '[^0-9]', '', 'g'), '^0+([0-9])', '\\1')
     ELSE nullif(t, '') END"""


def _general(raw: str) -> str:
    token = f"upper(regexp_replace({raw}, '\\s+', '', 'g'))"
    return _GENERAL.replace("(t,", f"({token},").replace("substr(t,", f"substr({token},").replace(
        "nullif(t,", f"nullif({token},")


_COMBINED = (f"coalesce({_general('road_number_raw')}, CASE WHEN letter <> '' AND number <> '' "
             f"THEN {_general('letter || number')} END)")


def _bare(x: str) -> str:
    return f"ltrim(regexp_replace({x}, '[^0-9]', '', 'g'), '0')"


TARGET = f"""(coalesce({_COMBINED} = 'A2', false)
 OR coalesce(upper(trim(road_number_raw)) IN ('A2', '002', '2', '02'), false)
 OR (coalesce(upper(trim(road_type_raw)) IN ('R', 'A'), false) AND
     {_bare("coalesce(nullif(road_number_raw, ''), nullif(number, ''), '')")} = '2')
 OR (coalesce(upper(trim(letter)) = 'A', false) AND
     {_bare("coalesce(nullif(number, ''), nullif(road_number_raw, ''), '')")} = '2'))"""

_ROADS_IN = ", ".join(f"'{r}'" for r in ROADS)
_BOX = (f"min({lon('x', 'y')}) AS a, min({lat('x', 'y')}) AS b, max({lon('x', 'y')}) AS c, max({lat('x', 'y')}) AS d")
CTES["box"] = f"""
SELECT r.road, {_BOX} FROM road r JOIN fx_vertices v ON v.fk_veld1 = r.fk
WHERE coalesce(r.carriageway, '') = 'HR' AND coalesce(r.direction, '') = 'H'
 AND EXISTS (SELECT 1 FROM iv WHERE iv.wegvak_id = r.wegvak_id) GROUP BY r.road"""
CTES["summary"] = f"""
SELECT t.road_number, coalesce(s.n, 0) AS segment_count, coalesce(a.n, 0) AS accident_count,
 {rnd('b.a')} AS xmin, {rnd('b.b')} AS ymin, {rnd('b.c')} AS xmax, {rnd('b.d')} AS ymax, 'implemented' AS status
FROM (SELECT unnest([{_ROADS_IN}]) AS road_number) t
LEFT JOIN (SELECT road, count(*) AS n FROM road GROUP BY road) s ON s.road = t.road_number
LEFT JOIN (SELECT road, count(*) AS n FROM acc_attr GROUP BY road) a ON a.road = t.road_number
LEFT JOIN box b ON b.road = t.road_number"""

_PERKM = """SELECT road AS road_number, CAST(floor(km) AS INTEGER) AS road_km, count(*) AS accident_count FROM {t}_km
 {where} GROUP BY ALL"""
_SUB = "lo < hi"
# pieces of the clips as edges: each edge part between the two cut measures
CTES["piece_ends"] = f"""
SELECT c.road, c.s, c.i, c.wegvak_id, c.b, c.lo, c.hi, c.fk, c.length_m FROM la_clip c WHERE {_SUB}"""
CTES["piece_nodes"] = """
SELECT p.road, p.s, p.i, p.wegvak_id, p.b, side, f, e.x1 + least((f * p.length_m - e.walked) / e.len, 1e0) * (e.x2 - e.x1) AS nx,
 e.y1 + least((f * p.length_m - e.walked) / e.len, 1e0) * (e.y2 - e.y1) AS ny
FROM (SELECT *, 0 AS side, lo AS f FROM piece_ends UNION ALL SELECT *, 1, hi FROM piece_ends) p
JOIN edges e ON e.fk = p.fk AND e.walked <= f * p.length_m
QUALIFY row_number() OVER (PARTITION BY p.road, p.s, p.i, p.wegvak_id, p.b, side ORDER BY e.seq DESC) = 1"""
CTES["joint"] = """
SELECT road, s, i, round(nx, 3) AS qx, round(ny, 3) AS qy, min(wegvak_id || '/' || b) AS l1, max(wegvak_id || '/' || b) AS l2
FROM piece_nodes GROUP BY ALL HAVING count(*) = 2 AND min(wegvak_id || '/' || b) <> max(wegvak_id || '/' || b)"""
CTES["ring"] = "SELECT road, s, i, l1, l2 FROM joint GROUP BY ALL HAVING count(*) = 2"
CTES["drawn"] = """
SELECT c.road, c.s, c.i, sum((hi - lo) * length_m) AS drawn_m, count(*) AS pieces FROM piece_ends c GROUP BY ALL"""
CTES["parts"] = """
SELECT d.*, d.pieces - coalesce(j.n, 0) + coalesce(r.n, 0) AS n_parts FROM drawn d
LEFT JOIN (SELECT road, s, i, count(*) AS n FROM joint GROUP BY ALL) j ON j.road = d.road AND j.s = d.s AND j.i = d.i
LEFT JOIN (SELECT road, s, i, count(*) AS n FROM ring GROUP BY ALL) r ON r.road = d.road AND r.s = d.s AND r.i = d.i"""
CTES["ranked"] = """
SELECT road_number, bin_size_km, density_per_km_year AS d, count(*) OVER w AS n,
 row_number() OVER (PARTITION BY road_number, bin_size_km ORDER BY density_per_km_year) AS k
FROM ls_drawn WINDOW w AS (PARTITION BY road_number, bin_size_km)"""
CTES["ls_flag"] = """
SELECT o.*, EXISTS (SELECT 1 FROM ls_clip c WHERE c.road = o.road_number AND c.s = o.bin_size_km AND c.i = o.i AND c.lo < c.hi) AS is_drawn
FROM ls_out o"""
CTES["ls_drawn"] = "SELECT * FROM ls_flag WHERE is_drawn"


def _pick(p: int) -> str:
    return f"max(CASE WHEN k = floor({p} / 100.0e0 * (n - 1) + 0.5) + 1 THEN d END)"


def _thr(v: str) -> str:
    return (f"CAST(CASE WHEN {v} <= 0 THEN 1 WHEN {v} < 10 THEN greatest(1, round({v})) "
            f"ELSE round({v} / 2) * 2 END AS BIGINT)")


CTES["pctl"] = f"""
SELECT road_number, bin_size_km, {_pick(25)} AS p25, {_pick(50)} AS p50, {_pick(75)} AS p75, {_pick(90)} AS p90
FROM ranked GROUP BY ALL"""
CTES["breaks"] = f"""
SELECT road_number, bin_size_km, {_thr('p25')} AS t1,
 greatest({_thr('p25')} + 1, {_thr('p50')}) AS t2,
 greatest(greatest({_thr('p25')} + 1, {_thr('p50')}) + 1, {_thr('p75')}) AS t3,
 greatest(greatest(greatest({_thr('p25')} + 1, {_thr('p50')}) + 1, {_thr('p75')}) + 1, {_thr('p90')}) AS t4 FROM pctl"""
CTES["hm0"] = """
SELECT road, wegvak_id, length_m, xa, ya, xz, yz, (coalesce(start_hm, end_hm, 0) + coalesce(end_hm, start_hm, 0)) / 2e0 AS mid
FROM drawn_any QUALIFY row_number() OVER (PARTITION BY road, floor((coalesce(start_hm, end_hm, 0) + coalesce(end_hm, start_hm, 0)) / 2e0 / 100)
  ORDER BY length_m DESC, wegvak_id) = 1"""
CTES["hm1"] = """
SELECT *, sum(length_m) OVER (PARTITION BY road ORDER BY mid, wegvak_id ROWS UNBOUNDED PRECEDING) AS ce,
 sqrt(pow(lead(xa) OVER w - xz, 2) + pow(lead(ya) OVER w - yz, 2)) AS jump
FROM hm0 WINDOW w AS (PARTITION BY road ORDER BY mid, wegvak_id)"""
CTES["clip_c"] = """
SELECT b.road, b.s, b.i, c.wegvak_id, greatest(0e0, (b.bs - c.cs) / c.length_m) AS lo,
 least(1e0, (b.be - c.cs) / c.length_m) AS hi, c.length_m
FROM cbin b JOIN chain c ON c.road = b.road AND c.ce > b.bs AND c.cs < b.be WHERE c.length_m > 0"""


def _stat(key: str, label: str | None = None) -> str:
    expr = f"coalesce({key}, '{label}')" if label else key
    return (f"SELECT road AS road_number_norm, {expr} AS {key}, count(*) AS accident_count "
            "FROM acc_attr WHERE road IS NOT NULL GROUP BY ALL")


ORACLES: dict[str, str] = {
    "roads_norm_attrs": """
SELECT wegvak_id, road_number_raw, road_type_raw, road AS road_number_norm, direction, carriageway, start_hm, end_hm,
 road = 'A2' AS is_target_a2 FROM road_attr""",
    "road_number_general": f"SELECT wegvak_id, {_COMBINED.replace('letter', 'letter')} AS road_number_norm FROM seg_attr",
    "target_flag": f"SELECT wegvak_id, {TARGET} AS is_target FROM seg_attr",
    "orient_measures": "SELECT wegvak_id, start_hm, end_hm FROM road_attr",
    "accidents_staging": """
SELECT accident_id, accident_year, accident_date, accident_hour, severity, accident_type, wegvak_id, point_id, hm,
 fatal_count, injury_count FROM stg""",
    "accidents_norm_attrs": """
SELECT accident_id, accident_year, severity, road_number_raw, road AS road_number_norm, wegvak_id, point_id, hm,
 location_quality, is_target AS is_target_a2 FROM acc_attr""",
    "accidents_norm": f"""
SELECT accident_id, {rnd('gx', 4)} AS x, {rnd('gy', 4)} AS y, {rnd(lon('gx', 'gy'))} AS lon, {rnd(lat('gx', 'gy'))} AS lat,
 location_quality FROM acc""",
    "accidents_direct_xy": f"""
SELECT accident_id, location_quality, {rnd('x', 4)} AS x, {rnd('y', 4)} AS y FROM (
 SELECT accident_id, ok, CASE WHEN ok THEN 'direct_xy' ELSE location_quality END AS location_quality,
  CASE WHEN ok THEN xd ELSE gx END AS x, CASE WHEN ok THEN yd ELSE gy END AS y
 FROM (SELECT *, coalesce(xd BETWEEN 10000 AND 280000 AND yd BETWEEN 300000 AND 620000, false) AS ok FROM acc))""",
    "points_dedupe": "SELECT point_id, wegvak_id, hm, x AS x_rd, y AS y_rd FROM pt_one",
    "best_point": f"SELECT point_id, wegvak_id, hm, {rnd('px', 4)} AS x, {rnd('py', 4)} AS y FROM pt",
    "road_points_norm": f"""
SELECT point_id, wegvak_id, road_number_raw, road AS road_number_norm, hm, coalesce(road = 'A2', false) AS is_target_a2,
 {rnd('px', 4)} AS x, {rnd('py', 4)} AS y, {rnd(lon('px', 'py'))} AS lon, {rnd(lat('px', 'py'))} AS lat FROM pt""",
    "roads_norm": f"""
SELECT wegvak_id, road AS road_number_norm, {rnd('length_m', 4)} AS length_m, {rnd(lon('xa', 'ya'))} AS lon_start,
 {rnd(lat('xa', 'ya'))} AS lat_start, {rnd(lon('xz', 'yz'))} AS lon_end, {rnd(lat('xz', 'yz'))} AS lat_end FROM road""",
    "line_length": f"SELECT fk AS fk_veld1, {rnd('total')} AS length_m FROM line",
    "line_centroid": f"SELECT fk AS fk_veld1, {rnd('cx')} AS cx, {rnd('cy')} AS cy FROM line",
    "line_envelope": """
SELECT fk_veld1, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM fx_vertices GROUP BY fk_veld1""",
    "line_interpolate": f"""
SELECT l.fk AS fk_veld1, f AS fraction,
 {rnd('e.x1 + least((f * l.total - e.walked) / e.len, 1e0) * (e.x2 - e.x1)', 4)} AS x,
 {rnd('e.y1 + least((f * l.total - e.walked) / e.len, 1e0) * (e.y2 - e.y1)', 4)} AS y
FROM line l CROSS JOIN (SELECT unnest([0e0, 0.25e0, 0.5e0, 0.9e0, 1e0]) AS f) JOIN edges e ON e.fk = l.fk AND e.walked <= f * l.total
QUALIFY row_number() OVER (PARTITION BY l.fk, f ORDER BY e.seq DESC) = 1""",
    "line_locate": f"""
SELECT fk AS fk_veld1, {rnd('(walked + t * len) / total')} AS fraction, {rnd('d')} AS dist FROM (
 SELECT *, sqrt(pow(x1 + t * (x2 - x1) - px, 2) + pow(y1 + t * (y2 - y1) - py, 2)) AS d FROM (
  SELECT e.*, l.total, l.cx + 37 AS px, l.cy - 11 AS py,
   greatest(0e0, least(1e0, ((l.cx + 37 - x1) * (x2 - x1) + (l.cy - 11 - y1) * (y2 - y1)) / (len * len))) AS t
  FROM edges e JOIN line l ON l.fk = e.fk))
QUALIFY row_number() OVER (PARTITION BY fk ORDER BY d, seq) = 1""",
    "line_substring": f"""
SELECT l.fk AS fk_veld1, {rnd('0.55e0 * l.total', 4)} AS length_m, CAST(2 + count(*) FILTER (
  e.walked > 0.2e0 * l.total AND e.walked < 0.75e0 * l.total) AS INTEGER) AS vertices
FROM line l JOIN edges e ON e.fk = l.fk GROUP BY l.fk, l.total""",
    "line_shape": """
SELECT fk AS fk_veld1, 'LineString' AS geometry_type, true AS valid, xa AS x_start, ya AS y_start, xz AS x_end, yz AS y_end
FROM line""",
    "rd_to_wgs84_round_trip": f"""
SELECT fk_veld1, seq, {rnd(lon('x', 'y'), 7)} AS lon, {rnd(lat('x', 'y'), 7)} AS lat,
 {rnd(rd_x(lon('x', 'y'), lat('x', 'y')), 2)} AS x_back, {rnd(rd_y(lon('x', 'y'), lat('x', 'y')), 2)} AS y_back FROM fx_vertices""",
    "line_geojson": f"""
SELECT v.fk_veld1, CAST(v.seq AS INTEGER) AS seq, 'LineString' AS type, {rnd('x', 4)} AS x, {rnd('y', 4)} AS y FROM fx_vertices v""",
    # ---- live bins
    "road_bins_flagship": f"SELECT {BIN_COLUMNS} FROM lf_out",
    "road_bins_all": f"SELECT {BIN_COLUMNS} FROM la_out",
    "road_bins_filtered": f"SELECT {BIN_COLUMNS} FROM lv_out",
    "road_bins_direction": f"SELECT {BIN_COLUMNS} FROM lt_out",
    "road_bins_sizes": f"SELECT {BIN_COLUMNS} FROM ls_out",
    "km_extent": "SELECT road AS road_number, lo AS km_min, hi AS km_max FROM la_ext",
    "bin_defs": """
SELECT road AS road_number, CAST(s AS INTEGER) AS bin_size_km, i AS bin_idx, bs AS bin_start, be AS bin_end FROM ls_bin""",
    "bins_clip": f"""
SELECT road AS road_number, i AS bin_idx, wegvak_id, {rnd('b', 4)} AS beg_km, {rnd('(hi - lo) * length_m', 4)} AS clip_m
FROM piece_ends""",
    "bins_geometry": f"""
SELECT o.bin_id, CASE WHEN p.road IS NULL THEN 'empty' ELSE 'hectometer_km' END AS geometry_quality,
 {rnd('p.drawn_m', 3)} AS drawn_m, CAST(p.n_parts AS INTEGER) AS n_parts
FROM la_out o LEFT JOIN parts p ON p.road = o.road_number AND p.s = o.bin_size_km AND p.i = o.i""",
    "bins_geojson": """
SELECT o.bin_id, CASE WHEN p.n_parts = 1 THEN 'LineString' ELSE 'MultiLineString' END AS geometry_type,
 o.accident_count, 'Feature' AS type
FROM la_out o JOIN parts p ON p.road = o.road_number AND p.s = o.bin_size_km AND p.i = o.i""",
    "bins_summary": """
SELECT o.road_number, count(p.road) AS feature_count, CAST(sum(o.accident_count) AS BIGINT) AS accident_count
FROM la_out o LEFT JOIN parts p ON p.road = o.road_number AND p.s = o.bin_size_km AND p.i = o.i GROUP BY o.road_number""",
    "bin_health": """
SELECT o.road_number, o.bin_size_km, count(*) AS bins, count(*) FILTER (p.n_parts > 1) AS multi_part,
 count(*) FILTER (p.road IS NULL) AS empty,
 count(*) FILTER (p.road IS NULL OR o.length_m <= 0 OR p.drawn_m < 0.5 * o.length_m) AS thin,
 min(o.bin_start_m) / 1000 AS km_from, max(o.bin_end_m) / 1000 AS km_to, CAST(sum(o.accident_count) AS BIGINT) AS accidents
FROM la_out o LEFT JOIN parts p ON p.road = o.road_number AND p.s = o.bin_size_km AND p.i = o.i GROUP BY ALL""",
    "bin_ribbon_counts": f"""
SELECT o.bin_id, {rnd('greatest(coalesce(o.density_per_km_year, 0) * 1000, 0)', 3)} AS extrusion_height_m,
 CAST(p.n_parts AS BIGINT) AS n_ribbons, CAST(p.n_parts AS BIGINT) AS n_closed
FROM la_out o JOIN parts p ON p.road = o.road_number AND p.s = o.bin_size_km AND p.i = o.i""",
    "segment_ribbons": f"""
SELECT fk_veld1, CAST(pos AS INTEGER) AS pos, {rnd(lon('x', 'y'), 7)} AS lon, {rnd(lat('x', 'y'), 7)} AS lat FROM ribbon_ring""",
    "scored_accidents": "SELECT accident_id, road AS road_number_norm, km AS road_km FROM la_km",
    "accidents_per_km": _PERKM.format(t="la", where="WHERE km IS NOT NULL"),
    "corridor_per_km": _PERKM.format(t="la", where="WHERE km BETWEEN 15 AND 45"),
    "tail_km": "SELECT * FROM (" + _PERKM.format(t="lf", where="") + ") ORDER BY road_km DESC NULLS LAST LIMIT 5",
    "head_km": "SELECT * FROM (" + _PERKM.format(t="lf", where="WHERE km IS NOT NULL") + ") ORDER BY road_km LIMIT 8",
    "year_span": """
SELECT road AS road_number, CAST(greatest(max(accident_year) - min(accident_year) + 1, 1) AS INTEGER) AS year_span
FROM acc_attr WHERE road IS NOT NULL GROUP BY road""",
    # ---- listings and summaries
    "road_accidents": f"""
SELECT a.accident_id, a.accident_year, a.severity, a.location_quality, a.road AS road_number_norm,
 {rnd(lon('gx', 'gy'))} AS lon, {rnd(lat('gx', 'gy'))} AS lat
FROM acc a JOIN road r ON r.wegvak_id = a.wegvak_id AND r.road = a.road
WHERE a.road = 'A2' AND a.gx IS NOT NULL AND coalesce(r.carriageway, '') = 'HR'""",
    "road_meta": """
SELECT coalesce(a.road, r.road) AS road_number_norm, coalesce(a.n, 0) AS road_accident_count, coalesce(a.u, 0) AS road_unresolved_count,
 a.lo AS year_from, a.hi AS year_to, a.sv AS severities, coalesce(r.n, 0) AS road_segment_count,
 coalesce(r.h, 0) AS road_mainroad_segment_count, (SELECT count(*) FROM fx_accidents) AS total_accident_count
FROM (SELECT road, count(*) AS n, count(*) FILTER (location_quality = 'unresolved') AS u, min(accident_year) AS lo,
   max(accident_year) AS hi, string_agg(DISTINCT severity, ',' ORDER BY severity) AS sv FROM acc_attr WHERE road IS NOT NULL GROUP BY road) a
FULL JOIN (SELECT road, count(*) AS n, count(*) FILTER (coalesce(carriageway, '') = 'HR') AS h FROM road
   WHERE road IS NOT NULL GROUP BY road) r ON r.road = a.road""",
    "roads_summary": "SELECT * FROM summary",
    "road_search": "SELECT * FROM summary UNION ALL SELECT 'N231', 0, 0, NULL, NULL, NULL, NULL, 'not_implemented_yet'",
    "stats_by_year": _stat("accident_year"),
    "stats_by_severity": _stat("severity"),
    "stats_by_quality": _stat("location_quality"),
    "severity_labelled": _stat("severity", "(null)"),
    "severities": "SELECT DISTINCT road AS road_number_norm, severity FROM acc_attr WHERE road IS NOT NULL AND severity IS NOT NULL",
    "road_totals": """
SELECT count(*) AS total_accidents, count(*) FILTER (location_quality = 'unresolved') AS unresolved_accidents
FROM acc_attr WHERE road = 'A2'""",
    "casualties": """
SELECT a.road AS road_number_norm, CAST(sum(s.fatal_count) AS BIGINT) AS deaths, CAST(sum(s.injury_count) AS BIGINT) AS injuries
FROM acc_attr a LEFT JOIN stg s ON s.accident_id = a.accident_id WHERE a.road IS NOT NULL GROUP BY a.road""",
    # ---- chains
    "road_axis": f"""
SELECT road AS road_number, {rnd('mx', 4)} AS min_x, {rnd('my', 4)} AS min_y, {rnd('dx / al')} AS ux, {rnd('dy / al')} AS uy FROM axis_h""",
    "segment_chain": f"""
SELECT road AS road_number, wegvak_id, seg_ord, {rnd('length_m', 4)} AS seg_len_m, {rnd('cs', 4)} AS chain_start_m,
 {rnd('ce', 4)} AS chain_end_m FROM chain""",
    "ordered_segments": f"SELECT road AS road_number, wegvak_id, seg_ord, {rnd('cs', 4)} AS chain_start_m FROM chain",
    "chain_total": f"SELECT road AS road_number, {rnd('total', 4)} AS total_length_m FROM total",
    "wegvak_canonical": "SELECT road AS road_number, wegvak_id, canonical AS canonical_wegvak_id FROM canon",
    "successor_gaps": f"""
SELECT a.road AS road_number, a.seg_ord, {rnd('sqrt(pow(b.xa - a.xz, 2) + pow(b.ya - a.yz, 2))', 4)} AS jump_m
FROM chain a JOIN chain b ON b.road = a.road AND b.seg_ord = a.seg_ord + 1
WHERE sqrt(pow(b.xa - a.xz, 2) + pow(b.ya - a.yz, 2)) > 100""",
    "nearest_segment": f"""
SELECT road AS road_number, {rnd('gx', 4)} AS x, {rnd('gy', 4)} AS y, seg_ord, {rnd('d', 4)} AS dist FROM near""",
    "accident_chainage": f"""
SELECT road AS road_number, accident_id, accident_year, severity, wegvak_id, {rnd('chain_m', 3)} AS chain_m FROM chainage""",
    "chain_bins": f"""
SELECT b.road || '_' || b.s || 'km_' || lpad(CAST(b.i AS VARCHAR), 5, '0') AS bin_id, b.road AS road_number,
 CAST(b.s AS INTEGER) AS bin_size_km, {rnd('b.bs', 4)} AS bin_start_m, {rnd('b.be', 4)} AS bin_end_m, {rnd('b.be - b.bs', 4)} AS length_m,
 CASE WHEN EXISTS (SELECT 1 FROM clip_c c WHERE c.road = b.road AND c.s = b.s AND c.i = b.i AND c.lo < c.hi)
   THEN 'linesubstring' ELSE 'empty' END AS geometry_quality FROM cbin b""",
    "chain_clips": f"""
SELECT road AS road_number, CAST(s AS INTEGER) AS bin_size_km, i AS bin_idx, wegvak_id, {rnd('(hi - lo) * length_m', 3)} AS clip_m
FROM clip_c WHERE lo < hi""",
    "empty_bins": """
SELECT b.road AS road_number, CAST(b.s AS INTEGER) AS bin_size_km, b.i AS bin_idx FROM cbin b WHERE NOT EXISTS (
 SELECT 1 FROM clip_c c WHERE c.road = b.road AND c.s = b.s AND c.i = b.i AND c.lo < c.hi)""",
    "chain_bin_cube": """
SELECT road || '_' || s || 'km_' || lpad(CAST(i AS VARCHAR), 5, '0') AS bin_id, road AS road_number, CAST(s AS INTEGER) AS bin_size_km,
 accident_year, severity, n AS accident_count, f AS fatal_count, j AS injury_count FROM cube""",
    "top_bins": f"""
SELECT road AS road_number, road || '_1km_' || lpad(CAST(i AS VARCHAR), 5, '0') AS bin_id, 1 AS bin_size_km,
 {rnd('bs', 4)} AS bin_start_m, {rnd('be', 4)} AS bin_end_m, CAST(n AS BIGINT) AS accident_count FROM (
 SELECT b.road, b.i, b.bs, b.be, sum(c.n) AS n FROM cbin b LEFT JOIN cube c ON c.road = b.road AND c.s = b.s AND c.i = b.i
 WHERE b.s = 1 GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY road ORDER BY n DESC NULLS LAST, bs) <= 10""",
    # ---- measures over bins
    "bin_kpis": f"""
SELECT road_number, bin_size_km, CAST(sum(accident_count) AS BIGINT) AS total_accidents,
 {rnd('coalesce(avg(density_per_km_year) FILTER (is_drawn), 0)')} AS mean_density,
 count(*) FILTER (is_drawn) AS bin_count, {rnd('max(density_per_km_year) FILTER (is_drawn)')} AS peak_density,
 min(bin_start_m) FILTER (is_drawn AND density_per_km_year = top) AS peak_start_m
FROM (SELECT *, max(CASE WHEN is_drawn THEN density_per_km_year END) OVER (PARTITION BY road_number, bin_size_km) AS top FROM ls_flag) GROUP BY ALL""",
    "density_breaks": "SELECT * FROM breaks",
    "density_classes": """
SELECT o.bin_id, CASE WHEN d <= 0 THEN 0 WHEN d >= t4 THEN 5 WHEN d >= t3 THEN 4 WHEN d >= t2 THEN 3 WHEN d >= t1 THEN 2 ELSE 1 END AS density_class
FROM (SELECT *, density_per_km_year AS d FROM ls_drawn) o JOIN breaks b ON b.road_number = o.road_number AND b.bin_size_km = o.bin_size_km""",
    "class_table": """
SELECT road_number, bin_size_km, c AS class, CASE c WHEN 0 THEN '0' WHEN 1 THEN '< ' || t1 WHEN 2 THEN t1 || '–' || t2
 WHEN 3 THEN t2 || '–' || t3 WHEN 4 THEN t3 || '–' || t4 ELSE t4 || '+' END AS label,
 ['#e8e8e8', '#fee5d9', '#fcbba1', '#fc9272', '#fb6a4a', '#a50f15'][c + 1] AS colour
FROM breaks CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5]) AS c)""",
    "bar_heights": f"""
SELECT bin_id, {rnd('greatest(d / greatest(max(d) OVER w, 1) * 100, CASE WHEN d > 0 THEN 4 ELSE 0 END)')} AS height_density,
 {rnd('greatest(n / greatest(max(n) OVER w, 1) * 100, CASE WHEN n > 0 THEN 4 ELSE 0 END)')} AS height_count
FROM (SELECT *, density_per_km_year AS d, accident_count * 1e0 AS n FROM ls_out)
WINDOW w AS (PARTITION BY road_number, bin_size_km)""",
    "drawn_flags": "SELECT bin_id, is_drawn FROM ls_flag",
    "selection_overlap": "SELECT bin_id FROM ls_drawn WHERE bin_start_m < 13000 AND bin_end_m > 12000",
    "selection_bbox": f"""
SELECT o.road_number, {rnd('min(' + lon('x', 'y') + ')')} AS xmin, {rnd('min(' + lat('x', 'y') + ')')} AS ymin,
 {rnd('max(' + lon('x', 'y') + ')')} AS xmax, {rnd('max(' + lat('x', 'y') + ')')} AS ymax
FROM (SELECT * FROM la_out WHERE bin_start_m < 13000 AND bin_end_m > 12000) o JOIN (
 SELECT road, i, nx AS x, ny AS y FROM piece_nodes
 UNION ALL SELECT p.road, p.i, e.x1, e.y1 FROM piece_ends p JOIN edges e ON e.fk = p.fk
   AND e.walked > p.lo * p.length_m AND e.walked < p.hi * p.length_m) v ON v.road = o.road_number AND v.i = o.i
GROUP BY o.road_number""",
    "density_repair": f"""
SELECT bin_id, {rnd('CASE i % 4 WHEN 0 THEN density_per_km_year WHEN 1 THEN density_per_km_year * year_span / greatest(year_span, 1) WHEN 2 THEN CASE WHEN length_m > 0 THEN accident_count / (length_m / 1000.0) / greatest(year_span, 1) ELSE 0 END ELSE CASE WHEN length_m > 0 THEN accident_count / (length_m / 1000.0) ELSE 0 END END')} AS density_per_km_year,
 CASE WHEN i % 4 = 3 THEN 1 ELSE year_span END AS year_span FROM ls_out""",
    "bin_enrich": f"""
SELECT bin_id, {rnd('accident_count / CASE WHEN i % 3 = 0 AND length_m > 0 THEN length_m / 1000.0 WHEN i % 3 <= 1 AND bin_end_m > bin_start_m THEN (bin_end_m - bin_start_m) / 1000.0 ELSE bin_size_km END / CASE WHEN i % 2 = 0 THEN year_span ELSE 10 END')} AS density_per_km_year,
 CASE WHEN i % 2 = 0 THEN year_span ELSE 10 END * 1e0 AS year_span FROM ls_out""",
    "delimited_scan": "SELECT " + ", ".join(f"coalesce({c}, '') AS {c}" for c in (
        "vkl_nummer jaar_vkl datum_vkl uur ap3_code aol_id wvk_id fk_veld5 hectometer antl_dod antl_gzh "
        "x_direct y_direct").split()) + " FROM fx_accidents",
    # ---- profile and validation
    "value_frequencies": """
SELECT col AS "column", v AS value, n AS rows FROM frequency QUALIFY row_number() OVER (PARTITION BY col ORDER BY n DESC, v) <= 5""",
    "road_candidates": f"""
SELECT "column", value, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT col AS "column", trim(v) AS value, n FROM frequency WHERE trim(v) <> '')
WHERE regexp_matches(value, '(?i)a\\s*2|002|^2$|rijksweg\\s*2|autosnelweg\\s*2|a2')
 OR {_general('value')} = 'A2' OR upper(value) IN ('A2', '002', '2', '02') GROUP BY ALL""",
    "candidate_summary": """
SELECT string_agg(DISTINCT col, ',' ORDER BY col) AS candidate_columns,
 CAST(coalesce(sum(n) FILTER (col = 'wegnr_hmp' AND trim(v) = 'A2'), 0) AS BIGINT) AS key_rows,
 coalesce(sum(n) FILTER (col = 'wegnr_hmp' AND trim(v) = 'A2'), 0) > 0 AS reliable,
 CASE WHEN coalesce(sum(n) FILTER (col = 'wegnr_hmp' AND trim(v) = 'A2'), 0) > 0 THEN 'WEGNR_HMP = ''A2''' ELSE 'manual mapping required' END AS recommended_key
FROM frequency WHERE regexp_matches(trim(v), '(?i)a\\s*2|002|^2$|rijksweg\\s*2|autosnelweg\\s*2|a2')
 OR upper(trim(v)) IN ('A2', '002', '2', '02')""",
    "profile_columns": " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count(*) AS rows, count(nullif({c}, '')) AS filled_rows, count(DISTINCT nullif({c}, '')) AS distinct_values,
 {f"'{h}'" if h else 'NULL::VARCHAR'} AS hint FROM fx_accidents""" for c, h in {
        "vkl_nummer": "likely_id", "jaar_vkl": "likely_year_date", "datum_vkl": "likely_year_date", "uur": None,
        "ap3_code": "likely_id", "aol_id": "likely_id", "wvk_id": "likely_id", "fk_veld5": "likely_id",
        "hectometer": None, "antl_dod": None, "antl_gzh": None, "x_direct": None, "y_direct": None}.items()),
    "geometry_types": """
SELECT CASE WHEN length_m IS NULL THEN NULL ELSE 'LineString' END AS geometry_type, count(*) AS rows FROM road GROUP BY ALL""",
    "column_fill": """
SELECT road AS road_number_norm, count(*) AS rows, count(start_hm) AS start_hm_filled, min(start_hm) AS start_hm_min, max(start_hm) AS start_hm_max,
 count(end_hm) AS end_hm_filled, min(end_hm) AS end_hm_min, max(end_hm) AS end_hm_max
FROM road WHERE coalesce(carriageway, '') = 'HR' GROUP BY road""",
    "uncovered_km": """
SELECT road AS road_number, km FROM (
 SELECT road, unnest(generate_series(CAST(floor(min(b)) AS BIGINT), CAST(ceil(max(e)) AS BIGINT))) AS km FROM (
  SELECT r.road, iv.b, iv.e FROM road r JOIN iv ON iv.wegvak_id = r.wegvak_id WHERE r.road IS NOT NULL
   AND coalesce(r.carriageway, '') = 'HR' AND coalesce(r.direction, '') = 'H') GROUP BY road) m
WHERE NOT EXISTS (SELECT 1 FROM road r JOIN iv ON iv.wegvak_id = r.wegvak_id WHERE r.road = m.road
   AND coalesce(r.carriageway, '') = 'HR' AND coalesce(r.direction, '') = 'H' AND iv.b <= m.km AND iv.e > m.km)""",
    "hm_chain_gaps": """
SELECT road AS road_number, count(*) AS segments, round(max(ce) / 1000, 1) AS chain_km, count(*) FILTER (jump > 100) AS gaps,
 round(max(jump) FILTER (jump > 100), 0) AS max_jump_m FROM hm1 GROUP BY road""",
    "validation_checks": f"""
SELECT name, {rnd('value', 5)} AS value, ok FROM (
 SELECT 'raw_accidents' AS name, count(*) * 1e0 AS value, true AS ok FROM fx_accidents
 UNION ALL SELECT 'normalized_accidents', count(*) * 1e0, count(*) = (SELECT count(*) FROM fx_accidents) FROM acc_attr
 UNION ALL SELECT 'accidents', count(*) * 1e0, true FROM acc_attr WHERE road = 'A2'
 UNION ALL SELECT 'unresolved', count(*) * 1e0, true FROM acc_attr WHERE road = 'A2' AND location_quality = 'unresolved'
 UNION ALL SELECT 'unresolved_pct', 100e0 * count(*) FILTER (location_quality = 'unresolved') / greatest(count(*), 1), true FROM acc_attr WHERE road = 'A2'
 UNION ALL SELECT 'segments', count(*) * 1e0, count(*) > 0 FROM road WHERE road = 'A2'
 UNION ALL SELECT 'segments_without_geometry', count(*) * 1e0, true FROM road WHERE road = 'A2' AND length_m IS NULL
 UNION ALL SELECT n, v, n LIKE 'rd%' OR (CASE WHEN n LIKE 'lon%' THEN lon_ok ELSE lat_ok END) FROM (
  SELECT unnest(['lon_min', 'lat_min', 'lon_max', 'lat_max', 'rd_x_min', 'rd_y_min', 'rd_x_max', 'rd_y_max']) AS n,
   unnest([a, b, c, d, p, q, r, s]) AS v, a BETWEEN 3 AND 8 AND c BETWEEN 3 AND 8 AS lon_ok, b BETWEEN 50 AND 54 AND d BETWEEN 50 AND 54 AS lat_ok
  FROM (SELECT {_BOX}, min(x) AS p, min(y) AS q, max(x) AS r, max(y) AS s FROM road w JOIN fx_vertices v ON v.fk_veld1 = w.fk WHERE w.road = 'A2'))
 UNION ALL SELECT 'year_' || accident_year, count(*) * 1e0, true FROM acc_attr WHERE road = 'A2' GROUP BY accident_year
 UNION ALL SELECT 'severity_' || coalesce(severity, '(null)'), count(*) * 1e0, true FROM acc_attr WHERE road = 'A2' GROUP BY severity
 UNION ALL SELECT 'quality_' || location_quality, count(*) * 1e0, true FROM acc_attr WHERE road = 'A2' GROUP BY location_quality)""",
    "serving_export_rows": f"""
SELECT 'roads_norm' AS "table", count(*) AS rows FROM road WHERE road IN ({_ROADS_IN})
UNION ALL SELECT 'accidents_norm', count(*) FROM acc_attr WHERE road IN ({_ROADS_IN})
UNION ALL SELECT 'raw_nwb_hectointervallen', count(*) FROM iv JOIN road r ON r.wegvak_id = iv.wegvak_id WHERE r.road IN ({_ROADS_IN})
UNION ALL SELECT 'accidents_staging', count(*) FROM stg s JOIN acc_attr a ON a.accident_id = s.accident_id WHERE a.road IN ({_ROADS_IN})""",
    "raw_archive_counts": """
SELECT 'raw_bron_accidents' AS "table", count(*) AS rows FROM fx_accidents
UNION ALL SELECT 'raw_nwb_hectointervallen', count(*) FROM fx_hectointervallen
UNION ALL SELECT 'raw_nwb_hectopunten', count(*) FROM fx_hectopunten
UNION ALL SELECT 'raw_nwb_puntlocaties', count(*) FROM fx_puntlocaties
UNION ALL SELECT 'raw_nwb_wegvakken', count(*) FROM fx_wegvakken
UNION ALL SELECT 'accidents_staging', count(*) FROM stg
UNION ALL SELECT 'road_points_norm', count(*) FROM pt_one""",
}


def _digest(table: str, source: str, columns: list[str]) -> str:
    text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in columns)
    return f"""
SELECT '{table}' AS "table", count(*) AS rows, CAST(coalesce(sum(b % 1073741824), 0) AS BIGINT) AS hash_sum,
 CAST(coalesce(bit_xor(b), 0) AS BIGINT) AS hash_xor
FROM (SELECT CAST(('0x' || substr(md5(concat_ws('|', {text})), 1, 15)) AS BIGINT) AS b FROM {source})"""


_RAW_COLUMNS = {
    "raw_nwb_wegvakken": ("fx_wegvakken", "bst_code fk_veld1 klok_beg klok_end rijrichtng routeltr routenr wegbehsrt wegnr_hmp wegnummer wvk_id"),
    "raw_nwb_puntlocaties": ("fx_puntlocaties", "fk_veld5 x_coord y_coord"),
    "raw_nwb_hectopunten": ("fx_hectopunten", "fk_veld5 hectometer wvk_id"),
    "raw_nwb_hectointervallen": ("fx_hectointervallen", "begkm endkm wvk_id"),
    "raw_bron_accidents": ("fx_accidents", "antl_dod antl_gzh aol_id ap3_code datum_vkl fk_veld5 hectometer jaar_vkl uur vkl_nummer "
                           "wvk_id x_direct y_direct"),
}
ORACLES |= {
    "bins_request": f"SELECT {BIN_COLUMNS} FROM lf_out",
    "road_top_bins": f"SELECT * FROM ({ORACLES['top_bins']}) WHERE road_number = 'A2'",
    "validation_report": ORACLES["validation_checks"] + f"""
UNION ALL SELECT 'bins_1km', count(*) * 1e0, true FROM cbin WHERE road = 'A2' AND s = 1
UNION ALL SELECT 'invalid_bin_geometries', count(*) * 1e0, true FROM ({ORACLES['empty_bins']}) WHERE road_number = 'A2'
UNION ALL SELECT 'top_' || bin_id, coalesce(accident_count, 0) * 1e0, true FROM ({ORACLES['top_bins']}) WHERE road_number = 'A2'""",
    "target_roads": "SELECT wegvak_id, road_number_raw FROM road_attr WHERE road = 'A2'",
    "bars_in_order": """
SELECT bin_id, accident_count FROM ls_drawn WHERE road_number = 'A2' AND bin_size_km = 5
ORDER BY accident_count DESC, bin_start_m LIMIT 10""",
    "first_bins": "SELECT bin_id, bin_start_m FROM la_out ORDER BY road_number, bin_size_km, bin_start_m LIMIT 25",
    "points_with_road": """
SELECT carriageway, count(*) AS points FROM fx_hectopunten h JOIN seg_attr s ON s.wegvak_id = h.wvk_id GROUP BY carriageway""",
    "reattached_years": """
SELECT road AS road_number, i AS bin_idx, accident_year, CAST(sum(n) AS BIGINT) AS accident_count FROM cube WHERE s = 5 GROUP BY ALL""",
    "ragged_scan": """
SELECT vkl_nummer AS column0, CASE WHEN k % 7 <> 1 THEN jaar_vkl END AS column1,
 CASE WHEN k % 7 = 0 THEN vkl_nummer || ';' || jaar_vkl || ';extra;;x' END AS surplus
FROM (SELECT *, CAST(vkl_nummer AS BIGINT) AS k FROM fx_accidents)""",
    "ingest_job": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", count(*) AS rows, false AS served FROM {source}" for t, (source, _) in _RAW_COLUMNS.items()),
    "raw_archive_contents": " UNION ALL ".join(_digest(t, source, names.split()) for t, (source, names) in _RAW_COLUMNS.items()),
    "serving_export_contents": " UNION ALL ".join([
        _digest("roads_norm", f"road WHERE road IN ({_ROADS_IN})", ["wegvak_id", "road", "direction", "carriageway"]),
        _digest("accidents_norm", f"acc_attr WHERE road IN ({_ROADS_IN})",
                ["accident_id", "accident_year", "severity", "road", "wegvak_id", "point_id", "location_quality"]),
        _digest("raw_nwb_hectointervallen", f"fx_hectointervallen v JOIN road r ON r.wegvak_id = v.wvk_id WHERE r.road IN ({_ROADS_IN})",
                ["v.wvk_id", "v.begkm", "v.endkm"]),
        _digest("accidents_staging", f"stg s JOIN acc_attr a ON a.accident_id = s.accident_id WHERE a.road IN ({_ROADS_IN})",
                ["s.accident_id", "s.fatal_count", "s.injury_count"])]),
}

#: Queries over lines of which some have two parts, by the query that they repeat or with an own text.
MULTIPART = {
    "multipart_roads": f"""
SELECT wegvak_id, road AS road_number_norm, {rnd('length_m', 4)} AS length_m,
 CAST(CASE WHEN length_m IS NULL THEN NULL WHEN {IS_SPLIT.format(fk='CAST(fk AS BIGINT)')} THEN 2 ELSE 1 END AS INTEGER) AS n_parts,
 CASE WHEN length_m IS NULL THEN NULL WHEN {IS_SPLIT.format(fk='CAST(fk AS BIGINT)')} THEN 'MultiLineString' ELSE 'LineString' END AS geojson_type,
 {rnd('xa', 4)} AS x_start, {rnd('ya', 4)} AS y_start, {rnd('xz', 4)} AS x_end, {rnd('yz', 4)} AS y_end FROM road""",
    "multipart_accidents": "accidents_norm",
    "multipart_points": "best_point",
    "multipart_clips": f"""
SELECT p.road AS road_number, p.i AS bin_idx, p.wegvak_id, {rnd('p.b', 4)} AS beg_km, {rnd('(p.hi - p.lo) * p.length_m', 4)} AS clip_m,
 CAST(1 + count(e.seq) AS BIGINT) AS pieces
FROM piece_ends p LEFT JOIN edges e ON e.fk = p.fk AND {IS_SPLIT.format(fk='CAST(p.fk AS BIGINT)')} AND e.seq = 2
 AND p.lo * p.length_m < e.walked AND e.walked < p.hi * p.length_m
GROUP BY p.road, p.i, p.wegvak_id, p.b, p.lo, p.hi, p.length_m""",
    "multipart_chain": "segment_chain",
    "multipart_chainage": "accident_chainage",
    "multipart_gaps": "successor_gaps",
    "multipart_types": f"""
SELECT CASE WHEN length_m IS NULL THEN NULL WHEN {IS_SPLIT.format(fk='CAST(fk AS BIGINT)')} THEN 'MultiLineString' ELSE 'LineString' END AS geometry_type,
 count(*) AS rows FROM road GROUP BY ALL""",
    "multipart_boxes": "roads_summary",
}
_SPLIT_VERTICES = """
SELECT fk AS fk_veld1, x1 AS x, y1 AS y FROM edges UNION ALL SELECT fk, x2, y2 FROM edges"""


def oracle_sql() -> dict[str, str]:
    out = {name: with_ctes(sql) for name, sql in ORACLES.items()}
    box = CTES["box"].replace("fx_vertices", "split_vertices")
    for name, sql in MULTIPART.items():
        out[name] = with_ctes(ORACLES.get(sql, sql), edges0=split_edges(), split_vertices=_SPLIT_VERTICES, box=box)
    return out
