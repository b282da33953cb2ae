"""Geometry as SQL expression text over nested columns.

A point is struct<x, y>, a line array<point>. Every function takes expression text (a column
name, or any expression) and returns expression text, so that a whole formula is parsed once
by Spark instead of being put together call by call. `geometry` wraps these as Columns.

Names that start with an underscore are lambda variables; arguments must not use such names.
A line of several parts is array<line>; functions named `parts_...` measure along the parts in
their order, and the gaps between them have no length. `parts_of` puts both kinds into one.
Values needed in every step of a fold are carried in its state: a lambda that named an outer
expression would evaluate it again for each vertex.
"""

from __future__ import annotations

from roadlines.functions import projection as pr

POINT_TYPE = "struct<x:double,y:double>"
LINE_TYPE = f"array<{POINT_TYPE}>"
MULTILINE_TYPE = f"array<{LINE_TYPE}>"


def point(x: str, y: str) -> str:
    return f"named_struct('x', {x}, 'y', {y})"


def start(g: str) -> str:
    return f"get({g}, 0)"


def end(g: str) -> str:
    return f"get({g}, size({g}) - 1)"


def hypotenuse(dx: str, dy: str) -> str:
    return f"sqrt(({dx}) * ({dx}) + ({dy}) * ({dy}))"


def gap(a: str, b: str) -> str:
    """Distance between two points."""
    return hypotenuse(f"({b}).x - ({a}).x", f"({b}).y - ({a}).y")


def edges(g: str) -> str:
    """Consecutive vertex pairs with their length."""
    n = f"greatest(size({g}) - 1, 0)"
    return (f"zip_with(slice({g}, 1, {n}), slice({g}, 2, {n}), (_a, _b) -> named_struct("
            f"'x1', _a.x, 'y1', _a.y, 'x2', _b.x, 'y2', _b.y, 'len', {gap('_a', '_b')}))")


def let(value: str, name: str, body: str) -> str:
    """`body` of a lambda variable `name` that is bound to a value computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def parts_of(line: str, parts: str | None = None) -> str:
    """Parts of a geometry given as a line, or, where that is NULL, as parts."""
    rest = f" ELSE {parts}" if parts else ""
    return f"CASE WHEN {line} IS NOT NULL THEN array({line}){rest} END"


def parts_edges(parts: str) -> str:
    """Edges of all parts in order, none between one part and the next."""
    return f"flatten(transform({parts}, _p -> {edges('_p')}))"


def parts_start(parts: str) -> str:
    return start(start(parts))


def parts_end(parts: str) -> str:
    return end(end(parts))


def length(g: str) -> str:
    return f"aggregate({edges(g)}, 0D, (_t, _e) -> _t + _e.len)"


def parts_length(parts: str) -> str:
    return f"aggregate({parts}, 0D, (_sum, _g) -> _sum + {length('_g')})"


def running(values: str) -> str:
    """Inclusive running sums of an array of numbers.

    Sums over 1, 2, 4, ... places are added up, log2(n) passes over the array: appending to an
    array in a fold would copy it for each element.
    """
    shifted = "concat(array_repeat(0D, shiftleft(1, _k)), slice(_s, 1, greatest(size(_s) - shiftleft(1, _k), 0)))"
    doubled = (f"aggregate(sequence(0, cast(ceil(log2(size(_x))) AS int) - 1), _x, (_s, _k) -> "
               f"zip_with(_s, {shifted}, (_u, _w) -> _u + _w))")
    return let(values, "_x", f"CASE WHEN size(_x) < 2 THEN _x ELSE {doubled} END")


def interpolate(g: str, fraction: str) -> str:
    """Point at a fraction of the length; the caller clamps the fraction to 0..1."""
    share = "CASE WHEN _e.len > 0 THEN least((_s.goal - _s.at) / _e.len, 1D) ELSE 0D END"
    walk = (
        f"aggregate({edges(g)}, named_struct('goal', {length(g)} * {fraction}, 'at', 0D, "
        f"'x', ({start(g)}).x, 'y', ({start(g)}).y), (_s, _e) -> named_struct("
        "'goal', _s.goal, 'at', _s.at + _e.len, "
        f"'x', CASE WHEN _s.goal >= _s.at THEN _e.x1 + {share} * (_e.x2 - _e.x1) ELSE _s.x END, "
        f"'y', CASE WHEN _s.goal >= _s.at THEN _e.y1 + {share} * (_e.y2 - _e.y1) ELSE _s.y END), "
        "_s -> named_struct('x', _s.x, 'y', _s.y))")
    return (f"CASE WHEN {g} IS NULL OR {fraction} IS NULL THEN NULL WHEN {fraction} <= 0 THEN {start(g)} "
            f"WHEN {fraction} >= 1 THEN {end(g)} ELSE {walk} END")


def _measured(edge_list: str) -> str:
    before = f"slice(concat(array(0D), {running('transform(_m, _e -> _e.len)')}), 1, size(_m))"
    kept = "named_struct('x1', _e.x1, 'y1', _e.y1, 'x2', _e.x2, 'y2', _e.y2, 'len', _e.len, 'at', _at)"
    return let(edge_list, "_m", f"zip_with(_m, {before}, (_e, _at) -> {kept})")


def measured(g: str) -> str:
    """Edges with the length walked before them (`at`); worth keeping where many points are
    interpolated on one line."""
    return _measured(edges(g))


def parts_measured(parts: str) -> str:
    """Edges of all parts with the length walked before them."""
    return _measured(parts_edges(parts))


def on_measured(m: str, total: str, fraction: str) -> str:
    """Point at a fraction of a measured line, from the last edge that starts before it."""
    goal = f"{total} * {fraction}"
    t = f"CASE WHEN _e.len > 0 THEN least(({goal} - _e.at) / _e.len, 1D) ELSE 0D END"
    first, last = f"get({m}, 0)", f"get({m}, size({m}) - 1)"
    # the chosen edge is bound to a lambda variable, so that it is looked up once
    spot = point(f"_e.x1 + {t} * (_e.x2 - _e.x1)", f"_e.y1 + {t} * (_e.y2 - _e.y1)")
    between = f"get(transform(slice(filter({m}, _e -> _e.at <= {goal}), -1, 1), _e -> {spot}), 0)"
    return (f"CASE WHEN size({m}) > 0 AND {fraction} <= 0 THEN {point(f'({first}).x1', f'({first}).y1')} "
            f"WHEN size({m}) > 0 AND {fraction} >= 1 THEN {point(f'({last}).x2', f'({last}).y2')} "
            f"WHEN size({m}) > 0 AND {fraction} IS NOT NULL THEN {between} END")


def parts_interpolate(parts: str, fraction: str) -> str:
    """Point at a fraction of the length of all parts; where two parts meet, the start of the later one."""
    total = "get(_m, size(_m) - 1).at + get(_m, size(_m) - 1).len"
    return let(parts_measured(parts), "_m", on_measured("_m", f"({total})", fraction))


def closest(g: str, p: str) -> str:
    """struct(dist, along, total): distance to the line, measure of the foot point, line length.

    A line of one vertex has no edges; its distance is that to the vertex.
    """
    return _closest(edges(g), g, start(g), p)


def parts_closest(parts: str, p: str) -> str:
    """The same along all parts."""
    return _closest(parts_edges(parts), f"flatten({parts})", parts_start(parts), p)


def _closest(edge_list: str, vertices: str, first: str, p: str) -> str:
    # foot parameter per edge, then its distance, then the fold over the edges
    dot = f"(({p}).x - _e.x1) * (_e.x2 - _e.x1) + (({p}).y - _e.y1) * (_e.y2 - _e.y1)"
    square = "(_e.x2 - _e.x1) * (_e.x2 - _e.x1) + (_e.y2 - _e.y1) * (_e.y2 - _e.y1)"
    feet = (
        f"transform({edge_list}, _e -> named_struct('e', _e, 't', CASE WHEN _e.len > 0 "
        f"THEN least(greatest(({dot}) / ({square}), 0D), 1D) ELSE 0D END))")
    dx = f"CASE WHEN _f.t >= 1 THEN _f.e.x2 ELSE _f.e.x1 + _f.t * (_f.e.x2 - _f.e.x1) END - ({p}).x"
    dy = f"CASE WHEN _f.t >= 1 THEN _f.e.y2 ELSE _f.e.y1 + _f.t * (_f.e.y2 - _f.e.y1) END - ({p}).y"
    away = (
        f"transform({feet}, _f -> named_struct('dx', {dx}, 'dy', {dy}, 'on', _f.t * _f.e.len, "
        "'len', _f.e.len))")
    legs = (
        f"transform({away}, _o -> named_struct('d', {hypotenuse('_o.dx', '_o.dy')}, 'on', _o.on, "
        "'len', _o.len))")
    fold = (
        f"aggregate({legs}, named_struct('dist', double('infinity'), 'along', 0D, 'total', 0D), "
        "(_s, _l) -> named_struct('dist', least(_s.dist, _l.d), "
        "'along', CASE WHEN _l.d < _s.dist THEN _s.total + _l.on ELSE _s.along END, "
        "'total', _s.total + _l.len))")
    lone = f"named_struct('dist', {gap(first, p)}, 'along', 0D, 'total', 0D)"
    return (f"CASE WHEN {vertices} IS NULL OR {p} IS NULL THEN NULL WHEN size({vertices}) = 1 THEN {lone} "
            f"ELSE {fold} END")


def substring(g: str, lo: str, hi: str) -> str:
    """Line between two fractions of its length; NULL when the span is empty or reversed."""
    total = "get({m}, size({m}) - 1).at + get({m}, size({m}) - 1).len"
    walked = let(measured(g), "_m", f"named_struct('m', _m, 'n', {total.format(m='_m')}, 'lo', {lo}, 'hi', {hi})")
    inner = "_e.at + _e.len > _w.n * _w.lo AND _e.at + _e.len < _w.n * _w.hi"
    kept = f"transform(filter(_w.m, _e -> {inner}), _e -> {point('_e.x2', '_e.y2')})"
    ends = [f"array({on_measured('_w.m', '_w.n', f'_w.{k}')})" for k in ("lo", "hi")]
    return (
        f"CASE WHEN {g} IS NULL OR {lo} IS NULL OR {hi} IS NULL OR {lo} >= {hi} THEN NULL "
        f"WHEN {lo} <= 0 AND {hi} >= 1 THEN {g} "
        f"ELSE {let(walked, '_w', f'concat({ends[0]}, {kept}, {ends[1]})')} END")


def parts_substring(parts: str, lo: str, hi: str) -> str:
    """Parts between two fractions of the length of all parts; parts outside are left out, NULL when none is left."""
    sized = f"transform({parts}, _g -> named_struct('g', _g, 'len', {length('_g')}))"
    bound = let(
        sized, "_o", f"named_struct('o', _o, 'at', {running('transform(_o, _e -> _e.len)')}, 'lo', {lo}, 'hi', {hi}, "
        "'n', aggregate(_o, 0D, (_t, _e) -> _t + _e.len))")
    local = (
        "zip_with(_c.o, _c.at, (_e, _at) -> named_struct('g', _e.g, "
        "'lo', greatest((_c.n * _c.lo - (_at - _e.len)) / nullif(_e.len, 0D), 0D), "
        "'hi', least((_c.n * _c.hi - (_at - _e.len)) / nullif(_e.len, 0D), 1D)))")
    pieces = f"filter(transform({local}, _q -> {substring('_q.g', '_q.lo', '_q.hi')}), _g -> _g IS NOT NULL)"
    some = let(let(bound, "_c", pieces), "_z", "CASE WHEN size(_z) > 0 THEN _z END")
    return (f"CASE WHEN {parts} IS NULL OR {lo} IS NULL OR {hi} IS NULL OR {lo} >= {hi} THEN NULL "
            f"WHEN {lo} <= 0 AND {hi} >= 1 THEN {parts} ELSE {some} END")


def centroid(g: str) -> str:
    """Edge midpoints weighted by edge length; the first vertex for a line without length."""
    return _centroid(edges(g), start(g))


def parts_centroid(parts: str) -> str:
    return _centroid(parts_edges(parts), parts_start(parts))


def _centroid(edge_list: str, first: str) -> str:
    return (
        f"aggregate({edge_list}, named_struct('x', 0D, 'y', 0D, 'len', 0D, 'x0', ({first}).x, 'y0', ({first}).y), "
        "(_s, _e) -> named_struct('x', _s.x + _e.len * (_e.x1 + _e.x2) / 2D, "
        "'y', _s.y + _e.len * (_e.y1 + _e.y2) / 2D, 'len', _s.len + _e.len, 'x0', _s.x0, 'y0', _s.y0), "
        "_s -> CASE WHEN _s.len > 0 THEN named_struct('x', _s.x / _s.len, 'y', _s.y / _s.len) "
        "ELSE named_struct('x', _s.x0, 'y', _s.y0) END)")


def envelope(g: str) -> str:
    xs, ys = "transform(_g, _v -> _v.x)", "transform(_g, _v -> _v.y)"
    box = (f"CASE WHEN _g IS NOT NULL THEN named_struct('xmin', array_min({xs}), 'ymin', array_min({ys}), "
           f"'xmax', array_max({xs}), 'ymax', array_max({ys})) END")
    return let(g, "_g", box)


def finite(v: str) -> str:
    return f"({v} IS NOT NULL AND NOT isnan({v}) AND abs({v}) < double('infinity'))"


def is_valid(g: str) -> str:
    """Finite coordinates and at least two distinct vertices."""
    return (f"(forall({g}, _v -> {finite('_v.x')} AND {finite('_v.y')}) "
            f"AND size(array_distinct({g})) >= 2)")


def _nested(factors: dict[int, str], x: str) -> str:
    total = "0D"
    for power in range(max(factors), -1, -1):
        total = f"({total} * {x} + {factors.get(power, '0D')})"
    return total


def _polynomial(terms: tuple[tuple[int, int, float], ...], u: str, v: str) -> str:
    """Sum of the terms, nested by powers so that each power is multiplied once."""
    by_power: dict[int, dict[int, str]] = {}
    for p, q, factor in terms:
        by_power.setdefault(p, {})[q] = f"({factor!r}D)"
    return _nested({p: _nested(inner, v) for p, inner in by_power.items()}, u)


def _rd_offsets(x: str, y: str) -> tuple[str, str]:
    return f"(({x} - {pr.RD_ORIGIN[0]}D) * 1e-5D)", f"(({y} - {pr.RD_ORIGIN[1]}D) * 1e-5D)"


def _degrees(dx: str, dy: str) -> str:
    lon = f"{pr.WGS_ORIGIN[1]!r}D + {_polynomial(pr.LON_TERMS, dx, dy)} / 3600D"
    lat = f"{pr.WGS_ORIGIN[0]!r}D + {_polynomial(pr.LAT_TERMS, dx, dy)} / 3600D"
    return point(lon, lat)


def rd_point_to_wgs84(x: str, y: str) -> str:
    """struct(x = longitude, y = latitude); NULL in, NULL out."""
    return f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {_degrees(*_rd_offsets(x, y))} END"


def wgs84_point_to_rd(lon: str, lat: str) -> str:
    dlat = f"(({lat} - {pr.WGS_ORIGIN[0]!r}D) * 0.36D)"
    dlon = f"(({lon} - {pr.WGS_ORIGIN[1]!r}D) * 0.36D)"
    x = f"{pr.RD_ORIGIN[0]}D + {_polynomial(pr.X_TERMS, dlat, dlon)}"
    y = f"{pr.RD_ORIGIN[1]}D + {_polynomial(pr.Y_TERMS, dlat, dlon)}"
    return f"CASE WHEN {lon} IS NOT NULL AND {lat} IS NOT NULL THEN {point(x, y)} END"


def rd_to_wgs84(g: str) -> str:
    # the offsets are bound: the polynomials name them some eighty times
    offsets = f"transform({g}, _v -> {point(*_rd_offsets('_v.x', '_v.y'))})"
    return f"transform({offsets}, _o -> CASE WHEN _o.x IS NOT NULL AND _o.y IS NOT NULL THEN {_degrees('_o.x', '_o.y')} END)"


def wgs84_to_rd(g: str) -> str:
    return f"transform({g}, _v -> {wgs84_point_to_rd('_v.x', '_v.y')})"


def parts_to_wgs84(parts: str) -> str:
    return f"transform({parts}, _g -> {rd_to_wgs84('_g')})"


def as_geojson(g: str, kind: str = "line") -> str:
    """GeoJSON text of a point, a line, or line parts (one part gives a LineString)."""
    def body(label: str, coordinates: str) -> str:
        return f"to_json(named_struct('type', '{label}', 'coordinates', {coordinates}))"

    def pairs(line: str) -> str:
        return f"transform({line}, _v -> array(_v.x, _v.y))"

    if kind == "point":
        text = body("Point", f"array(({g}).x, ({g}).y)")
    elif kind == "line":
        text = body("LineString", pairs(g))
    else:
        text = (f"CASE WHEN size({g}) = 1 THEN {body('LineString', pairs(start(g)))} "
                f"ELSE {body('MultiLineString', f'transform({g}, _p -> ' + pairs('_p') + ')')} END")
    return f"CASE WHEN {g} IS NOT NULL THEN {text} END"


def from_geojson_line(text: str) -> str:
    """Line parts of LineString or MultiLineString text, NULL for anything else."""
    kind, body = f"get_json_object({text}, '$.type')", f"get_json_object({text}, '$.coordinates')"

    def line(pairs: str) -> str:
        return f"transform({pairs}, _c -> {point('get(_c, 0)', 'get(_c, 1)')})"

    one = f"from_json({body}, 'array<array<double>>')"
    many = f"from_json({body}, 'array<array<array<double>>>')"
    return (f"CASE {kind} WHEN 'LineString' THEN array({line(one)}) "
            f"WHEN 'MultiLineString' THEN transform({many}, _l -> {line('_l')}) END")


def geometry_type(g: str, kind: str = "line") -> str:
    label = {"point": "'Point'", "line": "'LineString'",
             "parts": f"CASE WHEN size({g}) = 1 THEN 'LineString' ELSE 'MultiLineString' END"}[kind]
    return f"CASE WHEN {g} IS NOT NULL THEN {label} END"


def ribbon(g: str, half_width: float) -> str:
    """Ring around an RD line: left side, right side back, closed; vertices move along the mean
    normal of the adjoining edges."""
    # the line, its normals and its sides are bound: each is computed once for a line
    n = "greatest(size(_l) - 1, 0)"
    before, after = f"concat(slice(_l, 1, 1), slice(_l, 1, {n}))", f"concat(slice(_l, 2, {n}), slice(_l, -1, 1))"
    normal = let(f"nullif({gap('_b', '_a')}, 0D)", "_span", point(
        "coalesce((_b.y - _a.y) / _span, 0D)", "coalesce((_a.x - _b.x) / _span, 0D)"))
    normals = f"zip_with({before}, {after}, (_b, _a) -> {normal})"

    def side(width: float) -> str:
        moved = point(f"_v.x + ({width}D) * _u.x", f"_v.y + ({width}D) * _u.y")
        return f"zip_with(_l, _n, (_v, _u) -> {moved})"

    sides = let(normals, "_n", f"named_struct('left', {side(half_width)}, 'right', {side(-half_width)})")
    ring = let(sides, "_w", "concat(_w.left, reverse(_w.right), slice(_w.left, 1, 1))")
    return let(g, "_l", ring)
