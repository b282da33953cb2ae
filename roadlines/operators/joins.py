"""Joins with a spatial or interval condition, and the small relational ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from roadlines.functions import geometry as geo
from roadlines.functions import shapes as sh
from roadlines.session import cut

FACTOR = 4
SALTS = 16


NULL_SALTS = 1024


def lookup_join(df: DataFrame, lookup: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Left join to a table with unique keys, with the rows that have no key spread out.

    A shuffle would send all NULL keys to one task. They match nothing, so a second key, salted
    on the rows without a key and constant otherwise, scatters them without a change in result.
    Hot keys that do match are split by adaptive execution, which a left join allows.
    """
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(NULL_SALTS)) + 1
                  ).otherwise(0).cast("int")
    # always zero, but nothing that the optimizer could fold: of a constant it would make a filter and
    # join by the key alone, all rows without one in one task
    salted = lookup.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(1)).cast("int"))
    return df.withColumn("_salt", salt).join(salted, [key, "_salt"], "left").drop("_salt")


def with_group_row(df: DataFrame, per_group: DataFrame, by: Sequence[str] = ("road_number",),
                   salts: int = SALTS) -> DataFrame:
    """Inner join to a table with few rows per group (a grid, an axis), with hot groups spread out.

    Rows of `df` get a salt from all their plain columns, and the small side is repeated for each
    salt, so that a group that holds most rows fills `salts` tasks at least. Nothing downstream can
    reuse an exchange by the group alone: aggregates by group and bin sum up in the map tasks
    first. While the repeated side is small, Spark's own size check broadcasts it instead.
    """
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, AtomicType)]
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    repeated = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*by, "_salt"], "inner").drop("_salt")


def using(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return a.join(b, key, "inner")


def semi(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return a.join(b, key, "left_semi")


def anti(a: DataFrame, b: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return a.join(b, key, "left_anti")


def segment_intervals(roads: DataFrame, intervals: DataFrame) -> DataFrame:
    """Segments with their km intervals (inner; several rows per segment)."""
    return roads.join(intervals, "wegvak_id", "inner")


def join_coalesced(accidents: DataFrame, mapping: DataFrame, chain: DataFrame) -> DataFrame:
    """Left join to the chain by the canonical segment, or the own segment without one."""
    mapped = accidents.join(mapping, ["road_number", "wegvak_id"], "left")
    keyed = mapped.withColumn("_seg", F.coalesce("canonical_wegvak_id", "wegvak_id"))
    lookup = chain.withColumnRenamed("wegvak_id", "_seg")
    return keyed.join(lookup, ["road_number", "_seg"], "left")


def reattach_accidents(binned: DataFrame, accidents: DataFrame,
                       columns: Sequence[str] = ("accident_year", "severity")) -> DataFrame:
    """Fetch accident columns by id for binned rows that do not carry them."""
    return binned.join(accidents.select("accident_id", *columns), "accident_id", "inner")


def cross_one(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a frame with exactly one row, as scalar subqueries (no join)."""
    single = one_row.agg(*[F.first(c).alias(c) for c in one_row.columns])
    return df.select("*", *[single.select(c).scalar().alias(c) for c in single.columns])


def successor_gaps(chain: DataFrame, min_jump: float = 100.0) -> DataFrame:
    """Chain positions whose line ends more than `min_jump` metres before the next one starts.

    Joined on the successor's position: ranks are unique, so this stays an even equi-join.
    """
    following = chain.select("road_number", (F.col("seg_ord") - 1).alias("seg_ord"),
                             geo.parts_start(geo.parts_of(chain)).alias("next"))
    jumps = chain.join(following, ["road_number", "seg_ord"]).select(
        "road_number", "seg_ord", geo.gap(sh.parts_end(geo.parts_of(chain)), "next").alias("jump_m"))
    return jumps.where(F.col("jump_m") > min_jump)


def covered_km(intervals: DataFrame) -> DataFrame:
    """Integer km marks m with beg <= m < end for some interval, per road.

    Each interval yields the marks inside it; the distinct set is bounded by the road's extent.
    """
    lo = F.ceil("beg_km").cast("long")
    hi = (F.ceil("end_km") - 1).cast("long")
    return (intervals.where(lo <= hi)
            .select("road_number", F.explode(F.sequence(lo, hi)).alias("km"))
            .distinct())


def _box_distance(box: str) -> Column:
    """Distance from (x, y) to a box; zero inside."""
    dx = f"greatest({box}.xmin - x, x - {box}.xmax, 0D)"
    dy = f"greatest({box}.ymin - y, y - {box}.ymax, 0D)"
    return F.expr(sh.hypotenuse(dx, dy))


def _corner(lines: DataFrame) -> tuple[float, float, float]:
    """Lowest first vertex and the larger side of the box of all first vertices (one row)."""
    b = lines.agg(F.min("home.x").alias("x0"), F.max("home.x").alias("x1"),
                  F.min("home.y").alias("y0"), F.max("home.y").alias("y1")).first()
    if b["x0"] is None:
        return 0.0, 0.0, 0.0
    return b["x0"], b["y0"], max(b["x1"] - b["x0"], b["y1"] - b["y0"])


def _tree(lines: DataFrame, by: Sequence[str], top: int) -> DataFrame:
    """Nodes of all levels over the lines' home cells: box of their lines and one of their
    vertices. A node of level k covers FACTOR x FACTOR nodes of level k - 1."""
    leaves = lines.groupBy(*by, "cx", "cy").agg(
        F.min("box.xmin").alias("xmin"), F.min("box.ymin").alias("ymin"),
        F.max("box.xmax").alias("xmax"), F.max("box.ymax").alias("ymax"), F.min("home").alias("v"))
    level = F.explode(F.sequence(F.lit(0), F.lit(max(top - 1, 0))))
    width = F.pow(F.lit(FACTOR), F.col("level"))
    return (
        leaves.withColumn("level", level)
        .withColumns({c: F.floor(F.col(c) / width).cast("long") for c in ("cx", "cy")})
        .groupBy(*by, "level", "cx", "cy").agg(
            F.struct(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"),
                     F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax")).alias("box"),
            F.min("v").alias("v")))


def nearest_join(points: DataFrame, lines: DataFrame, by: Sequence[str], cell: float = 250.0,
                 tie: str = "seg_ord", carry: Sequence[str] = ()) -> DataFrame:
    """Nearest line for each distinct point, exactly, without comparing all pairs.

    points: `by`, x, y. lines: `by`, geom, `tie` (unique per group, lower wins), `carry`.
    Result: `by`, x, y, dist, along, total, `tie`, `carry`.

    Equal points are handled once; of equal lines only the one that wins ties is kept. Lines
    have a home cell (that of their first vertex), cells form a tree. All points walk down the
    tree together, one equi-join per level: a vertex of every child bounds a point's distance
    from above, the child's box from below, and children beyond the bound are dropped. A far
    point therefore keeps a few cells per level, as a near one does. The number of levels
    depends on the extent only. Coarse levels have few nodes, asked for by many points, so
    those joins are salted.
    """
    by = list(by)
    unique = cut(
        lines.where(F.size("geom") >= 1)
        # lines are equal if both hashes are: the key stays small, lines are never compared to be sorted
        .groupBy(*by, F.xxhash64("geom").alias("_h1"), F.xxhash64(F.lit(1), "geom").alias("_h2"))
        .agg(F.min(F.struct(tie, *carry)).alias("p"), F.first("geom").alias("geom"))
        .select(*by, "geom", f"p.{tie}", *[f"p.{c}" for c in carry],
                geo.start("geom").alias("home"), geo.envelope("geom").alias("box")))
    x0, y0, side = _corner(unique)
    top = 0
    while cell * FACTOR ** top <= side:
        top += 1
    homed = unique.withColumns({
        "cx": F.floor((F.col("home.x") - x0) / cell).cast("long"),
        "cy": F.floor((F.col("home.y") - y0) / cell).cast("long")})
    nodes = cut(_tree(homed, by, top))

    zero = F.lit(0).cast("long")
    near = (
        points.select(*by, "x", "y").where(F.col("x").isNotNull() & F.col("y").isNotNull()).distinct()
        .withColumns({"cx": zero, "cy": zero, "bound": F.lit(float("inf"))}))
    mine = Window.partitionBy(*by, "x", "y")
    for level in range(top - 1, -1, -1):
        salts = SALTS if level else 1
        children = nodes.where(F.col("level") == level).select(
            *by, F.floor(F.col("cx") / FACTOR).cast("long").alias("px"),
            F.floor(F.col("cy") / FACTOR).cast("long").alias("py"),
            F.col("cx").alias("kx"), F.col("cy").alias("ky"), "box", "v",
            F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        asked = near.select(
            *by, "x", "y", F.col("cx").alias("px"), F.col("cy").alias("py"), "bound",
            F.pmod(F.xxhash64("x", "y"), F.lit(salts)).cast("int").alias("salt"))
        met = asked.join(children, [*by, "px", "py", "salt"]).select(
            *by, "x", "y", "kx", "ky", "bound", _box_distance("box").alias("away"),
            geo.gap(sh.point("x", "y"), "v").alias("reach"))
        # a little slack, so that rounding cannot drop the line the bound comes from
        known = met.withColumn("bound", F.least(
            "bound", F.min(F.col("reach") * (1 + 1e-9) + 1e-6).over(mine)))
        near = known.where(F.col("away") <= F.col("bound")).select(
            *by, "x", "y", F.col("kx").alias("cx"), F.col("ky").alias("cy"), "bound")
    pairs = near.join(homed, [*by, "cx", "cy"]).where(_box_distance("box") <= F.col("bound"))
    return nearest_pick(pairs, by, tie, carry)


def nearest_pick(pairs: DataFrame, by: Sequence[str], tie: str, carry: Sequence[str]) -> DataFrame:
    """Lowest (distance, tie) per point; partly aggregated before its shuffle."""
    measured = pairs.select(
        *by, "x", "y", tie, *carry,
        geo.closest("geom", sh.point("x", "y")).alias("c"))
    names = ["dist", tie, "along", "total", *carry]
    best = F.min(F.struct(F.col("c.dist").alias("dist"), F.col(tie),
                          F.col("c.along").alias("along"), F.col("c.total").alias("total"), *carry))
    return measured.groupBy(*by, "x", "y").agg(best.alias("b")).select(
        *by, "x", "y", *[f"b.{n}" for n in names])


def nearest_brute(points: DataFrame, lines: DataFrame, by: Sequence[str], tie: str = "seg_ord",
                  carry: Sequence[str] = ()) -> DataFrame:
    """All pairs of a group; a test twin of nearest_join for small fixtures."""
    pairs = points.select(*by, "x", "y").distinct().join(lines, list(by))
    return nearest_pick(pairs, list(by), tie, carry)
