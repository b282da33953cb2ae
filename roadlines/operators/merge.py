"""Merging of lines at shared endpoints, distributed over rows.

Two line ends are linked when exactly these two ends meet in a node. The links form paths and
rings of lines. Each line is walked in both directions, so a directed walk state is
(line, direction); pointers are followed per round until every state knows the end of its path
and its distance to it. A pointer target is shared by no two unfinished states, so no round
has a hot key, and a chain of n lines takes about log4(n) rounds, each written once.
No bin is ever gathered in one task; only the finished parts are put together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlines.functions import geometry as geo
from roadlines.session import cut

FOLLOWED = 3  # pointers that a written round follows: each round makes walks four times as long


def _exit_node(forward: Column) -> Column:
    return F.when(forward, geo.end("geom")).otherwise(geo.start("geom"))


def _entry_node(forward: Column) -> Column:
    return F.when(forward, geo.start("geom")).otherwise(geo.end("geom"))


def _links(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """src state -> dst state for every pair of line ends alone in a node, both ways.

    State 2*line walks the line forward (enters at end 0), 2*line + 1 backward.
    """
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), geo.start("geom").alias("node")),
                             F.struct(F.lit(1).alias("side"), geo.end("geom").alias("node"))))
    ends = lines.select(*keys, "line", side.alias("e")).select(*keys, "line", "e.side", "e.node")
    pair = F.struct("line", "side")
    nodes = ends.groupBy(*keys, "node").agg(
        F.count(F.lit(1)).alias("n"), F.min(pair).alias("a"), F.max(pair).alias("b"))
    joints = nodes.where((F.col("n") == 2) & (F.col("a.line") != F.col("b.line")))
    both = F.explode(F.array(F.struct(F.col("a").alias("out"), F.col("b").alias("into")),
                             F.struct(F.col("b").alias("out"), F.col("a").alias("into"))))
    # leaving through end 1 is walking forward, entering through end 0 is walking forward
    return joints.select(both.alias("l")).select(
        (F.col("l.out.line") * 2 + (1 - F.col("l.out.side"))).alias("src"),
        (F.col("l.into.line") * 2 + F.col("l.into.side")).alias("dst"))


def _follow(states: DataFrame, ahead: DataFrame) -> DataFrame:
    """States moved on by the pointers of `ahead`, each by as many steps as its pointer has.

    States that are done have a key of their own below zero, so none of them meet at one end.
    """
    key = F.when(F.col("active"), F.col("ptr")).otherwise(-1 - F.col("state"))
    met = F.least("low", F.struct(F.col("_low.state").alias("state"), (F.col("hops") + F.col("_low.at")).alias("at")))
    on = F.col("_active").isNotNull()
    return states.withColumn("_key", key).join(ahead, "_key", "left").select(
        "state", F.coalesce("_ptr", "ptr").alias("ptr"),
        (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
        F.when(on, met).otherwise(F.col("low")).alias("low"), F.coalesce("_active", "active").alias("active"))


def _walk(links: DataFrame) -> DataFrame:
    """Pointer jumping: (state, last, hops), where `last` names the directed walk of the state.

    A written round follows the pointers of the round before FOLLOWED times, so a path of n lines
    takes log(n) rounds to the base of FOLLOWED + 1. States that reached their end are written once,
    in that round, and are only looked up afterwards.

    `low` is the lowest state met within `hops` steps and the steps to it; a state that meets itself
    as the lowest lies on a ring. A ring needs no second walk: opened at end 0 of its lowest line, the
    way that enters there begins with `low` and the other ends with it, so the steps to `low` give the
    place of each state.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    starts = links.select(F.col("src").alias("state"), F.col("dst").alias("ptr"), one.alias("hops"),
                          F.struct(F.col("dst").alias("state"), one.alias("at")).alias("low"),
                          F.lit(True).alias("active"))
    ends = (links.select(F.col("dst").alias("state"))
            .join(links.select(F.col("src").alias("state")), "state", "left_anti")
            .select("state", F.col("state").alias("ptr"), zero.alias("hops"),
                    F.struct("state", zero.alias("at")).alias("low"), F.lit(False).alias("active")))
    table = cut(starts.unionByName(ends))
    done, rings = [], None
    while True:
        done.append(table.where(~F.col("active")))
        left = table.where("active")
        mine = F.col("state") == F.col("low.state")
        status = left.agg(F.count(F.lit(1)).alias("open"), F.count_if(mine).alias("rings")).first()
        if not status["open"]:
            break
        if status["rings"]:
            lows = left.where(mine).select(F.col("state").alias("_low"))
            if left.join(lows, F.col("low.state") == F.col("_low"), "left_semi").count() == status["open"]:
                rings = left
                break
        ahead = reduce(DataFrame.unionByName, done, left).select(
            F.col("state").alias("_key"), F.col("ptr").alias("_ptr"), F.col("hops").alias("_hops"),
            F.col("low").alias("_low"), F.col("active").alias("_active"))
        moved = left
        for _ in range(FOLLOWED):
            moved = _follow(moved, ahead)
        table = cut(moved)
    walked = reduce(DataFrame.unionByName, done).select("state", F.col("ptr").alias("last"), "hops")
    if rings is None:
        return walked
    low, at = F.col("low.state"), F.col("low.at")
    hops = F.when(low % 2 == 0, at - 1).when(low == F.col("state"), zero).otherwise(at)
    return walked.unionByName(rings.select("state", low.bitwiseXOR(one).alias("last"), hops.alias("hops")))


def merge_lines(df: DataFrame, keys: Sequence[str], geom: str = "geom") -> DataFrame:
    """Merge the lines of each key group at nodes of degree two; one row per resulting part.

    Undirected: a part runs the way most of its lines do (ties: from the lower endpoint).
    Lines without two distinct vertices are left out. A ring is opened at its lowest line.
    """
    keys = list(keys)
    g = F.col("geom")
    ready = df.select(*keys, F.col(geom).alias("geom")).where(geo.is_valid("geom"))
    lines = cut(ready.withColumn("line", F.monotonically_increasing_id()))
    links = cut(_links(lines, keys))
    if links.isEmpty():
        return lines.select(*keys, "geom")
    walked = _walk(links)
    states = walked.select(F.floor(F.col("state") / 2).cast("long").alias("line"),
                           (F.col("state") % 2 == 0).alias("forward"), "last", "hops")
    pairs = states.groupBy("line").agg(F.min("last").alias("part"))
    tied = states.join(pairs, "line").join(lines, "line")
    # each part has two directed walks; score both and keep one
    scored = tied.groupBy("part", "last").agg(
        F.count_if("forward").alias("ahead"),
        F.max_by(_entry_node(F.col("forward")), "hops").alias("head"))
    choice = scored.groupBy("part").agg(
        F.min_by("last", F.struct(-F.col("ahead"), "head", "last")).alias("last"))
    oriented = (
        tied.join(choice, ["part", "last"])
        .withColumn("run", F.when(F.col("forward"), g).otherwise(F.reverse(g))))
    # the array is one finished line: its size is that of the result row itself
    ordered = oriented.groupBy(*keys, "part").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("hops")).alias("at"), "run"))).alias("runs"))
    joined = F.flatten(F.transform(
        F.col("runs"),
        lambda r, i: F.when(i == 0, r["run"]).otherwise(F.slice(r["run"], 2, F.size(r["run"])))))
    merged = ordered.select(*keys, joined.alias("geom"))
    alone = lines.join(pairs, "line", "left_anti").select(*keys, "geom")
    return alone.unionByName(merged)


def collect_lines(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of a key group in one row (`geom_parts`), as a drawn feature needs them."""
    return parts.groupBy(*keys).agg(F.array_sort(F.collect_list("geom")).alias("geom_parts"))
