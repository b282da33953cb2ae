"""Op 12. Hard-negative mining with anchor spanning-tree bounds.

Anchors of a block hang in a minimum spanning tree over their distances. A candidate is scored
against the root; below it, the score at the parent, plus or minus the edge's length times the
candidate's norm, bounds the score at the child (Cauchy-Schwarz on the difference of the two
anchors). Only candidates whose bounds overlap a window of the child that can still take them are
scored again; for the others the bounds go on down the tree and widen by the next edge.

Scores are integers: components are scaled and rounded down first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlines.operators.scan import prefix_scan
from roadlines.session import cut

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
BLOCK = 2048  # anchors in one broadcast tree
SLICE = 8192  # candidates that go down a tree together
EXACT = float(1 << 53)  # integers in double precision are exact below it
NO_ID = np.iinfo(np.int64).max  # stands for a null id: it comes last among ties


def rounded(rows: pa.ListArray, scale: float, width: int) -> np.ndarray:
    """floor(scale * x) of each vector as doubles, shorter ones filled up with zeros to `width` or more."""
    ends = np.asarray(rows.offsets)
    flat = np.floor(np.asarray(rows.values, dtype=np.float64) * scale)
    sizes = np.diff(ends)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat[ends[0]:ends[-1]].reshape(-1, width)
    out = np.zeros((len(sizes), width))
    inside = np.arange(width) < sizes[:, None]
    out[inside] = flat[ends[0]:ends[-1]]
    return out


def products(x: np.ndarray, a: np.ndarray, safe: bool) -> np.ndarray:
    """Inner products of the rows of x with a, exact; held to 64 bits where they do not fit."""
    if safe:
        return (x @ a).astype(np.int64)
    whole = [int(v) for v in a]
    exact = [sum(int(p) * q for p, q in zip(row, whole, strict=True)) for row in x]
    return np.array([min(max(s, -NO_ID), NO_ID) for s in exact], np.int64)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, edge length) of each row in a minimum spanning tree of distances, the root being row 0 (Prim)."""
    n = len(x)
    parent, edge = np.full(n, -1, np.int64), np.zeros(n)
    near, of = np.full(n, np.inf), np.zeros(n, np.int64)
    left = np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        left[at] = False
        with np.errstate(over="ignore"):
            d = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = left & (d < near)
        near[closer], of[closer] = d[closer], at
        at = int(np.where(left, near, np.inf).argmin()) if np.isfinite(near[left]).any() else int(np.flatnonzero(left)[0])
        parent[at], edge[at] = of[at], near[at]
    return parent, edge


def downward(parent: np.ndarray) -> list[tuple[int, bool]]:
    """Nodes in an order of visits, parents first; with each, whether it is its parent's last child.

    The largest subtree comes last, and by then the parent's bounds are needed no more, so that
    the bounds of at most log2(n) nodes wait at any time.
    """
    n = len(parent)
    children: list[list[int]] = [[] for _ in range(n)]
    order = [0] if n else []
    for k in range(1, n):
        children[parent[k]].append(k)
    for k in order:
        order.extend(children[k])
    size = np.ones(n, np.int64)
    for k in reversed(order[1:]):
        size[parent[k]] += size[k]
    visits, stack = [], [(0, True)] if n else []
    while stack:
        k, last = stack.pop()
        visits.append((k, last))
        below = sorted(children[k], key=lambda c: size[c])
        stack += [(c, i == len(below) - 1) for i, c in reversed(list(enumerate(below)))]
    return visits


class Search:
    """The best rows of every window of every anchor in a block, over the candidates of one task.

    windows[k] lists the (least, greatest) scores of anchor k; `same` says whether a candidate has
    to have the anchor's label or another one. Each window keeps its first `top` rows by
    descending score, then ascending id.
    """

    def __init__(self, anchors: dict[str, Any], windows: list[list[tuple[int, int]]], top: int, same: bool):
        self.a, self.windows, self.top, self.same = anchors, windows, top, same
        self.visits = downward(anchors["parent"])
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.best = [[none for _ in w] for w in windows]
        self.largest = float(np.abs(anchors["x"]).max(initial=0.0))
        self.rescored = 0

    def open_windows(self, k: int) -> list[tuple[int, int]]:
        """The windows of anchor k, from the score that still enters a full one, overlapping ones as one."""
        now = []
        for (lo, hi), (scores, _) in zip(self.windows[k], self.best[k], strict=True):
            lo = max(lo, int(scores[-1])) if len(scores) == self.top else lo
            if lo <= hi:
                now.append((lo, hi))
        out: list[tuple[int, int]] = []
        for lo, hi in sorted(now):
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], max(hi, out[-1][1]))
            else:
                out.append((lo, hi))
        return out

    def add(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        width = self.a["x"].shape[1]
        if x.shape[1] != width:
            wide = max(width, x.shape[1])
            x = np.pad(x, ((0, 0), (0, wide - x.shape[1])))
            self.a = self.a | {"x": np.pad(self.a["x"], ((0, 0), (0, wide - width)))}
        largest = float(np.abs(x).max(initial=0.0))
        safe = largest * self.largest * x.shape[1] < EXACT
        with np.errstate(over="ignore"):
            norms = np.sqrt((x * x).sum(axis=1)) * (1 + 1e-12)
        vectors, edges, parent = self.a["x"], self.a["edge"], self.a["parent"]
        bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, last in self.visits:
            lo = hi = None
            if k:
                lo, hi = bounds.pop(parent[k]) if last else bounds[parent[k]]
                reach = norms * edges[k] * (1 + 1e-12) + 1e-6
                lo, hi = lo - reach, hi + reach
            fits = (labels == self.a["label"][k]) == self.same
            if k and safe:
                overlap = np.zeros(len(x), bool)
                for least, greatest in self.open_windows(k):
                    overlap |= (hi >= least) & (lo <= greatest)
                again = np.flatnonzero(overlap & fits)
                # to pick more than half of the rows costs more than their products
                scores = (products(x, vectors[k], True)[again] if 2 * len(again) > len(x)
                          else products(x[again], vectors[k], True))
                lo[again] = hi[again] = scores
                self.rescored += len(again)
            else:  # the root, and vectors too large for bounds in double precision
                again, scores = np.arange(len(x)), products(x, vectors[k], safe)
                lo, hi = scores.astype(float), scores.astype(float)
            bounds[k] = (lo, hi)
            fits = fits[again] & (ids[again] != self.a["id"][k])
            self.take(k, scores[fits], ids[again][fits])

    def take(self, k: int, scores: np.ndarray, ids: np.ndarray) -> None:
        windows = self.windows[k]
        if not len(scores) or not windows:
            return
        opened = self.open_windows(k)
        if not opened:
            return
        inside = (scores >= opened[0][0]) & (scores <= opened[-1][1])
        scores, ids = scores[inside], ids[inside]
        order = np.lexsort((ids, -scores))
        scores, ids = scores[order], ids[order]
        for j, (lo, hi) in enumerate(windows):
            first = np.searchsorted(-scores, -hi, side="left")
            to = min(first + self.top, np.searchsorted(-scores, -lo, side="right"))
            if to > first:
                s, i = self.best[k][j]
                s, i = np.concatenate([s, scores[first:to]]), np.concatenate([i, ids[first:to]])
                by = np.lexsort((i, -s))[: self.top]
                self.best[k][j] = (s[by], i[by])


def usable(vector: Column, scale: float) -> Column:
    """A vector that is not null and whose components are all finite numbers, scaled ones too."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x.cast("double") * scale) < float("inf")))


def planted(anchors: DataFrame, block: int, scale: float) -> DataFrame:
    """`anchors` (id, label, vector) in blocks of at most `block`, each a spanning tree; alike ones share a block."""
    # signs of the first components bring anchors of like directions together, and edges are short
    signs = F.aggregate(F.slice("vector", 1, 16), F.lit(0), lambda t, x: t * 2 + F.when(x > 0, 1).otherwise(0))
    ranked = prefix_scan(anchors.withColumn("signs", signs), [], ["signs", "label", "id"], rank="rank")
    placed = ranked.withColumn("block", ((F.col("rank") - 1) / block).cast("int"))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank").reset_index(drop=True)
        x = rounded(pa.array(rows["vector"].tolist(), pa.list_(pa.float64())), scale, 0)
        parent, edge = spanning_tree(x)
        return pd.DataFrame({"block": rows["block"], "node": np.arange(len(rows)), "id": rows["id"], "label": rows["label"],
                             "vector": list(x), "parent": parent, "edge": edge})

    return cut(placed.select("block", "rank", "id", "label", F.col("vector").cast("array<double>").alias("vector"))
               .groupBy("block").applyInPandas(
                   grow, "block int, node long, id long, label long, vector array<double>, parent long, edge double"))


def searched(rows: DataFrame, tree: dict[str, Any], windows: list[list[tuple[int, int]]], top: int, same: bool,
             scale: float) -> DataFrame:
    """(node, window, score, id): the first rows of each window among the rows of each task."""
    held = rows.sparkSession.sparkContext.broadcast((tree, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*held.value, top, same)
        for batch in batches:
            x = rounded(batch["vector"], scale, search.a["x"].shape[1])
            ids = np.asarray(batch["id"].fill_null(NO_ID))
            labels = np.asarray(batch["label"])
            for s in range(0, len(x), SLICE):
                search.add(x[s:s + SLICE], ids[s:s + SLICE], labels[s:s + SLICE])
        kept = [(k, j, s, i) for k, found in enumerate(search.best) for j, (s, i) in enumerate(found) if len(s)]
        if kept:
            sizes = [len(s) for *_, s, _ in kept]
            ids = np.concatenate([i for *_, i in kept])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([k for k, *_ in kept], sizes).astype(np.int64)),
                pa.array(np.repeat([j for _, j, *_ in kept], sizes).astype(np.int32)),
                pa.array(np.concatenate([s for *_, s, _ in kept])), pa.array(ids, mask=ids == NO_ID)],
                ["node", "window", "score", "id"])

    return rows.select("id", "label", "vector").mapInArrow(run, "node long, window int, score long, id long")


def first_of(found: DataFrame, top: int) -> DataFrame:
    """(node, window, place, score, id): the first `top` of each window over all tasks, from place 1 on."""
    row = F.struct((-F.col("score")).alias("s"), F.coalesce("id", F.lit(int(NO_ID))).alias("i"))
    merged = found.groupBy("node", "window").agg(F.slice(F.sort_array(F.collect_list(row)), 1, top).alias("rows"))
    return merged.select("node", "window", F.posexplode("rows").alias("place", "row")).select(
        "node", "window", (F.col("place") + 1).alias("place"), (-F.col("row.s")).alias("score"),
        F.when(F.col("row.i") != int(NO_ID), F.col("row.i")).alias("id"))


def mine(rows: DataFrame, is_anchor: Callable[[Column], Column], row_id: str = "vec_id", vector: str = "embedding",
         label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id meets `is_anchor`. For each anchor and each of its first
    `positives` other rows of its label, the first `negatives` rows of another label with
    low * positive_score <= 100 * score <= high * positive_score come back, ranked from 1. Higher
    scores come first, ties by smaller id. Scores are inner products of floor(scale * x).

    Rows with a null label, a null vector, or a null or non-finite component take no part. Shorter
    vectors are filled up with zeros. Rows without an id are never anchors and come after all
    others of their score. Repeated rows count each time, but a row with the anchor's own id is
    not another row; an id that repeats is one anchor, the row of the least label and vector.
    Scores beyond 64 bits are held to them.

    Anchors go in blocks of at most `block`, a bounded tree that is held and broadcast while all
    candidates pass it, twice: for the positives, whose scores set the windows, and for the
    negatives. Each task keeps the first rows of each window only; candidates are never shuffled.
    """
    good = rows.select(F.col(row_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                       F.col(vector).alias("vector")).where(F.col("label").isNotNull() & usable(F.col("vector"), scale))
    anchors = good.where(F.col("id").isNotNull() & is_anchor(F.col("id"))).groupBy("id").agg(
        F.min(F.struct("label", "vector")).alias("one")).select("id", "one.*")
    trees = planted(anchors, block, scale)
    out = None
    for r in trees.select("block").distinct().orderBy("block").toLocalIterator():
        nodes = trees.where(F.col("block") == r.block)
        here = nodes.toPandas().sort_values("node")
        tree = {"id": here["id"].to_numpy(), "label": here["label"].to_numpy(), "x": np.stack(here["vector"].tolist()),
                "parent": here["parent"].to_numpy(), "edge": here["edge"].to_numpy()}
        whole = [(-int(NO_ID), int(NO_ID))]
        liked = cut(first_of(searched(good, tree, [whole] * len(here), positives, True, scale), positives))
        windows: list[list[tuple[int, int]]] = [[] for _ in range(len(here))]
        for p in liked.orderBy("node", "place").toLocalIterator():
            windows[p.node].append((-(-low * p.score // 100), high * p.score // 100))
        hard = cut(first_of(searched(good, tree, windows, negatives, False, scale), negatives))
        named = liked.select("node", (F.col("place") - 1).alias("window"), F.col("id").alias("positive_id"),
                             F.col("score").alias("positive_score"))
        found = nodes.select("node", F.col("id").alias("anchor_id")).join(named, "node").join(hard, ["node", "window"]).select(
            "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else rows.sparkSession.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
