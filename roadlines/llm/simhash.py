"""Op 11. SimHash near-duplicates by BK-trees.

Every distinct fingerprint stands in one shard of at most SHARD fingerprints. A shard becomes a
BK-tree: a child hangs below its parent on the edge numbered by their Hamming distance. The trees
are broadcast one at a time, and a batch of fingerprints walks down together, following only the
edges within the radius of its distance to the node it stands on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlines.llm.common import join_skewed
from roadlines.llm.near_dedup import components
from roadlines.operators.scan import prefix_scan
from roadlines.session import cut

WORDS = 3
SEED = 42
RADIUS = 2
SHARD = 1 << 17  # fingerprints in one broadcast tree: 13 bytes each
EDGES = 65  # distances of 64-bit numbers
CHUNK = 1 << 13  # shingles that are unpacked at a time
FRONTIER = 1 << 19  # (query, node) pairs that are expanded at a time
QUERIES = 2048  # fingerprints that walk down together


def simhash(raw: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half of the hashes of all `words`-word shingles.

    Bytes A-Z are lower-cased; words are separated by white space of ASCII. Repeated shingles
    count each time, fewer words are one shingle, no words give zero.
    """
    found = raw.lower().split()
    if not found:
        return 0
    width = min(words, len(found))
    line = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes)
    starts, ends = (ends - sizes)[: len(found) - width + 1], ends[width - 1:] - 1
    bits = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        h = [digest(line[s:e], seed) for s, e in zip(starts[at:at + CHUNK].tolist(), ends[at:at + CHUNK].tolist(), strict=True)]
        rows = np.array(h, np.uint64).view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprinted(docs: DataFrame, text: str = "text", to: str = "fp") -> DataFrame:
    """Add `to`: the fingerprint of the whole text as a long. A null text has the empty one's, zero."""
    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([simhash((x.as_py() or "").encode()) for x in batch], np.uint64).view(np.int64))

    return docs.withColumn(to, run(F.col(text)))


def render(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def grow(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, edge) of each of the distinct `fps` in the BK-tree rooted at the first.

    The fingerprints are dropped in together: those that stand on one node part by their distance
    to it, and the first of each distance becomes the child on that edge.
    """
    n = len(fps)
    parent, edge = np.full(n, -1, np.int32), np.zeros(n, np.uint8)
    left, at = np.arange(1, n), np.zeros(max(0, n - 1), np.int64)
    while len(left):
        slot = at * EDGES + np.bitwise_count(fps[left] ^ fps[at])
        order = np.argsort(slot, kind="stable")
        left, slot = left[order], slot[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]])
        heads = left[first]
        parent[heads], edge[heads] = slot[first] // EDGES, slot[first] % EDGES
        at = heads[np.cumsum(first) - 1]
        left, at = left[~first], at[~first]
    return parent, edge


class Tree:
    """A BK-tree whose nodes' children lie in order of their edges, so that a range of edges is a slice."""

    def __init__(self, fps: np.ndarray, parent: np.ndarray, edge: np.ndarray):
        self.fps = fps
        slot = parent[1:].astype(np.int64) * EDGES + edge[1:]
        self.children = (np.argsort(slot, kind="stable") + 1).astype(np.int32)
        self.start = np.zeros(len(fps) * EDGES + 1, np.int32)
        np.cumsum(np.bincount(slot, minlength=len(fps) * EDGES), out=self.start[1:])

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, node) of all pairs within `radius`."""
        waiting = [(np.arange(len(queries)), np.zeros(len(queries), np.int64))] if len(self.fps) else []
        while waiting:
            q, node = waiting.pop()
            if len(q) > FRONTIER:
                waiting.append((q[FRONTIER:], node[FRONTIER:]))
                q, node = q[:FRONTIER], node[:FRONTIER]
            d = np.bitwise_count(queries[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            lo = self.start[node * EDGES + np.maximum(d - radius, 0)]
            size = self.start[node * EDGES + np.minimum(d + radius, EDGES - 1) + 1] - lo
            some = size > 0
            if some.any():
                lo, size, q = lo[some], size[some].astype(np.int64), q[some]
                upto = np.cumsum(size)
                place = np.arange(upto[-1]) + np.repeat(lo - (upto - size), size)
                waiting.append((np.repeat(q, size), self.children[place].astype(np.int64)))


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(u, v): all pairs of different fingerprints within `radius` bits; `fps` has distinct fp.

    Shards are slices in order of the bits set, the distance to zero, so that a tree is only
    walked by fingerprints whose own bits are within the radius of the shard's. One tree of a
    bounded size is held and broadcast at a time; links are written to the shared folder.
    """
    spark = fps.sparkSession
    ranked = prefix_scan(
        fps.select("fp", F.bit_count("fp").alias("bits"), F.xxhash64("fp").alias("mixed")), [], ["bits", "mixed", "fp"], rank="rank")
    placed = ranked.select("fp", "bits", ((F.col("rank") - 1) / shard).cast("int").alias("shard"))

    def plant(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fp", key=lambda x: x * np.int64(-7046029254386353131))
        parent, edge = grow(rows["fp"].to_numpy().view(np.uint64))
        return pd.DataFrame({"shard": rows["shard"].to_numpy(), "node": np.arange(len(rows), dtype=np.int32),
                             "fp": rows["fp"].to_numpy(), "parent": parent, "edge": edge.astype(np.int16)})

    placed = cut(placed)
    trees = cut(placed.groupBy("shard").applyInPandas(plant, "shard int, node int, fp long, parent int, edge short"))
    bounds = placed.groupBy("shard").agg(F.min("bits").alias("lo"), F.max("bits").alias("hi")).orderBy("shard")
    out = None
    for row in bounds.toLocalIterator():
        rows = trees.where(F.col("shard") == row.shard).select("node", "fp", "parent", "edge").toPandas().sort_values("node")
        held = spark.sparkContext.broadcast((rows["fp"].to_numpy().view(np.uint64), rows["parent"].to_numpy(),
                                             rows["edge"].to_numpy()))

        def walk(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tree = None
            for batch in batches:
                tree = tree or Tree(*held.value)
                mine = batch["fp"].to_numpy().view(np.uint64)
                for s in range(0, len(mine), QUERIES):
                    part = mine[s:s + QUERIES]
                    for q, node in tree.within(part, radius):
                        u, v = part[q], tree.fps[node]
                        once = u < v
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(u[once].view(np.int64)), pa.array(v[once].view(np.int64))], ["u", "v"])

        near = placed.where(F.col("bits").between(row.lo - radius, row.hi + radius)).select("fp").repartition("fp")
        found = cut(near.mapInArrow(walk, "u long, v long"))
        held.unpersist()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else placed.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where(F.lit(False))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs`; other columns stay out.

    Documents with equal fingerprints are one class, and classes link within `radius` bits.
    component_id is the smallest id that a document reaches, itself included. Null texts, empty
    ones and those of white space have fingerprint zero, which links like any other. Repeated
    rows come back each time; rows without an id join a component but never name it, and a
    component without any id has a null component_id.
    """
    signed = cut(fingerprinted(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"))
    classes = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    pairs = links(classes.select("fp"), radius)
    ends = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    roots = components(ends, pairs).withColumnsRenamed({"id": "fp"})
    rooted = cut(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id", "n")
    return join_skewed(signed, named, "fp").select("doc_id", "fp", "component_id")
