"""Op 1. Benchmark decontamination by pigeonhole edit matching.

A test item that may be changed by k edits is split into k + 1 pieces: whatever the edits, one
piece stands unchanged. Exact hits of pieces are found with one automaton per block of items, and
Myers' bit-parallel distance verifies the surroundings of each hit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlines.llm.common import unused

ERROR_RATE = 0.06
MIN_CHARS = 40  # of items that may be changed; shorter ones have to stand as they are, between word borders
BLOCK_CHARS = 1_000_000  # of item text in one automaton, which takes about 70 bytes a character


def normal(text: str | None) -> str:
    """Lower case, with each run of white space as one space."""
    return " ".join((text or "").lower().split())


def budget(n: int, rate: float = ERROR_RATE) -> int:
    return int(n * rate)


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """k + 1 pieces of n characters, as even as can be."""
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def myers(masks: dict[str, int], m: int, text: str, start: int, end: int, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of a pattern that ends in text[start:end], if within k."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, k + 1, -1
    get = masks.get
    for i in range(start, end):
        eq = get(text[i], 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, at = score, i + 1
    return (best, at) if best <= k else None


def matcher(items: tuple[tuple[int, str], ...], rate: float, min_chars: int):
    """The automaton of all pieces, and each item's text, budget (None: short) and bit masks."""
    found: dict[str, list] = {}
    parts = []
    for i, (_, text) in enumerate(items):
        if len(text) < min_chars:
            parts.append((text, None, {}))
            found.setdefault(text, []).append((i, 0))
            continue
        k = budget(len(text), rate)
        masks: dict[str, int] = {}
        for j, c in enumerate(text):
            masks[c] = masks.get(c, 0) | 1 << j
        parts.append((text, k, masks))
        for lo, hi in pieces(len(text), k):
            found.setdefault(text[lo:hi], []).append((i, lo))
    automaton = ahocorasick.Automaton()
    for piece, places in found.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    return automaton, parts


_kept: dict = {}


def kept_matcher(key, items, rate: float, min_chars: int):
    """The matcher of a broadcast block, kept for the worker's next task; that of another block goes first."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = matcher(items, rate, min_chars)
    return _kept[key]


def alone(text: str, start: int, end: int) -> bool:
    """text[start:end] is not part of a longer word."""
    return not (start > 0 and text[start - 1].isalnum() and text[start].isalnum()) and not (
        end < len(text) and text[end].isalnum() and text[end - 1].isalnum())


def find(text: str, automaton, parts) -> list[tuple[int, int, int]]:
    """(item number, distance, end in the normalised text) of each item's best match.

    Hits of an item that lie on nearby diagonals share their surroundings, which are verified
    once, in stretches that never overlap by more than the items' own length.
    """
    starts: dict[int, list[int]] = {}
    for end, (size, places) in automaton.iter(text):
        for i, lo in places:
            starts.setdefault(i, []).append(end + 1 - size - lo)
    out = []
    for i, found in starts.items():
        item, k, masks = parts[i]
        best, m = None, len(item)
        found.sort()
        if k is None:
            at = next((at for at in found if alone(text, at, at + m)), None)
            if at is not None:
                out.append((i, 0, at + m))
            continue
        lo = hi = None
        stretches = []
        for at in found:
            if hi is not None and at - k <= hi - m:
                hi = max(hi, at + m + k)
            else:
                if hi is not None:
                    stretches.append((lo, hi))
                lo, hi = at - k, at + m + k
        stretches.append((lo, hi))
        for lo, hi in stretches:
            lo, hi = max(0, lo), min(len(text), hi)
            at = text.find(item, lo, hi)
            hit = (0, at + m) if at >= 0 else myers(masks, m, text, lo, hi, k)
            if hit and (best is None or hit < best):
                best = hit
        if best:
            out.append((i, *best))
    return out


def item_blocks(benchmark: DataFrame, item_id: str, text: str,
                block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, in a stable order; empty ones are left out.

    The benchmark is the stated query set. It streams to the driver partition by partition, and
    one block at a time is held.
    """
    block, size = [], 0
    for r in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).orderBy("i", "t").toLocalIterator():
        item = normal(r.t)
        if not item:
            continue
        block.append((r.i, item))
        size += len(item)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
            item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE,
            min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, n_chars): each item that a document holds within its budget.

    Both sides are compared in lower case with white space run together. An item of n characters
    may differ by `rate` * n edits. One below `min_chars` characters has to stand as it is, not
    as part of longer words. Empty and null items match nothing, nor do null or empty texts. A
    document and item give one row, that of the least distance, and among these of the earliest
    end; repeated rows of either table repeat it. Documents are scanned once per block of items
    and never shuffled.
    """
    out = None
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {benchmark.schema[item_id].dataType.simpleString()}, distance int, n_chars int"
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    for block in item_blocks(benchmark, item_id, item_text):
        held = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, tuple(block)))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            key, items = held.value
            automaton, parts = kept_matcher(key, items, rate, min_chars)
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True)
                        for hit in find(normal(t.as_py()), automaton, parts)]
                if rows:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r[0] for r in rows], batch.schema.field("doc_id").type),
                        pa.array([items[r[1]][0] for r in rows]),
                        pa.array([r[2] for r in rows], pa.int32()),
                        pa.array([len(items[r[1]][1]) for r in rows], pa.int32())],
                        ["doc_id", "item_id", "distance", "n_chars"])

        found = source.mapInArrow(scan, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else source.select(
        "doc_id", F.lit(None).cast(benchmark.schema[item_id].dataType).alias("item_id"),
        F.lit(0).alias("distance"), F.lit(0).alias("n_chars")).where(F.lit(False))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """`docs` without those that hold an item. Rows without an id are told apart by their text."""
    key, leak = F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("th")), unused(docs, "_leak")
    keyed = docs.withColumn(leak, F.to_json(key))
    bad = matches(keyed, benchmark, leak, text, **options).select(F.col("doc_id").alias(leak)).distinct()
    return keyed.join(bad, leak, "left_anti").drop(leak)
