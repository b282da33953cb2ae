"""Op 3. Byte-level BPE as a monoid tree reduction.

A text is halved until its parts are small. A part's value is its token ids; two neighbours are
joined by encoding a window around their border anew and keeping the ids outside it. The window
grows until it begins and ends where a non-space is followed by a space. No match of the
splitting pattern holds a non-space followed by a space, so such a place is a border between
matches whatever stands around it, and the ids outside the window cannot change. Without such a
place the window grows to the whole part, which is always right. Decoding concatenates the
bytes up the same tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlines.llm.common import unused

LEAF = 4096
TEXTS = 256  # that are encoded and decoded at a time
WINDOW = 32


def read_ranks(spark: SparkSession, path: str):
    """Broadcast the vocabulary file: one fixed file of some 50,000 lines, read on the driver."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(maxsize=4)
def codec(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _left_border(text: str, lo: int, mid: int) -> int:
    """The last safe border inside text[lo:mid], found in windows that double; `lo` if none."""
    width = WINDOW
    while True:
        at = max(lo, mid - width)
        for i in range(mid - 1, at, -1):
            if text[i] in " \n" and not text[i - 1].isspace():
                return i
        if at == lo:
            return lo
        width *= 2


def _right_border(text: str, mid: int, hi: int) -> int:
    """The first safe border inside text[mid:hi]; `hi` if none."""
    for i in range(mid + 1, hi):
        if text[i] in " \n" and not text[i - 1].isspace():
            return i
    return hi


def join_parts(enc, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    p, q = _left_border(text, lo, mid), _right_border(text, mid, hi)
    stale_left = len(left) if p == lo else len(enc.encode_to_numpy(text[p:mid], disallowed_special=()))
    stale_right = len(right) if q == hi else len(enc.encode_to_numpy(text[mid:q], disallowed_special=()))
    window = enc.encode_to_numpy(text[p:q], disallowed_special=())
    return np.concatenate([left[: len(left) - stale_left], window, right[stale_right:]])


def encode_text(enc, text: str, leaf: int = LEAF) -> np.ndarray:
    def tree(lo: int, hi: int) -> np.ndarray:
        if hi - lo <= leaf:
            return enc.encode_to_numpy(text[lo:hi], disallowed_special=())
        mid = (lo + hi) // 2
        return join_parts(enc, text, lo, mid, hi, tree(lo, mid), tree(mid, hi))

    return tree(0, len(text))


def decode_ids(enc, ids: np.ndarray, leaf: int = LEAF) -> bytes:
    if len(ids) <= leaf:
        return enc.decode_bytes(ids.tolist())
    mid = len(ids) // 2
    return decode_ids(enc, ids[:mid], leaf) + decode_ids(enc, ids[mid:], leaf)


def encode(docs: DataFrame, ranks, pattern: str, text: str = "text", ids: str = "ids",
           leaf: int = LEAF) -> DataFrame:
    """Add the token ids of the whole `text` as array<int>; a null text is empty and gives [].

    Rows stay as they are and are never shuffled; a batch of texts at a time is in memory.
    """
    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = codec(ranks.value, pattern)
        for batch in batches:
            parts = [encode_text(enc, t.as_py() or "", leaf) for t in batch]
            ends = np.cumsum([0, *map(len, parts)])
            flat = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))

    return docs.withColumn(ids, run(F.col(text)))


def encode_and_decode(docs: DataFrame, ranks, pattern: str, text: str = "text", ids: str = "ids",
                      decoded: str = "decoded", leaf: int = LEAF) -> DataFrame:
    """Add the token ids of the whole `text` and the bytes that they stand for, as `encode` and `decode` do.

    Both run in one Python worker a task, a few texts at a time, which halves the memory that
    vocabularies and batches take beside each other.
    """
    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = codec(ranks.value, pattern)
        for batch in batches:
            for s in range(0, len(batch), TEXTS):
                parts = [encode_text(enc, t.as_py() or "", leaf) for t in batch[s:s + TEXTS]]
                ends = np.cumsum([0, *map(len, parts)])
                flat = np.concatenate(parts).astype(np.int32)
                yield pa.StructArray.from_arrays([
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                    pa.array([decode_ids(enc, x, leaf) for x in parts], pa.binary())], ["ids", "decoded"])

    both, others = unused(docs, "_both"), [c for c in docs.columns if c not in (ids, decoded)]
    return docs.withColumn(both, run(F.col(text))).select(
        *others, F.col(both)["ids"].alias(ids), F.col(both)["decoded"].alias(decoded))


def decode(docs: DataFrame, ranks, pattern: str, ids: str = "ids", decoded: str = "decoded",
           leaf: int = LEAF) -> DataFrame:
    """Add the bytes that `ids` stand for; null ids give no bytes."""
    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = codec(ranks.value, pattern)
        for batch in batches:
            yield pa.array([decode_ids(enc, x.values.to_numpy(zero_copy_only=False), leaf) if x.is_valid
                            else b"" for x in batch], pa.binary())

    return docs.withColumn(decoded, run(F.col(ids)))
