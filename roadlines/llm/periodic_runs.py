"""Op 13. Periodic runs of words by string synchronising sets.

A run is a maximal stretch with smallest period q that is at least four periods long. For each
scale t = 4, 8, 16, ... a set of positions is selected by the 2t words that follow them alone
(the least hash of a t-word window), so that equal surroundings select equal positions. A run of
period t <= q < 2t holds a selected position among its first t words, and the next position with
the same 2t words stands q further: such neighbours propose q, and comparing words confirms and
extends it. Windows of small periods are left out of the selection, or they would all be
selected; these regions are the runs found at earlier scales, and periods 1 to 3 come from
comparing the words at that distance directly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlines.llm.near_dedup import _mix

EXPONENT = 4  # the least length of a run in periods; the scales rest on it
LEAST = 6  # the least length of a run in words
SMALL = 4  # periods below it are found directly
GROUP = 1 << 17  # words that are looked through at once; a longer document goes alone
NEVER = np.uint64((1 << 64) - 1)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
    return edges[::2], edges[1::2]


def small_periods(t: np.ndarray, q: int) -> np.ndarray:
    """Runs (start, length, period) of the small period q, at least four periods long."""
    if len(t) < EXPONENT * q:
        return np.zeros((0, 3), np.int64)
    start, end = stretches(t[:-q] == t[q:])
    size = end - start + q
    keep = size >= EXPONENT * q
    start, size = start[keep], size[keep]
    if q > 1:  # words all alike have period 1; a smaller period divides q, which leaves only that one
        keep = (t[start] != t[start + 1]) if q == 2 else (t[start] != t[start + 1]) | (t[start] != t[start + 2])
        start, size = start[keep], size[keep]
    return np.column_stack([start, size, np.full(len(start), q)])


def selected(names: np.ndarray, omitted: np.ndarray, scale: int) -> np.ndarray:
    """The synchronising positions of a scale; names[j] identifies the `scale` words from j on.

    Position i is selected if the least name of windows i to i + scale, omitted ones left out, is
    that of the first or the last of them.
    """
    names = np.where(omitted, NEVER, names)
    least, width = names, 1
    while width < scale:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    first, last = names[:-scale], names[scale:]
    least = np.minimum(least[: len(last)], last)
    return np.flatnonzero((least != NEVER) & ((first == least) | (last == least)))


def extended(t: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """[start, end) of the longest stretch around word i in which words p apart are equal."""
    x, step, last = i, 32, len(t) - p
    while x < last:
        off = np.flatnonzero(t[x:min(last, x + step)] != t[x + p:min(last, x + step) + p])
        if len(off):
            x += int(off[0])
            break
        x, step = min(last, x + step), 2 * step
    y, step = i, 32
    while y > 0:
        lo = max(0, y - step)
        off = np.flatnonzero(t[lo:y] != t[lo + p:y + p])
        if len(off):
            y = lo + int(off[-1]) + 1
            break
        y, step = lo, 2 * step
    return y, x + p


def all_runs(t: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Runs (start, length, period) of four periods and more in a row of documents.

    `t` holds word numbers of documents in descending order of their `sizes`, each closed by a
    number that occurs nowhere else, so that no run crosses it.
    """
    ends = np.cumsum(np.asarray(sizes, np.int64) + 1)

    def holding(words: int) -> int:
        """How much of `t` belongs to documents of at least so many words."""
        n = int(np.searchsorted(-np.asarray(sizes), -words, side="right"))
        return int(ends[n - 1]) if n else 0

    found = [small_periods(t[: holding(EXPONENT * q)], q) for q in range(1, SMALL)]
    names, width, scale = _mix(t.view(np.uint64) ^ np.uint64(0x243F6A8885A308D3)), 1, SMALL

    def doubled(x: np.ndarray, width: int) -> np.ndarray:
        return _mix(x[:-width] * np.uint64(0x9FB21C651E98DF25) + x[width:]) if len(x) > width else x[:0]

    while (n := holding(EXPONENT * scale)) > 0:
        t = t[:n]
        names = names[: n - width + 1]
        while width < scale:
            names, width = doubled(names, width), 2 * width
        before = np.concatenate(found)
        periodic = before[(EXPONENT * before[:, 2] <= scale) & (before[:, 1] >= scale) & (before[:, 0] < n)]
        omitted = np.zeros(len(names) + 1, np.int32)
        np.add.at(omitted, periodic[:, 0], 1)
        np.add.at(omitted, periodic[:, 0] + periodic[:, 1] - scale + 1, -1)
        omitted = np.cumsum(omitted[:-1]) > 0
        longer = doubled(names, scale)
        at = selected(names, omitted, scale)
        context = longer[at]
        order = np.argsort(context, kind="stable")
        at, context = at[order], context[order]
        gap = at[1:] - at[:-1]
        proposed = (context[1:] == context[:-1]) & (gap >= scale) & (gap < 2 * scale)
        i, p = at[:-1][proposed], gap[proposed]
        order = np.lexsort((i, p))
        fresh, lo, hi, of = [], 0, 0, 0
        for i, p in zip(i[order].tolist(), p[order].tolist(), strict=True):
            if p == of and lo <= i and i + p < hi:
                continue  # in the stretch that the last proposal found
            lo, hi = extended(t, i, p)
            of = p
            if hi - lo >= EXPONENT * p:
                fresh.append((lo, hi - lo, p))
        if fresh:
            found.append(np.array(fresh, np.int64))
        names, width, scale = longer, 2 * scale, 2 * scale
    return np.concatenate(found)


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """The runs of each of some lists of words, by start, then period."""
    out = [np.zeros((0, 3), np.int64)] * len(texts)
    order = sorted((k for k in range(len(texts)) if len(texts[k]) >= least), key=lambda k: -len(texts[k]))
    s = 0
    while s < len(order):
        e, n = s, 0
        while e < len(order) and (e == s or n + len(texts[order[e]]) <= GROUP):
            n += len(texts[order[e]])
            e += 1
        part = order[s:e]
        number: dict[bytes, int] = defaultdict(count().__next__)
        rows = []
        for j, k in enumerate(part):
            rows += [np.fromiter(map(number.__getitem__, texts[k]), np.int64, len(texts[k])), np.array([-1 - j], np.int64)]
        sizes = [len(texts[k]) for k in part]
        found = all_runs(np.concatenate(rows), sizes)
        found = found[found[:, 1] >= least]
        firsts = np.concatenate([[0], np.cumsum(np.asarray(sizes) + 1)[:-1]])
        doc = np.searchsorted(firsts, found[:, 0], side="right") - 1
        found[:, 0] -= firsts[doc]
        by = np.lexsort((found[:, 2], found[:, 0], doc))
        found, doc = found[by], doc[by]
        cuts = np.searchsorted(doc, np.arange(len(part) + 1))
        for j, k in enumerate(part):
            out[k] = found[cuts[j]:cuts[j + 1]]
        s = e
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that are in no run after its first period, joined by one space."""
    if len(runs):
        gone = np.zeros(len(words) + 1, np.int32)
        np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
        np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    return b" ".join(words)


def find(docs: DataFrame, text: str = "text", least: int = LEAST, to: str = "periodic") -> DataFrame:
    """Add the struct `to`: n_words, runs (start, length, period) in order, and the collapsed text.

    Words are parted by ASCII white space and compared as they are, over the whole text. Runs
    have at least max(`least`, four periods) words and come by start, then period; places count
    words from 0. The collapsed text keeps the first period of each run. A null, empty or blank
    text has no words, no runs and an empty collapsed text. Rows are neither dropped nor shuffled;
    an existing column `to` is replaced.
    """
    if least < 1:
        raise ValueError("least must be positive")
    kind = f"struct<n_words:bigint,runs:{RUNS},collapsed:string>"

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = []
            for s in range(0, len(batch), 512):
                texts = [(x.as_py() or "").encode().split() for x in batch[s:s + 512]]
                runs = runs_of(texts, least)
                flat = np.concatenate([*runs, np.zeros((0, 3), np.int64)])
                ends = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
                done.append(pa.StructArray.from_arrays([
                    pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), rows),
                    pa.array([collapsed(t, r).decode() for t, r in zip(texts, runs, strict=True)], pa.string())],
                    ["n_words", "runs", "collapsed"]))
            yield pa.concat_arrays(done) if done else pa.array([], done_type())

    def done_type() -> pa.DataType:
        run_type = pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])
        return pa.struct([("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    return docs.withColumn(to, run(F.col(text)))


def strongest(runs: Column) -> Column:
    """The run of the greatest length per period, compared exactly; ties go to the smallest start, then period."""
    def better(best: Column, x: Column) -> Column:
        return F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
