"""Op 6. Personal data by a semi-Markov conditional random field.

The model scores whole spans: each feature sees a candidate segment from end to end, with what
stands around it. A dynamic program over segments of bounded length chooses boundaries and types
together. Its weights are fitted to base matches in a bounded sample of texts; it adds spans of
the same types that the base patterns miss, and base spans always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in the order in which they are listed, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

MAX_TOKENS = 20
WINDOW = 512  # tokens whose segments are held at a time
SAMPLE_ISLANDS = 240
EPOCHS = 12
MARGIN = 2.0  # log-odds by which a typed span has to beat leaving it out

#: A run without spaces that holds a digit or an @, and the runs with a digit that follow it after one space. It
#: starts at the start of a run and gives nothing back, so that a long run without any is read once.
ISLAND = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9]*+[0-9]\S*+)*+")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|[^\s]")
N_FEATURES = 15


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base matches, by start, then kind."""
    out = [(s, e, 0) for s, e in emails(text)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text)
            if all(len(p) < 400 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() <= 40 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted((s, e, k) for s, e, k in out)


def islands(text: str) -> Iterator[tuple[int, str]]:
    """Stretches that could hold an entity: an @, three dots among digits, or ten digits and more."""
    for m in ISLAND.finditer(text):
        part = m[0]
        if "@" in part:
            yield m.start(), part
            continue
        n = sum("0" <= c <= "9" for c in part)
        if n >= 10 or (n >= 4 and part.count(".") >= 3):
            yield m.start(), part


def tokens_of(island: str) -> tuple[list[tuple[int, int]], list[str]]:
    """Spans of the tokens, and the kind of each: digits, letters, space or the character itself."""
    tokens = [m.span() for m in TOKEN.finditer(island)]
    return tokens, ["d" if "0" <= island[s] <= "9" else "a" if island[s].isalpha() else " " if island[s].isspace() else island[s]
                    for s, _ in tokens]


def segments(island: str, tokens: list[tuple[int, int]], kinds: list[str], lo: int = 0,
             hi: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Candidate segments (first token, end token) that start in tokens lo to hi, and the features of each."""
    spots, rows = [], []
    for i in range(lo, len(tokens) if hi is None else min(hi, len(tokens))):
        first, n = kinds[i], 0
        if first not in "da+(":
            continue
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            if kinds[j - 1] == "d":
                n += tokens[j - 1][1] - tokens[j - 1][0]
            if kinds[j - 1] not in "da":
                continue
            shape = kinds[i:j]
            ats, dots = shape.count("@"), shape.count(".")
            if not (ats or n >= 10 or (n >= 4 and dots >= 3)):
                continue
            # a long segment is only read where its text decides
            text = island[tokens[i][0]:tokens[j - 1][1]] if ats == 1 or dots == 3 or 14 <= n <= 19 else ""
            local, _, domain = text.partition("@") if ats == 1 else ("", "", "")
            dotted = text.split(".") if dots == 3 else []
            quad = len(dotted) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in dotted)
            plain = all(c in "d -" for c in shape)
            spaced = " " in shape
            before = kinds[i - 1] if i else ""
            after = kinds[j] if j < len(kinds) else ""
            rows.append((
                1.0,
                float(ats == 1 and bool(local) and not spaced and bool(DOMAIN.fullmatch(domain))),
                float(ats == 1 and domain.rpartition(".")[2].isalpha() and "." in domain),
                float(quad),
                float(plain and 14 <= n <= 19),
                float(plain and 14 <= n <= 19 and luhn(_digits(text))),
                float(first == "+"),
                float(first in "+(" and 10 <= n <= 15 and all(c in "d +().-" for c in shape)),
                float("(" in shape or "-" in shape),
                float(spaced),
                float("a" in shape),
                float(ats > 1 or shape.count("(") != shape.count(")")),
                float(before in ("d", "a", "+", ".", "-", "@", "(", "_", "%") and before != ""),
                float(after in ("d", "a", "@", "-", "_") and after != ""),
                (j - i) / MAX_TOKENS))
            spots.append((i, j))
    return np.array(spots, int).reshape(-1, 2), np.array(rows, float).reshape(-1, N_FEATURES)


def marginals(n: int, spots: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, float]:
    """Probability of each typed segment, and the log partition; a token left out scores 0."""
    exits = [[] for _ in range(n + 1)]
    best = np.logaddexp.reduce(scores, axis=1) if len(spots) else np.zeros(0)
    for k, (i, j) in enumerate(spots):
        exits[i].append((j, best[k]))
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0.0
    for i in range(n):
        alpha[i + 1] = np.logaddexp(alpha[i + 1], alpha[i])
        for j, x in exits[i]:
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + x)
    for i in range(n - 1, -1, -1):
        beta[i] = beta[i + 1]
        for j, x in exits[i]:
            beta[i] = np.logaddexp(beta[i], beta[j] + x)
    if not len(spots):
        return np.zeros((0, len(KINDS))), alpha[n]
    return np.exp(alpha[spots[:, 0]][:, None] + scores + beta[spots[:, 1]][:, None] - alpha[n]), alpha[n]


def viterbi(n: int, parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """The best (first token, end token, kind) segments; leaving tokens out wins ties.

    `parts` has segments and their scores by kind, in order of the first token, a window of tokens
    at a time.
    """
    value, start, kind = np.full(n + 1, -np.inf), np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int8)
    value[0], at = 0.0, 0

    def leave_out(to: int) -> None:
        nonlocal at
        while at < to:
            if value[at] >= value[at + 1]:
                value[at + 1], start[at + 1], kind[at + 1] = value[at], at, -1
            at += 1

    for spots, scores in parts:
        best = scores.argmax(axis=1)
        for (i, j), row, t in zip(spots.tolist(), scores, best.tolist(), strict=True):
            leave_out(i)
            if at == i and value[i] >= value[i + 1]:
                value[i + 1], start[i + 1], kind[i + 1] = value[i], i, -1
            if value[i] + row[t] > value[j]:
                value[j], start[j], kind[j] = value[i] + row[t], i, t
    leave_out(n)
    out, at = [], n
    while at:
        if kind[at] >= 0:
            out.append((int(start[at]), at, int(kind[at])))
        at = int(start[at])
    return out[::-1]


def train(examples: list[str], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (features x kinds) by gradient ascent on the likelihood of the base matches."""
    prepared = []
    for text in examples:
        tokens, kinds = tokens_of(text)
        spots, feats = segments(text, tokens, kinds)
        gold = np.zeros((len(spots), len(KINDS)))
        starts, ends = {s: i for i, (s, _) in enumerate(tokens)}, {e: i + 1 for i, (_, e) in enumerate(tokens)}
        place = {tuple(x): k for k, x in enumerate(spots.tolist())}
        last = 0
        for s, e, kind in base_spans(text):
            k = place.get((starts.get(s), ends.get(e)))
            if k is not None and s >= last:
                gold[k, kind], last = 1.0, e
        if len(spots):
            prepared.append((len(tokens), spots, feats, gold))
    weights, squares = np.zeros((N_FEATURES, len(KINDS))), np.full((N_FEATURES, len(KINDS)), 1e-3)
    weights[0] = -2.0
    for _ in range(epochs):
        for n, spots, feats, gold in prepared:
            chance, _ = marginals(n, spots, feats @ weights)
            slope = feats.T @ (gold - chance) - 1e-4 * weights
            squares += slope * slope
            weights += 0.5 * slope / np.sqrt(squares)
    return weights


def fit(docs: DataFrame, text: str = "text", sample_islands: int = SAMPLE_ISLANDS) -> np.ndarray:
    """Fit the weights to stretches of a bounded sample of texts that hold digits or an @.

    The sample is the `sample_islands` candidate stretches with the least hashes, of up to 300
    characters; what is fitted is a table of fixed size. Everything else covers all data.
    """
    likely = docs.select(F.col(text).alias("t")).where(F.col("t").rlike(r"@|[0-9]{4}"))

    @F.arrow_udf("array<string>")
    def stretches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[p for _, p in islands(x.as_py() or "") if len(p) <= 300] for x in batch], pa.list_(pa.string()))

    parts = likely.select(F.explode(stretches("t")).alias("p"))
    rows = parts.distinct().orderBy(F.xxhash64("p"), "p").limit(sample_islands).collect()
    return train([r.p for r in rows])


def added_spans(text: str, weights: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the model that no base span touches."""
    out, b = [], 0
    reach = np.maximum.accumulate([e for _, e, _ in base]).tolist() if base else []  # greatest end up to each base span
    for at, part in islands(text):
        tokens, kinds = tokens_of(part)
        windows = (segments(part, tokens, kinds, lo, lo + WINDOW) for lo in range(0, len(tokens), WINDOW))
        for i, j, kind in viterbi(len(tokens), ((spots, feats @ weights - MARGIN) for spots, feats in windows)):
            s, e = at + tokens[i][0], at + tokens[j - 1][1]
            # both lists go by start: base spans before b start before e
            while b < len(base) and base[b][0] < e:
                b += 1
            if not (b and reach[b - 1] > s):
                out.append((s, e, kind))
    return out


def find(docs: DataFrame, weights: np.ndarray, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add `spans`, an array of (start, end, kind, base), by start, then kind as listed.

    Positions count code points of the whole text; null texts are empty. Rows are neither dropped
    nor shuffled; an existing column of that name is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("array<struct<start:int,end:int,kind:string,base:boolean>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = held.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))
        for batch in batches:
            rows = []
            for x in batch:
                t = x.as_py() or ""
                base = base_spans(t)
                found = [(*b, True) for b in base] + [(*a, False) for a in added_spans(t, w, base)]
                rows.append([{"start": s, "end": e, "kind": KINDS[k], "base": b} for s, e, k, b in sorted(found, key=lambda f: (f[0], f[2]))])
            yield pa.array(rows, kind)

    return docs.withColumn(spans, run(F.col(text)))
