"""Op 4. Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's likelihood
is the sum over all its segmentations into pieces, by the forward algorithm; a text's is the
product over its words. The probabilities are learned by expectation maximisation: forward and
backward sums give each piece's expected count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlines.llm.common import unused
from roadlines.session import cut

#: Labelled rows that the model is fitted on, for each language (expected number, drawn by a hash).
SAMPLE_ROWS = 1500
ROUNDS = 3
SMOOTHING = 0.05
UNKNOWN = 1e-7  # of a character that no piece holds
SCALE = 50.0  # factor per character, the same for all languages, that keeps products in range
PLACES = 200_000  # in words, times piece sizes, that are looked at together
CHARACTERS = 0x110000
TEXTS = 64  # whose words are looked up at a time
TOKENS = 4096  # whose scores are added at a time
CACHED_BYTES = 64_000_000  # of words and scores that a task keeps
WORD_BYTES = 150  # of a cached word beside its letters and scores
WORDS = regex.compile(r"\p{L}+")
UNDETERMINED = "und"


class Pieces:
    """Piece ids by prefix: a node for each prefix of a piece, and the steps from node to node by a character."""

    def __init__(self, pieces: tuple[str, ...]) -> None:
        nodes = {"": 0}
        for piece in pieces:
            for size in range(1, len(piece) + 1):
                nodes.setdefault(piece[:size], len(nodes))
        steps = np.array([nodes[p[:-1]] * CHARACTERS + ord(p[-1]) for p in nodes if p], np.int64)
        order = np.argsort(steps)
        self.steps = np.append(steps[order], np.iinfo(np.int64).max)  # no step is beyond the last
        self.ends = np.append(order + 1, 0)
        self.unknown, self.none = len(pieces), len(pieces) + 1
        self.ids = np.full(len(nodes), self.none, np.int64)
        self.ids[[nodes[p] for p in pieces]] = range(len(pieces))

    def __len__(self) -> int:
        return self.unknown

    def found(self, letters: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size the flat places in `letters` (characters x words) where a piece starts, and its id.

        All words advance together. Single characters that are no piece count as unknown; 0 ends a word.
        """
        flat, words = letters.ravel(), letters.shape[1]
        at = np.flatnonzero(flat)
        node = np.zeros(len(at), np.int64)
        for size in range(1, longest + 1):
            end = at + (size - 1) * words
            if size > 1:
                inside = end < len(flat)
                at, node, end = at[inside], node[inside], end[inside]
            step = node * CHARACTERS + flat[end]
            place = np.searchsorted(self.steps, step)
            known = self.steps[place] == step
            if size == 1:
                ids = self.ids[np.where(known, self.ends[place], 0)]
                yield size, at, np.where(ids == self.none, self.unknown, ids)
            at, node = at[known], self.ends[place[known]]
            if size > 1:
                ids = self.ids[node]
                yield size, at[ids != self.none], ids[ids != self.none]
            if not len(at):
                return


class Numbers(dict[str, int]):
    """Words numbered in the order in which they are first asked for; `fresh` holds those not scored yet."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    pieces: tuple[str, ...]
    probabilities: np.ndarray  # pieces x languages

    def table(self) -> tuple[Pieces, np.ndarray, int]:
        """Piece ids, and probabilities with a row for unknown characters and one for no piece."""
        sizes = np.array([len(p) for p in self.pieces], float)
        scaled = self.probabilities * (SCALE ** sizes)[:, None]
        rest = np.array([[UNKNOWN * SCALE], [0.0]]) * np.ones((1, scaled.shape[1]))
        return Pieces(self.pieces), np.vstack([scaled, rest]), max(map(len, self.pieces), default=1)


def vocabulary_pieces(model_file: str) -> tuple[str, ...]:
    """The vocabulary's pieces that are made of letters, with and without the word-start sign."""
    import sentencepiece

    spp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found = (spp.id_to_piece(i) for i in range(spp.get_piece_size()))
    return tuple(sorted({p for p in found if p.strip("▁").isalpha() and "▁" not in p[1:]} | {"▁"}))


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def letters_of(words: list[str]) -> np.ndarray:
    """letters[i, w]: code points of words in columns, filled up with 0."""
    n = max(map(len, words))
    joined = "".join(w.ljust(n, "\0") for w in words).encode("utf-32-le", "surrogatepass")
    return np.ascontiguousarray(np.frombuffer(joined, np.uint32).reshape(len(words), n).T).astype(np.int64)


def piece_ids(words: list[str], ids: Pieces, longest: int) -> np.ndarray:
    """ids[w, start, size - 1] for words of one length; unknown single characters have their own id."""
    out = np.full((len(words), len(words[0]), longest), ids.none, np.int32)
    for size, at, found in ids.found(letters_of(words), longest):
        start, w = np.divmod(at, len(words))
        out[w, start, size - 1] = found
    return out


def forward(letters: np.ndarray, sizes: np.ndarray, ids: Pieces, table: np.ndarray, longest: int) -> np.ndarray:
    """Log of the sum over all segmentations of each word, by language, times SCALE per character.

    Words stand in the columns of `letters`, the longest first. alpha[j] sums the segmentations of the
    first j characters; only pieces that stand there are looked at, those of some columns of characters
    at a time. What the next sums look back to is rescaled now and then, for each language on its own,
    so that very long words don't underflow.
    """
    n, w = letters.shape
    alpha = np.zeros((n + 1, w, table.shape[1]))
    alpha[0] = 1.0
    sums = alpha.reshape((n + 1) * w, -1)
    logs = np.zeros((w, table.shape[1]))
    columns = max(1, PLACES // (w * longest))
    for first in range(0, n, columns):
        last, back = min(n, first + columns), max(0, first + 1 - longest)
        # larger pieces first, as they start before the others that end at the same place
        found = [(size, at + back * w, piece) for size, at, piece in ids.found(letters[back:last], longest)][::-1]
        starts, pieces = (np.concatenate([f[k] for f in found]) for k in (1, 2))
        ends = np.concatenate([at + size * w for size, at, _ in found])
        order = np.argsort(ends, kind="stable")
        order = order[np.searchsorted(ends, (first + 1) * w, sorter=order):]
        starts, ends, pieces = starts[order], ends[order], pieces[order]
        groups = np.flatnonzero(np.diff(ends, prepend=-1))  # every place in a word has a piece that ends there
        bounds = np.searchsorted(ends[groups], np.arange(first + 1, last + 2) * w).tolist()
        groups = np.append(groups, len(ends))
        for j, low, high in zip(range(first + 1, last + 1), bounds, bounds[1:], strict=False):
            active = high - low
            if j % longest == 0:
                near = alpha[max(0, j - longest):j, :active]
                top = np.maximum(near.max(axis=0), 1e-300)
                near /= top
                logs[:active] += np.log(top)
            s, e = groups[low], groups[high]
            alpha[j, :active] = np.add.reduceat(sums[starts[s:e]] * table[pieces[s:e]], groups[low:high] - s, axis=0)
    return np.log(np.maximum(alpha[sizes, np.arange(w)], 1e-300)) + logs


def score_words(words: list[str], ids: Pieces, table: np.ndarray, longest: int) -> np.ndarray:
    """Log-likelihood of each word under each language."""
    out = np.empty((len(words), table.shape[1]))
    order = sorted(range(len(words)), key=lambda k: -len(words[k]))
    s = 0
    while s < len(order):
        part = order[s:s + max(1, PLACES // ((len(words[order[s]]) + 1) * longest))]
        sizes = np.array([len(words[k]) + 1 for k in part])
        found = forward(letters_of(["▁" + words[k] for k in part]), sizes, ids, table, longest)
        out[part] = found - sizes[:, None] * np.log(SCALE)
        s += len(part)
    return out


def expected_counts(words: list[str], counts: np.ndarray, ids: Pieces, column: np.ndarray,
                    longest: int) -> np.ndarray:
    """Expected number of each piece in words that occur `counts` times, for one language."""
    total = np.zeros(len(column))
    by_size: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        by_size.setdefault(len(word) + 1, []).append(k)
    for n, places in by_size.items():
        step = max(1, PLACES // (n * longest))
        for s in range(0, len(places), step):
            part = places[s:s + step]
            found = piece_ids(["▁" + words[k] for k in part], ids, longest)
            p = column[found]  # words x start x size
            alpha = np.zeros((n + 1, len(part)))
            beta = np.zeros((n + 1, len(part)))
            alpha[0] = beta[n] = 1.0
            for j in range(1, n + 1):
                for i in range(max(0, j - longest), j):
                    alpha[j] += alpha[i] * p[:, i, j - i - 1]
            for i in range(n - 1, -1, -1):
                for j in range(i + 1, min(n, i + longest) + 1):
                    beta[i] += p[:, i, j - i - 1] * beta[j]
            weight = counts[part] / np.maximum(alpha[n], 1e-300)
            for i in range(n):
                for j in range(i + 1, min(n, i + longest) + 1):
                    np.add.at(total, found[:, i, j - i - 1], alpha[i] * p[:, i, j - i - 1] * beta[j] * weight)
    return total


def labelled(docs: DataFrame, doc_id: str, held_out: int = 5) -> DataFrame:
    """`docs` with held_out added: crc32 of the id as text leaves 0 when divided by 5. A null id has none."""
    return docs.withColumn("held_out", F.coalesce(
        F.crc32(F.col(doc_id).cast("string").cast("binary")) % held_out == 0, F.lit(False)))


def fit(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        sample_rows: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Model:
    """Learn from rows that are not held out and have a language.

    About `sample_rows` whole texts of each language are drawn by a hash of their id. Their words
    are counted in Spark, and every round sums expected counts there; what comes to the driver is
    a number for each vocabulary piece and language. A word of over 200 letters counts as several.
    """
    spark = docs.sparkSession
    pieces = vocabulary_pieces(model_file)
    usable = labelled(docs, doc_id).where(~F.col("held_out") & F.col(lang).isNotNull()).select(
        F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    sizes = {r["_lang"]: r["n"] for r in usable.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), pieces, np.zeros((len(pieces), 0)))
    shares = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, sample_rows / sizes[k]))])
    place = F.pmod(F.xxhash64(F.lit(4), "_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = usable.where(place < shares[F.col("_lang")])
    order = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    words = F.regexp_extract_all(F.lower("_text"), F.lit(r"(\p{L}{1,200})"), F.lit(1))
    table = cut(
        sample.select(order[F.col("_lang")].alias("l"), F.explode(words).alias("word"))
        .groupBy("l", "word").agg(F.count(F.lit(1)).alias("n")))
    prior = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    for _ in range(rounds):
        model = spark.sparkContext.broadcast(Model(languages, pieces, prior))

        def expect(batches: Iterator[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            ids, probs, longest = model.value.table()
            sums = np.zeros_like(probs)
            for batch in batches:
                for k, part in batch.groupby("l"):
                    sums[:, k] += expected_counts(part["word"].tolist(), part["n"].to_numpy(float), ids,
                                                  np.ascontiguousarray(probs[:, k]), longest)
            at, of = np.nonzero(sums[: len(ids)])
            yield pd.DataFrame({"piece": at, "l": of, "c": sums[at, of]})

        found = table.mapInPandas(expect, "piece long, l long, c double").groupBy("piece", "l").agg(
            F.sum("c").alias("c")).toPandas()
        sums = np.full((len(pieces), len(languages)), SMOOTHING)
        sums[found["piece"].to_numpy(int), found["l"].to_numpy(int)] += found["c"].to_numpy(float)
        prior = sums / sums.sum(axis=0)
    return Model(languages, pieces, prior)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score, the posterior of the best language at equal priors.

    Only the text counts, the whole of it. A null text, one without a letter, or a model without
    languages gives `und` and score 0. Ties go to the language that comes first by name. Rows are
    never dropped or shuffled; existing columns of these names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids, table, longest = held.value.table()
        languages = held.value.languages
        known, scores = Numbers(), np.zeros((0, len(languages)))
        held_bytes = 0
        for batch in batches:
            totals: list[np.ndarray | None] = []
            for s in range(0, len(batch), TEXTS):
                # words of a few texts at a time: those of a whole batch would fill the memory
                if held_bytes > CACHED_BYTES:
                    known, scores, held_bytes = Numbers(), np.zeros((0, len(languages))), 0
                part = [[known[w] for w in words_of(x.as_py())] if languages else [] for x in batch[s:s + TEXTS]]
                fresh, known.fresh = known.fresh, []
                if fresh:
                    held_bytes += sum(map(len, fresh)) + (8 * len(languages) + WORD_BYTES) * len(fresh)
                    if len(known) > len(scores):
                        room = np.empty((2 * len(known), len(languages)))
                        room[: len(scores)] = scores
                        scores = room
                    scores[len(known) - len(fresh): len(known)] = score_words(fresh, ids, table, longest)
                for numbers in part:
                    totals.append(sum(scores[numbers[t:t + TOKENS]].sum(axis=0) for t in range(0, len(numbers), TOKENS))
                                  if numbers else None)
            langs, best = [], []
            for logs in totals:
                if logs is None:
                    langs.append(UNDETERMINED)
                    best.append(0.0)
                else:
                    k = int(np.argmax(logs))
                    langs.append(languages[k])
                    best.append(float(1.0 / np.exp(logs - logs[k]).sum()))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(best, pa.float64())], ["lang", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    said = unused(docs, "_said")
    return docs.withColumn(said, run(F.col(text))).select(
        *kept, F.col(said)["lang"].alias("lang_pred"), F.col(said)["score"].alias("score"))
