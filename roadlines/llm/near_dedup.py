"""Op 7. Near-duplicate documents by circulant MinHash.

Two permutations give a whole signature: the first scatters the shingle hashes over a ring of
2^32 places, the second, shifted around the ring once per coordinate, ranks them. Bands of the
signature propose pairs, full shingle sets confirm them, and linked documents form components.

With BANDS x ROWS = 60 x 6 a pair of similarity 0.75 misses all bands with a chance of 8e-6.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlines.llm.common import key_of, unused
from roadlines.session import cut, cut_at, drop_cuts

WORDS = 5
BANDS, ROWS = 60, 6
PERCENT = 75
MEETING = 1000  # members of a bucket that another member meets in one place
PARTS = 64  # parts of the hashes that overlaps are bounded by
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
TEXTS = 256  # texts whose sets are in a worker's memory at a time
CHUNK = 1 << 14  # shingles that are ranked at a time, so that they stay in the processor's cache


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One random number for each byte value and place parity keep word hashes from adding up alike.
BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text, A-Z lower-cased, in order."""
    data = np.frombuffer(raw.lower(), np.uint8)
    inside = ~SPACES[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    places = np.cumsum(inside) - 1  # running number of each byte among the word bytes
    sizes = ends - starts
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    within = (places[inside] - np.repeat(firsts, sizes)).astype(np.uint64)
    values = _mix(BYTES[data[inside]] + within * np.uint64(0xD1B54A32D192ED03))
    return _mix(np.add.reduceat(values, firsts) + sizes.astype(np.uint64))


def shingle_set(raw: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of `size`-word shingles; fewer words are one shingle, none give none."""
    words = word_hashes(raw)
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    total = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        total = _mix(total * np.uint64(0x9FB21C651E98DF25) + words[j: n - width + 1 + j])
    return np.unique(total)


def _rank(places: np.ndarray, shift: int, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The second permutation at `places` shifted by `shift`; every step can be undone mod 2^32."""
    np.add(places, np.uint32(shift), out=out)
    np.right_shift(out, np.uint32(16), out=spare)
    np.bitwise_xor(out, spare, out=out)
    np.multiply(out, np.uint32(0x85EBCA6B), out=out)
    np.right_shift(out, np.uint32(13), out=spare)
    np.bitwise_xor(out, spare, out=out)
    np.multiply(out, np.uint32(0xC2B2AE35), out=out)
    return out


def signatures(sets: list[np.ndarray], size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of non-empty sets: row i, coordinate k is the least rank at shift k."""
    result = np.empty((len(sets), size), np.uint32)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= CHUNK):
            n += len(sets[j])
            j += 1
        places = (_mix(np.concatenate(sets[i:j]) ^ np.uint64(0x243F6A8885A308D3)) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *[len(s) for s in sets[i:j - 1]]])
        out, spare = np.empty_like(places), np.empty_like(places)
        step = (1 << 32) // size
        for k in range(size):
            result[i:j, k] = np.minimum.reduceat(_rank(places, k * step, out, spare), starts)
        i = j
    return result


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band: equal only for equal coordinates of the same band."""
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signature), bands)).copy()
    for j in range(rows):
        total = _mix(total * np.uint64(0x9FB21C651E98DF25) + signature[:, j::rows][:, :bands].astype(np.uint64))
    return total


def _lists(values: np.ndarray, counts: list[int]) -> pa.Array:
    ends = np.cumsum([0, *counts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.uint64).view(np.int64)))


def shingled(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `s`: the sorted distinct shingle hashes of the whole text, 64 bits each.

    A few texts at a time are in memory as sets, and go to Spark.
    """
    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for i in range(0, len(batch), TEXTS):
                sets = [shingle_set((x.as_py() or "").encode()) for x in batch[i:i + TEXTS]]
                yield _lists(np.concatenate(sets), [len(s) for s in sets])

    return docs.withColumn("s", run(F.col(text)))


def signed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `sig`: (n, a, b, bands): set size, 128-bit digest of the set, band keys (none if empty)."""
    kind = "struct<n:bigint,a:bigint,b:bigint,bands:array<bigint>>"

    def signs(sets: list[np.ndarray]) -> pa.StructArray:
        full = [s for s in sets if len(s)]
        bands = iter(band_keys(signatures(full))) if full else iter(())
        rows = [next(bands) if len(s) else s for s in sets]
        digest = lambda c: pa.array(np.array(
            [np.add.reduce(_mix(s ^ np.uint64(c))) for s in sets], np.uint64).view(np.int64))
        return pa.StructArray.from_arrays([
            pa.array([len(s) for s in sets], pa.int64()), digest(0x452821E638D01377), digest(0x13198A2E03707344),
            _lists(np.concatenate(rows), [len(r) for r in rows])],
            ["n", "a", "b", "bands"])

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for i in range(0, len(batch), TEXTS):
                yield signs([shingle_set((x.as_py() or "").encode()) for x in batch[i:i + TEXTS]])

    return docs.withColumn("sig", run(F.col(text)))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the least node id that each of `nodes` (id) reaches over `edges` (u, v).

    In each round a label takes the least label across an edge, chains of such hooks are halved
    twice, and nodes and edges move to the new labels. Only edges whose ends still differ go on.
    Each round is written to the shared folder, and dropped once the next one is written.
    """
    spark, read = nodes.sparkSession, []
    roots, at_roots = nodes.select("id", F.col("id").alias("root")), None
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    while True:
        edges, at_edges = cut_at(edges.where(F.col("u") != F.col("v")).distinct())
        drop_cuts(spark, *read)
        if edges.isEmpty():
            drop_cuts(spark, at_edges)
            return roots
        hooks = edges.groupBy("u").agg(F.min("v").alias("up")).withColumnRenamed("u", "at")
        for _ in range(2):
            above = hooks.select(F.col("at").alias("up"), F.col("up").alias("_top"))
            hooks = hooks.join(above, "up", "left").select("at", F.coalesce("_top", "up").alias("up"))
        hooks, at_hooks = cut_at(hooks)

        def moved(df: DataFrame, name: str, to=hooks) -> DataFrame:
            return df.join(to.withColumnRenamed("at", name), name, "left").withColumn(
                name, F.coalesce("up", name)).drop("up")

        edges = moved(moved(edges, "u"), "v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        before = [at_roots] if at_roots else []
        roots, at_roots = cut_at(moved(roots, "root").select("id", "root"))
        read = [at_edges, at_hooks, *before]


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The `pairs` (u, v) whose full sets share enough; `sets` has id and s."""
    a = sets.select(F.col("id").alias("u"), F.col("s").alias("su"))
    b = sets.select(F.col("id").alias("v"), F.col("s").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    return pairs.join(a, "u").join(b, "v").where(
        100 * both >= percent * (F.size("su") + F.size("sv") - both)).select("u", "v")


def may_reach(n: Column, c: Column, p: Column, m: Column, d: Column, q: Column, percent: int = PERCENT) -> Column:
    """Sets of n and m elements can be this similar at all.

    Of these c and d can be in common, p and q by part of the hashes. An overlap is no larger than
    the sum of the lesser counts of each part.
    """
    def reaches(most: Column) -> Column:
        return 100 * most >= percent * (n + m - most)

    by_part = F.aggregate(F.zip_with(p, q, lambda x, y: F.least(x, y)), F.lit(0).cast("bigint"), lambda t, x: t + x)
    return F.when(reaches(F.least(c, d)), reaches(by_part)).otherwise(F.lit(False))


def size_level(n: Column, percent: int = PERCENT) -> Column:
    """Sets that can be this similar have sizes of the same or of neighbouring levels.

    A level is a little wider than the largest ratio of such sizes, which leaves rounding no room.
    """
    return F.floor(F.log(n.cast("double")) / math.log(100 / percent * 1.005)).cast("int")


def with_common(rows: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`rows` (id, n) with c and parts: how many shingles another class of `rows` has too, by part.

    Shingles that one class alone holds are in no intersection, so these counts bound every
    overlap. Classes that no overlap of this size could link go. Work is linear in the shingles,
    whatever the groups.
    """
    ids = rows.select("id").distinct()
    own = sets.join(ids, "id", "left_semi")
    lone = (
        own.select("id", F.explode("s").alias("h"))
        .groupBy("h").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("id")).where(F.col("_n") == 1)
        .groupBy("id").agg(F.collect_list("h").alias("_lone")))
    left = own.join(lone, "id", "left").select("id", F.explode(
        F.when(F.col("_lone").isNull(), F.col("s")).otherwise(F.array_except("s", "_lone"))).alias("h"))
    counts = (
        left.groupBy("id", F.pmod("h", F.lit(PARTS)).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("k"))
        .groupBy("id").agg(F.sum("k").alias("c"), F.map_from_entries(F.collect_list(F.struct("p", "k"))).alias("_k"))
        .select("id", "c", F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.coalesce(
            F.try_element_at("_k", i), F.lit(0).cast("bigint"))).alias("parts")))
    return rows.join(counts, "id").where(100 * F.col("c") >= percent * F.col("n"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for each row of `docs`.

    Documents with equal shingle sets are one class, of which only one member goes on. Within a
    bucket of a band, each member is compared with the bucket's first, which is linear. Then only
    buckets that hold several components are left; in these, members outside the bucket's largest
    component are compared with the members of other components, so no candidate link between
    components stays unlooked at, while a bucket of one component, however large, costs nothing.
    Only sets of neighbouring sizes meet there, and a large bucket is spread: its members lie in
    one place for each MEETING of them, to which the members outside are copied.
    Texts without words (null, empty) have no shingles and link with nothing. Repeated rows are
    exact copies: each row comes back, and rows with the component's id are kept. Rows without an
    id join a component but cannot name it, and are kept only in a component without any id.
    """
    signs = cut(signed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text")
                .select("doc_id", F.xxhash64("_text").alias("text_hash"), "sig.*"))
    of_class = ["n", "a", "b"]
    classes = cut(
        signs.where(F.col("n") > 0).groupBy(*of_class).agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
        .withColumn("id", F.monotonically_increasing_id()))
    members = classes.select("id", "n", F.posexplode("bands").alias("band", "key"))
    buckets = members.groupBy("band", "key").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    shared = cut(members.join(buckets, ["band", "key"]))
    needed = shared.select("id").distinct()
    # the sets of the classes with a neighbour, from the text of one member
    member = signs.join(classes.join(needed, "id").select(*of_class, "id", "least"), of_class)
    texts = docs.select(key_of(doc_id).alias("_key"), F.xxhash64(text).alias("_th"), F.col(text).alias("_text"))
    owners = member.groupBy("id", "n").agg(F.min(F.struct(key_of("doc_id").alias("_key"), F.col("text_hash").alias("_th")))
                                           .alias("_one")).select("id", "n", "_one.*")
    # the shingled text depends on both sides of the join, so that only texts that are needed are
    # shingled, and texts and not sets are moved
    wanted = texts.join(owners, ["_key", "_th"]).withColumn("_text", F.when(F.col("n") > 0, F.col("_text")))
    sets, at_sets = cut_at(
        shingled(wanted, "_text").where(F.size("s") == F.col("n"))
        .groupBy("id").agg(F.min("s").alias("s")))
    stars = shared.where(F.col("id") != F.col("first")).select(F.col("first").alias("u"), F.col("id").alias("v"))
    links, at_links = cut_at(confirmed(stars.distinct(), sets))
    roots = components(needed, links)

    rooted = shared.select("band", "key", "id", "n").join(roots, "id")
    counts = rooted.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("c"))
    mixed = counts.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("roots"), F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("size")).where(
        F.col("roots") > 1).select("band", "key", F.col("top.root").alias("top"),
                                   F.ceil(F.col("size") / MEETING).cast("int").alias("places"))
    rooted_mixed, at_mixed = cut_at(rooted.join(mixed, ["band", "key"]))
    rest, at_rest = cut_at(with_common(rooted_mixed, sets).withColumns({
        "level": size_level(F.col("n")), "place": F.pmod(F.xxhash64("id"), F.col("places")).cast("int")}))
    drop_cuts(docs.sparkSession, at_mixed, at_links)
    minor = rest.where(F.col("root") != F.col("top")).withColumn(
        "place", F.explode(F.sequence(F.lit(0), F.col("places") - 1))).select(
        "band", "key", "place", F.explode(F.sequence(F.col("level") - 1, F.col("level") + 1)).alias("level"),
        F.col("id").alias("mid"), F.col("n").alias("mn"), F.col("c").alias("mc"), F.col("parts").alias("mparts"),
        F.col("root").alias("mroot"))
    others = rest.join(minor, ["band", "key", "level", "place"]).where((F.col("root") != F.col("mroot")) & may_reach(
        F.col("n"), F.col("c"), F.col("parts"), F.col("mn"), F.col("mc"), F.col("mparts")))
    across = others.select(F.least("id", "mid").alias("u"), F.greatest("id", "mid").alias("v")).distinct()
    more = confirmed(across, sets).join(roots.select(F.col("id").alias("u"), F.col("root").alias("ru")), "u").join(
        roots.select(F.col("id").alias("v"), F.col("root").alias("rv")), "v")
    upper = components(roots.select(F.col("root").alias("id")).distinct(),
                       more.select(F.col("ru").alias("u"), F.col("rv").alias("v")))
    drop_cuts(docs.sparkSession, at_sets, at_rest)  # the links are in the components now
    final = roots.join(upper.select(F.col("id").alias("root"), F.col("root").alias("top")), "root").select("id", "top")

    labelled = classes.join(final, "id", "left").select(
        *of_class, "least", F.coalesce("top", "id").alias("top"))
    names = labelled.groupBy("top").agg(F.min("least").alias("component_id"))
    named = labelled.join(names, "top").select(*of_class, "component_id")
    linked = signs.drop("bands").join(named, of_class, "left")
    return linked.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component_id", "doc_id")).alias("kept"), "text_hash")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each component: the one of the least id, repeated rows only once.

    Of rows without an id in a component without any id, each different text stays.
    """
    key, th = unused(docs, "_key"), unused(docs, "_th")
    kept = near_duplicates(docs, doc_id, text).where("kept").select(
        key_of("doc_id").alias(key), F.col("text_hash").alias(th)).distinct()
    keyed = docs.withColumns({key: key_of(doc_id), th: F.xxhash64(text)})
    return keyed.join(kept, [key, th], "left_semi").dropDuplicates([key, th]).drop(key, th)
