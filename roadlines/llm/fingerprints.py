"""Op 8. Bottom-k sketches of five-word shingle hashes.

A sketch is the ascending array of the k smallest distinct 64-bit shingle hashes of a text.
Sketches of parts merge into the sketch of the whole, and give resemblance, containment and the
number of distinct shingles. Native: no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlines.llm.common import key_of, text_or_empty
from roadlines.session import cut, shuffle_width

K = 64
WORDS = 5


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def sketch(words: Column, k: int = K, size: int = WORDS) -> Column:
    """Bottom-k sketch of a word array: fewer than `size` words are one shingle, none give []."""
    def shingles(w: Column) -> Column:
        n = F.size(w)
        return F.when(n >= size, F.transform(
            F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
        ).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return F.slice(F.sort_array(F.array_distinct(bind(words, shingles))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; exact where both hold all their hashes. Two empty texts: 1."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too. An empty a is contained in all: 1."""
    common = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), common / distinct_count(a, k)))


def render(a: Column) -> Column:
    """A sketch as text: 16 hex digits for each hash, in the sketch's order."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def next_documents(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(_key, next_key) by descending id, the last followed by the first; null ids come last.

    Ids are range-partitioned and numbered within slices; one row per slice links the slices.
    Rows with the same id count once.
    """
    ids = docs.select(F.col(doc_id).alias("_id"), key_of(doc_id).alias("_key")).distinct()
    order = F.col("_id").desc_nulls_last()
    ranged = cut(ids.repartitionByRange(shuffle_width(docs.sparkSession), order)
                 .withColumn("_slice", F.spark_partition_id()))
    heads = ranged.groupBy("_slice").agg(
        F.coalesce(F.max_by("_key", "_id"), F.max("_key")).alias("_head"))
    slices = Window.orderBy("_slice")
    whole = slices.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    links = heads.select("_slice", F.coalesce(
        F.lead("_head").over(slices), F.first("_head").over(whole)).alias("_after"))
    within = ranged.withColumn("_lead", F.lead("_key").over(Window.partitionBy("_slice").orderBy(order)))
    return within.join(links, "_slice").select(
        "_key", F.coalesce("_lead", "_after").alias("next_key"))


def fingerprint_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                          k: int = K) -> DataFrame:
    """Per row: sketches of its text, of its edited text and of the next document's text.

    The edited text is the text with its last floor(n/2) code points replaced by the first as
    many of the next document. Null texts are empty. Ids that several rows share have the least
    of their texts as the one that a predecessor sees; every row stays. Texts move once by their
    own id and, cut to the half that is needed, once to the row before them.
    """
    own = docs.select(key_of(doc_id).alias("_key"), text_or_empty(text).alias("_text")).withColumn(
        "_sketch", sketch(words_of(F.col("_text")), k))
    follow = next_documents(docs, doc_id)
    sizes = docs.groupBy(key_of(doc_id).alias("_key")).agg(
        F.max(F.char_length(text_or_empty(text))).alias("_n"))
    # for each document, which one stands before it and how much that one takes at most
    before = follow.join(sizes, "_key").select(
        F.col("next_key").alias("_key"), F.col("_key").alias("_taker"),
        F.floor(F.col("_n") / 2).cast("int").alias("_takes"))
    given = (
        own.join(before, "_key")
        .select(F.col("_taker").alias("_key"), F.struct(
            F.expr("substring(_text, 1, _takes)").alias("t"),
            F.col("_sketch").alias("s")).alias("_given"))
        .groupBy("_key").agg(F.min("_given").alias("_given")))
    # both uses of `own` have the same columns, so that its texts are sketched and moved once
    edited = (
        own.join(given, "_key").withColumn("n_chars", F.char_length("_text").cast("long"))
        .withColumn("_half", F.floor(F.col("n_chars") / 2).cast("int"))
        .withColumn("edited", F.concat(
            F.expr("substring(_text, 1, cast(n_chars - _half AS int))"),
            F.expr("substring(_given.t, 1, _half)"))))
    kind = docs.schema[doc_id].dataType
    return edited.select(
        F.nullif("_key", F.lit("-")).cast(kind).alias("doc_id"), "n_chars", "edited",
        F.col("_sketch").alias("sketch"), sketch(words_of(F.col("edited")), k).alias("edited_sketch"),
        F.col("_given.s").alias("next_sketch"))
