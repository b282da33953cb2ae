"""Op 10. Line de-duplication by a deletion-neighbourhood join.

Two lines are alike if one character is inserted, deleted or replaced between them at most. Equal
variants with one character left out meet in a join on hashed keys, the edit distance is
verified, and a line goes if an alike line stands earlier. Native: no Python runs on the executors.

A line of n characters has n variants, so emitting them for every line would cost the square of
its length. Deleting whole blocks narrows the choice first and loses no match: an edit at one
place lies in one block, and what stands before and after that block is equal in both lines.
First a line is cut in two blocks, then (if another line has the same rest) in blocks of 32
characters, and only inside blocks whose rest another line shares are single characters deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlines.llm.common import key_of, text_or_empty, unused
from roadlines.llm.fingerprints import bind
from roadlines.session import cut

MIN_CHARS = 1  # of lines that may go for an alike line
EXACT_CHARS = 1  # of lines that may go for the same line
BLOCK = 32
SALTS = 16


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _cut(line: Column, start: Column, length: Column) -> Column:
    """Characters from 0-based `start`; none for a length below 1."""
    return F.substring(line, start + 1, F.greatest(length, F.lit(0)))


def _rest_key(line: Column, n: Column, t: Column, size: Column, block: Column) -> Column:
    """Hash of a line without its `block`, as one of a pair whose longer line has `t` characters."""
    tail = t - (block + 1) * size
    return F.xxhash64(t, size, block, _cut(line, F.lit(0), block * size), _cut(line, n - tail, tail))


def _halves(line: Column, n: Column) -> Column:
    return F.array(*[_rest_key(line, n, t, F.floor((t + 1) / 2).cast("int"), F.lit(b))
                     for t in (n, n + 1) for b in (0, 1)])


def _shared(rows: DataFrame, key: str, line: str) -> DataFrame:
    """The rows whose `key` other lines have too; counted with partial sums, looked up salted."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(
        key, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return rows.withColumn("_salt", F.pmod(F.col(line), F.lit(SALTS)).cast("int")).join(
        counts, [key, "_salt"], "left_semi").drop("_salt")


def occurrences(docs: DataFrame, doc_id: str, text: str, min_chars: int, exact_chars: int) -> DataFrame:
    """(at, h1, h2, halves) of every line of the lesser length or more; `at` orders all lines.

    Lines under `min_chars` have no halves and so meet no alike lines. An empty line is one only
    if its length, 0, is asked for.
    """
    base = docs.select(F.col(doc_id).alias("_id"), text_or_empty(text).alias("_text"))
    lines = base.select("_id", F.xxhash64("_text").alias("th"),
                        F.posexplode(lines_of(F.col("_text"))).alias("pos", "line"))
    n = F.char_length("line")
    return lines.where(n >= F.least(F.lit(min_chars), F.lit(exact_chars))).select(
        F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"),
                              F.col("th"), F.col("pos")).alias("at"),
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
        F.when(n >= min_chars, _halves(F.col("line"), n)).alias("halves"))


def _place(at: str) -> list[Column]:
    """The keys of the text that `at` points into."""
    return [F.coalesce(F.col(f"{at}.id").cast("string"), F.lit("-")).alias("key"), F.col(f"{at}.th").alias("th")]


def near_lines(texts: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2, near): the earliest other line within one edit, for the lines that have one."""
    halves = distinct.select("h1", F.explode("halves").alias("half"))
    close = distinct.select("h1", "h2", "at").join(_shared(halves, "half", "h1").select("h1").distinct(), "h1")
    # texts of the lines left are read where they stand first
    wanted = close.groupBy(*_place("at")).agg(F.collect_list(F.struct("at", "h1", "h2")).alias("_wanted"))
    found = texts.join(wanted, ["key", "th"]).select(bind(
        lines_of(F.col("_text")), lambda ls: F.transform("_wanted", lambda w: F.struct(
            w["at"].alias("at"), w["h1"].alias("h1"), w["h2"].alias("h2"),
            F.get(ls, w["at"]["pos"]).alias("line")))).alias("_found"))
    rows = found.select(F.explode("_found").alias("x")).select("x.*")

    n = F.char_length("line")
    size = F.lit(BLOCK)
    blocks = rows.withColumns({"n": n, "t": F.explode(F.array(n, n + 1))}).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.floor((F.col("t") - 1) / BLOCK).cast("int"))))
    blocks = blocks.select(
        "h1", "h2", "at", (F.col("n") == F.col("t")).alias("longer"),
        _rest_key(F.col("line"), F.col("n"), F.col("t"), size, F.col("block")).alias("rest"),
        _cut(F.col("line"), F.col("block") * BLOCK,
             F.least(size, F.col("t") - F.col("block") * BLOCK) - (F.col("t") - F.col("n"))).alias("mid"))
    meeting = _shared(blocks, "rest", "h1")
    m = F.char_length("mid")
    variants = F.when(F.col("longer"), F.transform(
        F.sequence(F.lit(0), m - 1), lambda j: F.struct(j.alias("j"), F.xxhash64(
            F.concat(_cut(F.col("mid"), F.lit(0), j), _cut(F.col("mid"), j + 1, m - j - 1))).alias("v"))
    )).otherwise(F.array(F.struct(F.lit(-1).alias("j"), F.xxhash64("mid").alias("v"))))
    keyed = meeting.withColumn("_x", F.explode(variants)).select(
        "h1", "h2", "rest", "mid", F.col("_x.j").alias("j"), F.col("_x.v").alias("v"),
        F.struct("at", "mid", "h1", "h2").alias("me"))
    # A variant left at the same place joins replaced characters; a variant equal to a whole
    # shorter line joins inserted ones. Distinct lines bound both groups by alphabet and block.
    variant, place = Window.partitionBy("rest", "v"), Window.partitionBy("rest", "v", "j")
    left_out = F.col("j") >= 0
    met = keyed.withColumns({
        "_same": F.min("me").over(place), "_whole": F.min(F.when(~left_out, F.col("me"))).over(variant),
        "_cut": F.min(F.when(left_out, F.col("me"))).over(variant)})
    pairs = met.select("h1", "h2", "mid", F.explode(F.when(
        left_out, F.array("_same", "_whole")).otherwise(F.array("_cut"))).alias("first"))
    return (
        pairs.where((F.levenshtein("mid", F.col("first.mid"), 1) >= 0)
                    & ~((F.col("h1") == F.col("first.h1")) & (F.col("h2") == F.col("first.h2"))))
        .groupBy("h1", "h2").agg(F.min("first.at").alias("near")))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                        min_chars: int = MIN_CHARS, exact_chars: int = EXACT_CHARS) -> DataFrame:
    """`docs` with repeated lines taken out of `text`, and n_lines and n_removed added.

    Lines end at \\n. A line of `min_chars` characters or more goes if the same line, or one within
    one edit of it, stands earlier: at a smaller id (null ids last), or further up in the same
    text. Whether that earlier line goes itself doesn't matter. A line of `exact_chars` or more
    goes if the same line stands earlier. Both are at least 1: empty lines stay. Rows equal in
    id and text count as one row and all stay; rows that share only the id are ordered by a hash
    of the text. Null texts stay null. Every row stays, with all its other columns.
    """
    if min(min_chars, exact_chars) < 1:
        raise ValueError("lines that may go have a character at least")
    seen = occurrences(docs, doc_id, text, min_chars, exact_chars)
    distinct = cut(seen.groupBy("h1", "h2").agg(
        F.min("at").alias("at"), F.first("halves").alias("halves"), F.count(F.lit(1)).alias("n")))
    # Both uses of the texts have these columns, so that texts are moved once; other columns of
    # the documents come back at the end.
    texts = docs.select(key_of(doc_id).alias("key"), text_or_empty(text).alias("_text")).withColumn(
        "th", F.xxhash64("_text"))
    repeated = (
        distinct.where(F.col("n") > 1).select("h1", "h2", F.col("at").alias("earliest"))
        .unionByName(near_lines(texts, distinct).withColumnRenamed("near", "earliest"))
        .groupBy("h1", "h2").agg(F.min("earliest").alias("earliest"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    gone = (
        seen.select("at", "h1", "h2", F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int").alias("_salt"))
        .join(repeated, ["h1", "h2", "_salt"]).where(F.col("earliest") < F.col("at"))
        .groupBy(*_place("at")).agg(F.collect_set("at.pos").alias("_gone")))

    def rest(ls: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), "_gone")
        return F.array_join(F.transform(left, lambda i: F.get(ls, i)), "\n")

    breaks = F.char_length("_text") - F.char_length(F.replace("_text", F.lit("\n"), F.lit("")))
    hidden, place, digest, left = (unused(docs, c) for c in ("_null", "_key", "_th", "_text"))
    shortened = texts.join(gone, ["key", "th"], "left").select(
        F.col("key").alias(place), F.col("th").alias(digest),
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(bind(lines_of(F.col("_text")), rest)).alias(left),
        (breaks + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    ).dropDuplicates([place, digest])
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    others = docs.select(
        *[c for c in kept if c != text], F.col(text).isNull().alias(hidden),
        key_of(doc_id).alias(place), F.xxhash64(text_or_empty(text)).alias(digest))
    return others.join(shortened, [place, digest]).select(
        *[F.when(~F.col(hidden), F.col(left)).alias(text) if c == text else F.col(c) for c in kept],
        "n_lines", "n_removed")
