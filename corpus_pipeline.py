"""A training-data pipeline over the table of documents: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlines.llm import byte_bpe, decontaminate, language_id, line_dedup, near_dedup
from roadlines.llm.common import table, vocabulary
from roadlines.session import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.5
ALIKE_CHARS = 20  # of lines that go for a line within one edit

#: Language identification and BPE are not expressible in SQL; the stages are tested by brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told apart: letters, and one language more likely than the rest."""
    model = language_id.fit(docs, vocabulary("piece_bpe_32k.model")[0])
    said = language_id.predict(docs, model)
    return said.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def first_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines; n_chars follows. One that loses all it had goes.

    Lines of any length go if the same line stands earlier, longer ones for a line within one edit too: to
    drop a whole document for a short line that only looks like another would lose clean ones.
    """
    kept = line_dedup.drop_repeated_lines(docs, min_chars=ALIKE_CHARS)
    gone = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.where(~gone).withColumn("n_chars", n_chars).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.keep_one(docs).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether these decode to the text."""
    path, pattern = vocabulary("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(spark, path)
    both = byte_bpe.encode_and_decode(docs.select(*COLUMNS), ranks, pattern)
    return both.select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"), (
        F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [
    ("language id", known_language),
    ("line dedup", first_lines),
    ("near dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
