"""Shared small helpers of the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlines.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def key_of(col: str) -> Column:
    """A join key that is never null: rows without an id share one key of their own."""
    return F.coalesce(F.col(col).cast("string"), F.lit("-"))


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sha256(col: Column) -> Column:
    return F.sha2(col, 256)


def vocabulary(name: str) -> tuple[str, str]:
    """Path of a public tokenizer file on the driver, and the pattern that splits text for it."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def join_skewed(rows: DataFrame, looked_up: DataFrame, key: str, n: str = "n", share: int = 1000) -> DataFrame:
    """`rows` joined with `looked_up`, which has one row for each `key` and the number `n` of its rows.

    Keys with at least one in `share` of all rows, of which there are at most `share`, are
    broadcast; only the others are shuffled, so that no key fills a task. Keys are never null.
    """
    looked_up = cut(looked_up)
    total = looked_up.agg(F.sum(n)).first()[0] or 0
    hot = looked_up.where(F.col(n) * share >= total).drop(n)
    rest = looked_up.where(F.col(n) * share < total).drop(n)
    # a key of the other kind finds no partner in its join
    at_once = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return at_once.unionByName(others)
