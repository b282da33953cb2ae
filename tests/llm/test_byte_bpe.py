import random

import public_tokenizers
from pyspark.sql import functions as F

from roadlines.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def plain():
    with open(PATH, "rb") as f:
        return byte_bpe.codec(f.read(), PATTERN)


def odd_texts():
    rng = random.Random(3)
    bits = ["the", " ", "  ", "\n", "\t", "'re", "'", "r", "e", "é", "漢字", "\U0001f600", "123", "...", " !", "\u00a0",
            "\u2003", "\x1c", "<|endoftext|>", "ing", "A"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    return texts + ["a" * 3000, " " * 500, "\n" * 300 + "x", "word " * 800, "ab 'r" + "e" * 40, ""]


def test_tree_equals_the_whole_at_any_leaf_size():
    enc = plain()
    for t in odd_texts():
        want = enc.encode_ordinary(t)
        for leaf in (1, 2, 3, 7, 64):
            got = byte_bpe.encode_text(enc, t, leaf)
            assert got.tolist() == want, (t, leaf)
            assert byte_bpe.decode_ids(enc, got, leaf) == t.encode()


def test_columns(spark, docs_of):
    texts = [*odd_texts(), None]
    docs = docs_of([(i, t) for i, t in enumerate(texts)] + [(None, "x y"), (1, texts[1])]).withColumn("ids", F.lit("old"))
    ranks = byte_bpe.read_ranks(spark, PATH)
    rows = byte_bpe.decode(byte_bpe.encode(docs, ranks, PATTERN), ranks, PATTERN).collect()
    enc = plain()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert r.ids == enc.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.encode(docs.limit(0), ranks, PATTERN).count() == 0


def test_both_at_once(spark, docs_of, monkeypatch):
    texts = [*odd_texts()[:60], None, ""]
    docs = docs_of([(i, t) for i, t in enumerate(texts)]).withColumns({"ids": F.lit("old"), "_both": F.lit("mine")})
    ranks = byte_bpe.read_ranks(spark, PATH)
    got = byte_bpe.encode_and_decode(docs, ranks, PATTERN, leaf=7)
    enc = plain()
    for r in got.collect():
        assert (r.ids, bytes(r.decoded), r._both) == (enc.encode_ordinary(r.text or ""), (r.text or "").encode(), "mine")
    assert got.count() == len(texts) and byte_bpe.encode_and_decode(docs.limit(0), ranks, PATTERN).count() == 0
