"""The registered queries of the text operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlines.llm import byte_bpe, decontaminate, hard_negatives, html_text, language_id, line_dedup, near_dedup, periodic_runs, personal_data, secrets, simhash
from roadlines.llm import fingerprints as fp
from roadlines.llm import url_filter
from roadlines.llm.common import sha256, table, vocabulary

#: The rules that the query applies, as host, path, verdict.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def base_digest(spans: Column, kinds: tuple[str, ...]) -> Column:
    return sha256(span_text(F.filter(spans, lambda x: x["kind"].isin(*kinds))))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds within the error budget."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: a document stands for a repository, its source for the owner."""
    spans = F.col("spans")
    return secrets.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count_of(spans, k).alias(f"n_{k}") for k in secrets.BASE],
        base_digest(spans, secrets.BASE).alias("base_sha256"), span_text(spans).alias("spans"),
        F.size(F.filter(spans, lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter(spans, lambda x: ~x["live"])).cast("long").alias("n_example"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the bytes they decode to, as digests."""
    path, pattern = vocabulary("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.read_ranks(spark, path)
    ids = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    both = byte_bpe.decode(ids.select("doc_id", "ids"), ranks, pattern)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, vocabulary("piece_bpe_32k.model")[0])
    rows = language_id.labelled(docs, "doc_id").select("doc_id", "held_out", "text")
    return language_id.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = table(spark, sf_dir, "documents")
    spans, base = F.col("spans"), F.filter("spans", lambda x: x["base"])
    found = personal_data.find(docs.select("doc_id", "text"), personal_data.fit(docs)).select("doc_id", "spans")
    return found.select(
        "doc_id", *[count_of(base, k).alias(f"n_{k}") for k in personal_data.KINDS],
        base_digest(base, personal_data.KINDS).alias("base_sha256"), span_text(spans).alias("spans"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document, of its edited text, and their likeness."""
    found = fp.fingerprint_with_next(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", sha256(F.col("edited")).alias("edited_sha256"),
        fp.render(F.col("sketch")).alias("fingerprint"),
        fp.render(F.col("edited_sketch")).alias("edited_fingerprint"),
        fp.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fp.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand earlier, in it or in another one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs).select("doc_id", "text", "n_lines", "n_removed")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint of every document and the component it links into."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", simhash.render(F.col("fp")).alias("fingerprint"), "component_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its nearest rows of the same label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(rows, lambda i: i % 100 == 0)


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which for a tenth of the ids the words from a hashed place on repeat with a hashed period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    n, g = F.size("words").cast("long"), F.floor(h / 10)
    # each step names the one before more than once, so that words are split once a row
    placed = docs.select("doc_id", "text", words.alias("words")).withColumn("a", g % F.greatest(n, F.lit(1))).withColumn(
        "p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    a, p = F.col("a"), F.col("p")
    changed = F.transform("words", lambda w, i: F.when(i < a, w).otherwise(F.get("words", (a + (i - a) % p).cast("int"))))
    return placed.select("doc_id", F.when(F.size("words") > 0, F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which are made to repeat."""
    docs = with_repeats(table(spark, sf_dir, "documents"))
    runs, best = F.col("periodic.runs"), F.col("best")
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", *[
        r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))), "")
    found = periodic_runs.find(docs).withColumn("best", periodic_runs.strongest(runs))
    return found.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        sha256(lines).alias("runs_sha256"), sha256(F.col("periodic.collapsed")).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_decontaminate, op2_secrets, op3_byte_bpe, op4_language_id, op5_html_text, op6_personal_data,
        op7_near_dedup, op8_fingerprints, op9_url_filter, op10_line_dedup, op11_simhash,
        op12_hard_negatives, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filter": ORACLE_URL, "op12_hard_negatives": ORACLE_NEGATIVES}


ORACLE_NEGATIVES = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


ORACLE_URL = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), u AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM q),
rules(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS verdict
  FROM u JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best ON u.page_id = best.page_id
"""
