"""Op 9. URL rules by host-suffix and path-prefix expressions.

A url is expanded into every (host suffix, path prefix) a rule could have. The short prefix of an
expression's SHA-256 is the equi-join key; the full digest confirms the match and the longest
matching rule decides. Native: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 8
SALTS = 16
DEFAULT_VERDICT = "allow"


def host_of(url: str = "url") -> Column:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    """Path: from the host's end up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.regexp_replace(_rest(url), r"^[^/?#]*", ""), r"^[^?#]*", 0)


def _rest(url: str) -> Column:
    at = F.coalesce(F.instr(F.col(url), "://"), F.lit(0))
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.char_length(url))).otherwise("")


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", salt_by: str = "page_id",
          default: str = DEFAULT_VERDICT) -> DataFrame:
    """Add host, path, rule and verdict to `pages`; `rules` has host, path and verdict.

    A rule fits its host and all subdomains if the url's path starts with the rule's path. The
    longest rule (characters of host and path) wins, block before allow among equals. A url
    without a fitting rule, an empty, null or scheme-less one gets the default verdict and a null
    rule. Every input row stays, repeated ones too; existing columns of these names are replaced.

    Two facts about the rules bound the expansion without losing a match: the most labels a rule
    host has, and the distinct lengths of rule paths. They are one aggregated row. Rules are
    never hinted as a broadcast: Spark broadcasts them only below its own size limit.
    """
    clean = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    facts = clean.agg(F.max(F.size(F.split("host", r"\."))).alias("labels"),
                      F.array_sort(F.collect_set(F.char_length("path"))).alias("lengths")).first()
    labels, lengths = facts["labels"] or 1, list(facts["lengths"])
    lookup = clean.select(
        F.concat("host", "path").alias("_rule"), F.col("verdict").alias("_rule_verdict"),
    ).withColumn("_rule_digest", _digest(F.col("_rule"))).withColumn(
        "_short", F.substring("_rule_digest", 1, PREFIX_HEX))

    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(*kept).withColumns({
        "host": host_of(url), "path": path_of(url),
        "_salt": F.pmod(F.xxhash64(salt_by), F.lit(SALTS))})
    # one row per (host, path, salt): a very common url is judged once per salt, not once per row
    places = rows.select("host", "path", "_salt").distinct()
    parts = F.split("host", r"\.")
    n = F.size(parts)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(labels))),
        lambda i: F.array_join(F.slice(parts, n - i + 1, i), "."))
    fitting = F.filter(F.array(*[F.lit(x) for x in lengths]) if lengths else F.array().cast("array<int>"),
                       lambda k: k <= F.char_length("path"))
    expressions = (
        places.withColumn("_suffix", F.explode(suffixes)).withColumn("_length", F.explode(fitting))
        .select("host", "path", "_salt", _digest(F.concat(
            "_suffix", F.expr("substring(path, 1, _length)"))).alias("_digest"))
        .withColumn("_short", F.substring("_digest", 1, PREFIX_HEX)))
    best = (
        expressions.join(lookup, "_short").where(F.col("_digest") == F.col("_rule_digest"))
        .groupBy("host", "path", "_salt")
        .agg(F.max(F.struct(F.char_length("_rule").alias("n"), (F.col("_rule_verdict") == "block").alias("b"),
                            F.col("_rule").alias("rule"), F.col("_rule_verdict").alias("verdict"))).alias("_best")))
    return rows.join(best, ["host", "path", "_salt"], "left").select(
        *kept, "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
