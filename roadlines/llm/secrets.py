"""Op 2. Secrets, with corpus-wide ownership frequency.

Every candidate value is hashed and counted over the whole corpus by distinct owners and
repositories. Values that several owners share, or that stand in many repositories, are examples
that were copied around; a value of one owner in few repositories looks live. Base matches are always reported, as live or as example; wider, opaque
candidates are reported only if they look live. Native: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlines.llm.common import text_or_empty
from roadlines.session import cut

#: The base patterns of the contract, in the order in which kinds are listed.
ASSIGN = (r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
          r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the maximal runs of 32 and more
#: The method's own candidates: long unbroken runs, refined by `looks_opaque`.
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "opaque")
BASE = KINDS[:3]
SALTS = 16
#: A value in more repositories than this is an example, even if one owner has them all.
MAX_REPOSITORIES = 20


def looks_opaque(value: Column, distinct: int = 12) -> Column:
    """Letters of both cases or letters and digits, and many different characters."""
    return (value.rlike("[0-9]") & value.rlike("[A-Za-z]")
            & (F.size(F.array_distinct(F.split(value, ""))) >= distinct))


def matches(text: str, pattern: str) -> Column:
    """Leftmost non-overlapping matches as an array of (s, e, m), in code points.

    The texts between matches and the matches themselves alternate, so running sums of their
    lengths are the positions.
    """
    empty = F.expr("array()").cast("array<struct<s:int,e:int,m:string>>")
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(gaps.alias("g"), found.alias("m"))
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc, x):
        s = acc["at"] + x["g"]
        e = s + F.char_length(x["m"])
        one = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))
        return F.when(x["m"].isNull(), acc).otherwise(
            F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    return F.when(F.col(text).rlike(pattern), F.aggregate(pairs, start, step)["out"]).otherwise(empty)


def _tagged(kind: int, spans: Column, value) -> Column:
    return F.transform(spans, lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("k"),
        F.xxhash64(value(x)).alias("h1"), F.xxhash64(F.lit(1), value(x)).alias("h2")))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add `_spans`, an array of (s, e, k, h1, h2), to `docs`; opaque ones clear of base ones only."""
    rows = docs.withColumn("_text", text_or_empty(text))
    rows = rows.withColumns({f"_{k}": matches("_text", p) for k, p in
                             zip(KINDS, (ASSIGN, ACCESS, HEX, OPAQUE), strict=True)})

    def secret(x):
        return F.regexp_extract(x["m"], ASSIGN, 2)

    base = F.concat(
        _tagged(0, F.filter("_assign", lambda x: F.char_length(secret(x)) >= 8), secret),
        _tagged(1, F.filter("_access", lambda x: F.char_length(x["m"]) >= 16), lambda x: x["m"]),
        _tagged(2, F.col("_hex"), lambda x: x["m"]))
    rows = rows.withColumn("_base", base)
    wider = F.filter("_opaque", lambda x: looks_opaque(x["m"]) & ~F.exists(
        "_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return rows.withColumn("_spans", F.concat("_base", _tagged(3, wider, lambda x: x["m"]))).drop(
        "_text", "_base", *[f"_{k}" for k in KINDS])


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repository: str = "doc_id",
         owner: str = "source", max_owners: int = 1, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(doc_id, spans): spans is an array of (start, end, kind, owners, repositories, live).

    `live` means that at most `max_owners` owners have the value, in at most `max_repositories`
    repositories. Spans are ordered by start, then by kind as listed. Null texts are empty; null owners and repositories count as one
    each; every row stays, repeated ones too. The found spans are written once and read for the
    counts and for the result; texts are read once and never shuffled. Counting pre-aggregates
    by (value, owner); the lookup of a value is salted, so a value that a third of all rows
    hold is spread.
    """
    found = cut(candidates(docs, text).select(
        F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"),
        F.col(repository).alias("_repo"), F.col(owner).alias("_owner"), "_spans"))
    spans = found.where(F.size("_spans") > 0).select(
        "_row", "_repo", "_owner", F.explode("_spans").alias("x")).select("_row", "_repo", "_owner", "x.*")
    counted = (
        spans.groupBy("h1", "h2", "_owner", "_repo").agg(F.count(F.lit(1)).alias("_n"))
        .groupBy("h1", "h2", "_owner").agg(F.count(F.lit(1)).alias("_repos"))
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("owners"), F.sum("_repos").alias("repositories"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    judged = (
        spans.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
        .join(counted, ["h1", "h2", "_salt"])
        .withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories))
        .where((F.col("k") < len(BASE)) | F.col("live"))
        .groupBy("_row").agg(F.sort_array(F.collect_list(
            F.struct("s", "k", "e", "owners", "repositories", "live"))).alias("_found")))
    names = F.array(*[F.lit(k) for k in KINDS])
    return found.join(judged, "_row", "left").select("doc_id", F.transform(
        F.coalesce("_found", F.array().cast(judged.schema["_found"].dataType)), lambda x: F.struct(
            x["s"].alias("start"), x["e"].alias("end"), names[x["k"]].alias("kind"),
            x["owners"].alias("owners"), x["repositories"].alias("repositories"),
            x["live"].alias("live"))).alias("spans"))
