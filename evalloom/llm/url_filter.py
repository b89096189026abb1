"""URL filters: rules on host and path, found by hashes of the URL's host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_lookup, materialize

#: Rules are joined on this many upper bits of an expression's 64-bit hash; full digests are compared afterwards.
SHORT_BITS = 32
#: Rules up to this number and this many characters are broadcast; more are joined by shuffle.
BROADCAST_RULES, BROADCAST_CHARS = 50_000, 8_000_000


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_filter(df: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """``key, host, path, rule, verdict`` of every row of ``df``.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all subdomains if the path starts with the
    rule's. The longest ``host||path`` wins; of equally long ones that with the longer host; of one rule with two verdicts,
    ``block``. Rows that no rule fits get ``default`` and a null rule. Null URLs and ones without ``://`` have empty host and path
    (a rule with an empty host and path fits those). Rules with a null part are left out; repeated rows stay as many.

    Only those suffixes and prefixes are built whose number of labels and length some rule has. A URL is expanded once, however
    many rows have it, and only URLs that a rule fits come back to the rows; ones that fill the table load no task. Digests are
    computed for expressions whose short hash some rule has, of rules and URLs alike.
    """
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    rules = rules.groupBy(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("r_verdict"))
    shapes = rules.groupBy(F.size(F.split("r_host", r"\.")).alias("labels")).agg(F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths"), F.count("*").alias("n"), F.sum(F.length("r_host") + F.length("r_path")).alias("chars")).collect()
    # as many literals as rules have shapes; the expressions themselves are made in a loop over them
    wanted = [F.struct(F.lit(s["labels"]).alias("labels"), F.array(*map(F.lit, s["lengths"])).alias("lengths")) for s in sorted(shapes)]
    wanted = F.array(*wanted) if wanted else F.array().cast("array<struct<labels:int,lengths:array<int>>>")
    short = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - SHORT_BITS)
    full = lambda c: F.sha2(c.cast("binary"), 256)
    expression = F.concat(F.col("r_host"), F.lit("\n"), F.col("r_path"))
    rules = rules.withColumn("digest", full(expression)).withColumn("short", short(expression))

    rows = df.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path")).withColumn("_url", F.concat("_host", F.lit("\n"), "_path"))
    urls = rows.groupBy("_url").agg(F.first("_host").alias("_host"), F.first("_path").alias("_path"), F.count("*").alias("n_rows"))
    names = F.split("_host", r"\.")
    prefixed = lambda s, suffix: F.transform(F.filter(s["lengths"], lambda n: n <= F.length("_path")), lambda n: F.concat(suffix, F.lit("\n"), F.substring(F.col("_path"), 1, n)))
    expand = lambda s: prefixed(s, F.array_join(F.slice(names, -s["labels"], s["labels"]), "."))
    fitting = F.filter(wanted, lambda s: s["labels"] <= F.size(names))
    expressions = urls.withColumn("_expression", F.explode(F.flatten(F.transform(fitting, expand)))).withColumn("_short", short(F.col("_expression")))
    few = sum(s["n"] for s in shapes) <= BROADCAST_RULES and sum(s["chars"] for s in shapes) <= BROADCAST_CHARS
    hits = expressions.join(F.broadcast(rules) if few else rules, F.col("_short") == F.col("short")).where(full(F.col("_expression")) == F.col("digest"))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.col("r_host"), F.col("r_path"), F.col("r_verdict"))
    best = materialize(hits.groupBy("_url").agg(F.max(rank).alias("_best"), F.max("n_rows").alias("n_rows")), "verdicts")
    total = best.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    out = hot_lookup(rows, best, "_url", total)
    return out.select(
        F.col("_key").alias(key),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.concat("_best.r_host", "_best.r_path").alias("rule"),
        F.coalesce("_best.r_verdict", F.lit(default)).alias("verdict"),
    )
