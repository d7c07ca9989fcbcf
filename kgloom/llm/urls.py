"""URL filters: host and path rules found by hashed expressions.

Every URL is expanded into (host suffix, path prefix) expressions.  The first 32 bits of each expression's
SHA-256 are equi-joined with those of the rules, the whole digests then confirm the hit, and among the rules
that fit the longest decides.  Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fields, materialise, wrapped

#: Rule tables up to this many rows are sent to every executor (about 200 bytes a row); larger ones are shuffled.
BROADCAST_RULES = 20_000

RULE_SCHEMA = "action string, host string, path string"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/ ? #`` or the end, with A-Z lower-cased."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def filter_urls(table: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Judge the URLs of ``table`` by ``rules`` (action, host, path).

    A rule fits its host and all subdomains of it when the URL's path starts with the rule's path.  Of the rules
    that fit, the one with the longest ``host || path`` wins; between two of equal length the longer host, then
    ``block`` before ``allow``.  Returned are the columns of ``table`` and ``host``, ``path``, ``rule`` (null if
    none fits) and ``verdict`` (``default`` if none fits); columns of these names in ``table`` are replaced.

    Null URLs and URLs without ``://`` have an empty host and path and get the default.  Repeated rows are judged
    one by one and all kept; an empty table or an empty rule table gives no rows or only defaults.  Other columns may
    have any names.  Of two rules for the same host and path, ``block`` counts.

    Path prefixes are cut only where a rule's path ends and host suffixes only as deep as a rule's host, so a URL
    of any length has at most (labels of the deepest rule) x (distinct lengths of rule paths) expressions, and none
    is left out.
    """
    added = ("host", "path", "rule", "verdict")
    base = wrapped(table, without=tuple(c for c in added if c != url)).select("row", F.col("row").getField(url).alias("__url"))
    source = materialise(base.select("row", F.monotonically_increasing_id().alias("__id"), host_of(F.col("__url")).alias("__host"), path_of(F.col("__url")).alias("__path")), "urls")

    rules = rules.select(
        F.col("action").alias("__action"), F.concat("host", "path").alias("__rule"),
        F.length("host").alias("__rule_host"), _digest(F.col("host"), F.col("path")).alias("__rule_digest"),
        F.length("path").alias("__cut"), F.size(F.split("host", r"\.")).alias("__labels"),
    ).dropDuplicates(["__rule_digest", "__action"])
    shape = rules.agg(F.count("*").alias("n"), F.max("__labels").alias("labels"), F.collect_set("__cut").alias("cuts")).first()
    cuts = F.array(*[F.lit(x) for x in sorted(shape["cuts"])]) if shape["cuts"] else F.array().cast("array<int>")
    labels = F.split("__host", r"\.")
    deepest = F.least(F.size(labels), F.lit(shape["labels"] or 0))
    suffixes = F.when(deepest > 0, F.transform(F.sequence(F.lit(1), deepest), lambda n: F.array_join(F.slice(labels, -n, n), "."))).otherwise(F.array().cast("array<string>"))
    prefixes = F.transform(F.filter(cuts, lambda n: n <= F.length("__path")), lambda n: F.substring("__path", F.lit(1), n))
    digests = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(h, p))))

    keys = source.select("__id", F.explode(digests).alias("__digest")).withColumn("__short", F.substring("__digest", 1, 8))
    table_of_rules = rules.withColumn("__short", F.substring("__rule_digest", 1, 8))
    if shape["n"] <= BROADCAST_RULES:
        table_of_rules = F.broadcast(table_of_rules)
    hits = keys.join(table_of_rules, "__short").where(F.col("__digest") == F.col("__rule_digest"))
    rank = F.struct(F.length("__rule").alias("n"), F.col("__rule_host").alias("h"), (F.col("__action") == "block").alias("b"), F.col("__rule").alias("rule"), F.col("__action").alias("action"))
    best = hits.groupBy("__id").agg(F.max(rank).alias("__best"))
    judged = source.join(best, "__id", "left")
    return judged.select(
        *fields(judged), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__best.rule").alias("rule"), F.coalesce("__best.action", F.lit(default)).alias("verdict")
    )
