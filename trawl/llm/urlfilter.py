"""URL filters: host-suffix and path-prefix expressions joined on short digests.

Each rule names a host, a path and a verdict. A rule fits its host and every
subdomain if the url's path starts with the rule's path. Every url is expanded into
(host suffix, directory prefix) expressions; these meet the rules in an equi-join on
the first 32 bits of their SHA-256, and a match counts once the full digests and the
rest of the rule's path agree. The longest rule wins.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no
rule and gets ``default``. Repeated rows yield repeated rows; null page ids are kept.
Equally long rules: the longer host wins, then ``block``. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.base import ascii_lower

#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Rules are broadcast up to this many (some 200 bytes each), else shuffled.
BROADCAST_RULES = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _rule_keys(rules: DataFrame) -> DataFrame:
    """A rule's path is keyed by its part up to the last slash; the rest is confirmed after the join."""
    head = F.regexp_extract("rule_path", r"(?s)^.*/", 0)
    return (
        rules.select(
            ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict"
        )
        .filter("rule_host <> ''")
        .withColumn("rule_digest", F.sha2(F.concat("rule_host", head), 256))
        .withColumn("key", F.substring("rule_digest", 1, 8))
        .withColumn(
            "rank",
            F.struct(
                (F.length("rule_host") + F.length("rule_path")).alias("length"),
                F.length("rule_host").alias("host_length"),
                (F.col("verdict") == "block").alias("blocks"),
                F.concat("rule_host", "rule_path").alias("rule"),
                F.col("verdict"),
            ),
        )
    )


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict."""
    keyed = _rule_keys(rules)
    n, labels, slashes = keyed.agg(
        F.count("*"),
        F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(1)),
        F.coalesce(F.max(F.size(F.split("rule_path", "/")) - 1), F.lit(0)),
    ).first()
    keyed = keyed.select("key", "rule_digest", "rule_path", "rank")
    keyed = F.broadcast(keyed) if n <= BROADCAST_RULES else keyed

    host, path = host_and_path(F.col("url"))
    # no rule has more labels or slashes than these, so longer expressions can't match
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(labels), F.size(F.col("labels")))),
        lambda k: F.array_join(F.slice("labels", -k, k), "."),
    )
    heads = F.transform(
        F.sequence(F.lit(0), F.least(F.lit(slashes), F.size("parts") - 1)),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice("parts", 1, k), "/"), F.lit("/"))),
    )
    expressions = F.flatten(F.transform("suffixes", lambda s: F.transform("heads", lambda h: F.concat(s, h))))
    fits = (F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path"))
    # rows get numbers of their own, so equal rows, however many, don't meet in one task
    return (
        pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host.alias("host"), path.alias("path"))
        .withColumn("labels", F.split("host", r"\."))
        .withColumn("parts", F.split("path", "/"))
        .withColumn("suffixes", suffixes)
        .withColumn("heads", heads)
        .select("row", "page_id", "host", "path", F.explode(expressions).alias("expression"))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("key", F.substring("digest", 1, 8))
        .join(keyed, "key", "left")
        .groupBy("row", "page_id", "host", "path")
        .agg(F.max(F.when(fits, F.col("rank"))).alias("best"))
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )
