"""URL filters by expressions: host suffixes x path prefixes, joined on short digests, confirmed on full digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Carried, small, written

#: Hex digits of the digest that the equi-join uses.
SHORT = 8


def _lower(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table; verdict is block or allow, and path ends with ``/``.

    Hosts are A-Z lower-cased, as those of urls are. The same host and path given twice counts once, and blocks if either does.
    """
    for verdict, host, path in rules:
        if verdict not in ("block", "allow") or not host or not (path.startswith("/") and path.endswith("/")):
            raise ValueError(f"no rule: {verdict} {host}{path}")
    table = spark.createDataFrame(list(rules), "rule_verdict string, rule_host string, rule_path string").withColumn("rule_host", _lower(F.col("rule_host")))
    return table.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))


def _prefixes(parts: Column, joiner: str, most: int, from_end: bool) -> Column:
    """The first (or last) 1 to most parts, joined."""
    n = F.least(F.size(parts), F.lit(most))
    take = lambda k: F.slice(parts, -k, k) if from_end else F.slice(parts, F.lit(1), k)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(take(k), joiner))).otherwise(
        F.array().cast("array<string>")
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to each row of pages.

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest host plus path
    wins (of equal length the longer host, then the first by code point). Without a rule: null and ``default``.

    Each distinct (host, leading path segments) is expanded once, no deeper than the deepest rule, which no longer
    expression could fit; so a host that holds a third of all rows is one row here. Null or empty urls have empty
    host and path and no rule; urls of any length are judged whole. Repeated rows are kept and judged alike, an empty
    table stays empty. Columns host, path, rule and verdict of ``pages`` are replaced.
    """
    rules = written(
        rules.select(
            "*",
            F.concat("rule_host", "rule_path").alias("rule"),
            F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256).alias("digest"),
        ).withColumn("short", F.substring("digest", 1, SHORT)),
        "url-rules",
    )
    labels, segments = rules.select(
        F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(1)),
        F.coalesce(F.max(F.size(F.split("rule_path", "/"))) - 1, F.lit(1)),
    ).first()

    carried = Carried(pages, url)
    pages = carried.df.select("*", host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    # The path up to the deepest rule's last slash; the rest can't decide.
    lead = F.regexp_extract(F.col("path"), rf"(?s)^(?:[^/]*/){{0,{int(segments)}}}", 0)
    lead_host = F.substring_index(F.col("host"), ".", -int(labels))
    key = pages.select(lead_host.alias("lead_host"), lead.alias("lead")).distinct()
    expressions = key.select(
        "lead_host",
        "lead",
        F.explode(_prefixes(F.split("lead_host", r"\."), ".", int(labels), True)).alias("x_host"),
    ).select(
        "lead_host",
        "lead",
        "x_host",
        F.explode(
            F.transform(
                _prefixes(F.split(F.regexp_replace("lead", "/$", ""), "/"), "/", int(segments), False),
                lambda p: F.concat(p, F.lit("/")),
            )
        ).alias("x_path"),
    ).where(F.col("lead") != "").withColumn("x_digest", F.sha2(F.concat_ws("\n", "x_host", "x_path"), 256))
    hits = expressions.join(small(rules), F.substring("x_digest", 1, SHORT) == F.col("short")).where(
        (F.col("x_digest") == F.col("digest")) & (F.col("x_host") == F.col("rule_host")) & (F.col("x_path") == F.col("rule_path"))
    )
    best = hits.groupBy("lead_host", "lead").agg(
        F.min(
            F.struct(
                (-F.length("rule")).alias("a"), (-F.length("rule_host")).alias("b"), F.col("rule"), F.col("rule_verdict")
            )
        ).alias("best")
    )
    best = small(written(best.select(F.col("lead_host").alias("k_host"), F.col("lead").alias("k_lead"), "best.rule", "best.rule_verdict"), "url-verdicts"))
    return carried.back(
        pages.withColumns({"_host": lead_host, "_lead": lead})
        .join(best, (F.col("_host") == F.col("k_host")) & (F.col("_lead") == F.col("k_lead")), "left")
        .withColumn("verdict", F.coalesce("rule_verdict", F.lit(default)))
        .drop("_host", "_lead", "k_host", "k_lead", "rule_verdict")
    )
