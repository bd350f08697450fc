"""URL filters: host-suffix and path-prefix expressions against a rule table.

A URL is expanded into every expression that a rule could be. Expressions meet
rules by an equi-join on a short prefix of their digest; the full digest then
confirms the match, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import stash

#: Bytes (as hexadecimal digits) of the digest prefix that expressions and rules are joined on.
PREFIX_DIGITS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path of a URL; both empty for null or where ``://`` is missing.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, with A to Z in lower case; the path follows up to ``?``, ``#`` or the end.
    """
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table of (verdict, host, path) rows."""
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def expressions(host: F.Column, path: F.Column, shapes: list[tuple[int, int]]) -> F.Column:
    """The host suffix and the path prefix of every shape that fits.

    A shape is a number of host labels with a path length. Those that occur
    together in a rule are given, so a host of a thousand labels makes no more
    expressions than the rules can match.
    """
    parts = F.split(host, r"\.")
    fitting = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(m).alias("m")) for k, m in shapes)), lambda x: (x["k"] <= F.size(parts)) & (x["m"] <= F.length(path)))
    return F.transform(fitting, lambda x: F.struct(F.array_join(F.slice(parts, F.size(parts) - x["k"] + 1, x["k"]), ".").alias("h"), F.substring(path, F.lit(1), x["m"]).alias("p")))


def _digest(host: F.Column, path: F.Column) -> F.Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Host, path, the rule that decides and the verdict of every page.

    ``rules`` has verdict, rule_host and rule_path. A rule fits its host and all
    subdomains where the path starts with the rule's. Of the fitting rules the
    longest (host and path together) wins; on a tie the one with the longer host,
    then the blocking one. Where none fits, the rule is null and the verdict
    ``default``. A null url, or one without ``://``, has an empty host and path,
    which no rule with a host fits. Repeated rows are all returned, an empty
    table gives no rows, and other columns are ignored.
    """
    host, path = split_url(F.col("url"))
    # Written once with a number for each row, by which the verdicts find their rows again.
    numbered = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path}).drop("url")
    rows = stash(numbered.withColumn("row", F.monotonically_increasing_id()), "urls")
    shapes = sorted((r["k"], r["m"]) for r in rules.select(F.size(F.split("rule_host", r"\.")).alias("k"), F.length("rule_path").alias("m")).distinct().collect())
    if not shapes:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    known = (
        rules.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
        .select("short", "digest", "verdict", F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_host").alias("host_chars"))
    )
    asked = rows.select("row", F.explode(expressions(F.col("host"), F.col("path"), shapes)).alias("e")).select("row", _digest(F.col("e.h"), F.col("e.p")).alias("full"))
    # Only digests move, and a prefix that very many URLs share is an inner join that Spark splits.
    met = asked.withColumn("short", F.substring("full", 1, PREFIX_DIGITS)).join(known, "short").where("digest = full")
    best = met.groupBy("row").agg(F.max(F.struct(F.length("rule").alias("chars"), "host_chars", "verdict", "rule")).alias("best"))
    return rows.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
