"""Joins of a change's hunks with functions, signals and tests, and its verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.intervals import overlap_join
from lodestone.operators.structure import GENERIC_NAMES, TELLING

# Lines before a hunk in which a comment still speaks of it, verdicts from the mildest.
COMMENT_REACH = 5
VERDICTS = ("SAFE", "RISKY", "DANGEROUS", "STOP")


def hunk_functions(hunks: DataFrame, functions: DataFrame) -> DataFrame:
    """(hunk_id, function_id): the innermost function of every old line that a hunk changes.

    ``hunks`` has hunk_id, path, old_start and old_count; an insertion counts at
    the line before it. Lines meet functions of their file by their range.
    """
    first = F.greatest(F.lit(1), F.col("old_start"))
    lines = hunks.select("hunk_id", "path", F.explode(F.sequence(first, first + F.greatest(F.col("old_count"), F.lit(1)) - 1)).alias("line"))
    met = overlap_join(lines, functions.select(F.col("id").alias("function_id"), "path", "start", "end"), "path", ("line", "line"), ("start", "end")).select("hunk_id", "line", "function_id", "start", "end")
    inner = met.groupBy("hunk_id", "line").agg(F.min_by("function_id", F.struct(F.col("end") - F.col("start"), -F.col("start"), "function_id")).alias("function_id"))
    return inner.select("hunk_id", "function_id").distinct()


def hunk_signals(hunks: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals that a hunk touches: static ones on its old lines, workaround comments from five lines before it on."""
    last = F.col("old_start") + F.greatest(F.col("old_count"), F.lit(1)) - 1
    reach = F.when(F.col("kind") == "workaround_comment", COMMENT_REACH).otherwise(0)
    wanted = signals.where("source = 'static' OR kind = 'workaround_comment'")
    changed = hunks.select("hunk_id", "path", F.col("old_start").alias("first"), last.alias("last"))
    met = overlap_join(changed, wanted.withColumn("until", F.col("end") + reach), "path", ("first", "last"), ("start", "until"))
    return met.select("hunk_id", "r.path", "start", "end", "kind", "source", "snippet", "weight")


def related_tests(touched: DataFrame, parsed: DataFrame) -> DataFrame:
    """(name, path): tests whose code names what is touched.

    ``touched`` has name (a function's short name); generic and short names tell
    nothing. Words of the tests meet the names, each word of a test once.
    """
    telling = touched.where((F.length("name") >= TELLING) & ~F.col("name").isin(GENERIC_NAMES)).select("name").distinct()
    words = parsed.where(T.is_test(F.col("path"))).select("path", F.explode("names").alias("x")).select("path", F.col("x.name").alias("name"))
    return words.join(telling.hint("merge"), "name").select("name", "path").distinct()


def untested(touched: DataFrame, tests: DataFrame, signals: DataFrame) -> DataFrame:
    """Critical touched functions (id, name) that no test names.

    ``touched`` has id, name, path, start, end and level; critical are those of
    a level above low or with a signal inside.
    """
    spans = signals.select("path", F.col("start").alias("s"), F.col("end").alias("e"))
    inside = overlap_join(spans, touched.select("id", "path", "start", "end"), "path", ("s", "e"), ("start", "end")).select("id").distinct().withColumn("signal", F.lit(True))
    critical = touched.join(inside.hint("merge"), "id", "left").where("level <> 'low' OR signal")
    return critical.join(tests.select("name").distinct().hint("merge"), "name", "left_anti").select("id", "name").distinct()


def severity(verdict: Column) -> Column:
    """Place of a verdict among VERDICTS from 1; 0 for none."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, VERDICTS)), verdict).cast("int"), F.lit(0))


def final_verdicts(reviews: DataFrame, overrides: DataFrame) -> DataFrame:
    """(review_id, verdict, overridden): the last override if there is one, else the engine's verdict.

    ``overrides`` has review_id, verdict and at.
    """
    last = overrides.groupBy("review_id").agg(F.max_by("verdict", "at").alias("by_hand"))
    return reviews.join(last, "review_id", "left").select("review_id", F.coalesce("by_hand", "verdict").alias("verdict"), F.col("by_hand").isNotNull().alias("overridden"))


def raised(verdict: Column, proposed: Column, cited_claims: Column) -> Column:
    """A proposed verdict raises one, never lowers it, and only with a claim that its evidence bears."""
    return F.when((cited_claims > 0) & (severity(proposed) > severity(verdict)), proposed).otherwise(verdict)


def severity_order(findings: DataFrame, ranks: dict[str, int], by: str, tie: list[str], other: int = 9) -> DataFrame:
    """All findings with their severity, in its order."""
    ranked = F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))
    return findings.withColumn("severity", F.coalesce(F.try_element_at(ranked, F.col(by)), F.lit(other))).orderBy("severity", *tie)


def latest_review(reviews: DataFrame) -> DataFrame:
    """Of the reviews of each change request the last one: all columns, by repo and number."""
    last = reviews.groupBy("repo", "number").agg(F.max_by(F.struct(*reviews.columns), F.struct("at", "review_id")).alias("r"))
    return last.select("r.*")
