"""What a history, comments, signals and gaps say about a change: key commits, the floor of its verdict, completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.fences import EXPLICIT_WORKAROUND
from lodestone.operators.lineage import spread

# Verdicts and degrees of completeness from the mildest, and the kinds of signals that are contracts.
VERDICTS = ("SAFE", "RISKY", "DANGEROUS", "STOP")
COMPLETENESS = ("complete", "partial", "insufficient")
CONTRACT_KINDS = ("isr", "timing", "timing_constant", "watchdog", "hw_access", "hw_register", "concurrency", "external_interface")
MOST_PLACES, MOST_NAMES, MOST_FILES = 3, 4, 3


def states_workaround(text: Column) -> Column:
    return F.rlike(F.coalesce(text, F.lit("")), F.lit("(?i)" + T.portable(EXPLICIT_WORKAROUND)))


def strength() -> Column:
    """3 for a revert, 2 if the subject states a workaround, 1 if the body does, else 0."""
    return F.when(F.col("revert"), 3).when(states_workaround(F.col("subject")), 2).when(states_workaround(F.col("body")), 1).otherwise(0)


def key_commits(history: DataFrame, of: str, carry: tuple[str, ...] = ("sha", "subject")) -> DataFrame:
    """The commit that says most about each key ``of`` (with ``carry``, the flags and ``explicit``).

    ``history`` has the key, pos (0 the newest), sha, subject, body, authored_at
    and the flags bugfix, rationale and revert. The strongest counts, the oldest
    of those that tie; where none is strong, the newest fix or reason. Keys of
    neither have no row.
    """
    ranked = history.withColumn("strength", strength()).where("strength > 0 OR bugfix OR rationale")
    strong = F.col("strength") > 0
    order = F.struct((~strong).cast("int"), -F.col("strength"), F.when(strong, F.col("authored_at")), "pos")
    best = F.min_by(F.struct(*carry, "revert", "bugfix", "rationale", (strong & ~F.col("revert")).alias("explicit")), order)
    return ranked.groupBy(of).agg(best.alias("k")).select(of, "k.*")


def _reason(step: int, nth, rule: str, verdict: str, detail: Column) -> list[Column]:
    at = nth if isinstance(nth, Column) else F.lit(nth)
    return [F.struct(F.lit(step).alias("step"), at.cast("long").alias("nth")).alias("place"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), detail.alias("detail")]


def _first_few(rows: DataFrame, keys: list[str], text: Column, most: int) -> DataFrame:
    """keys, n, first and the texts of the first ``most`` rows by ``nth``; the window drops later rows before they move."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    few = rows.withColumn("_text", text).withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("nth"))).where(F.col("_at") <= most)
    texts = few.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_text"))).alias("few"))
    return counted.join(texts, keys).withColumn("few", F.array_join(F.transform("few", lambda x: x["_text"]), ", "))


def floor_reasons(cases: DataFrame, history: DataFrame, comments: DataFrame, signals: DataFrame, touched: DataFrame) -> DataFrame:
    """(case_id, place, rule, verdict, detail) of every rule that holds for a case.

    ``cases`` has case_id, behaviour_free, completeness and related_tests; the
    others case_id and nth (their order), and ``history`` where, sha, subject,
    revert, bugfix, rationale and explicit, ``comments`` where and comment,
    ``signals`` where and kind, ``touched`` name and level. A change without
    behaviour has that reason alone, and a case of no other rule has one that
    says so. Repeated rows are reasons of their own.
    """
    # The rules' names and the wording of their details.
    active = cases.where(~F.col("behaviour_free")).select("case_id", "completeness", "related_tests")
    of = lambda df: df.join(active.select("case_id"), "case_id", "left_semi")
    own, short, nth = of(history), F.left("sha", F.lit(10)), F.col("nth")
    plain = ~F.col("revert") & ~F.col("explicit")
    shaped = F.format_string('%s: shaped by %s "%s"', "where", short, "subject")
    found = [
        cases.where("behaviour_free").select("case_id", *_reason(0, 0, "change_class", "SAFE", F.lit("Only comments, whitespace, log/message strings or docs change: no behaviour change."))),
        own.where("revert").select("case_id", *_reason(1, nth, "reverted_before", "STOP", F.format_string('%s: its history includes a revert (%s "%s")', "where", short, "subject"))),
        own.where("NOT revert AND explicit").select("case_id", *_reason(1, nth, "explicit_workaround", "STOP", shaped)),
        of(comments).select("case_id", *_reason(2, nth, "workaround_comment", "STOP", F.format_string('%s: under the comment "%s"', "where", "comment"))),
        own.where(plain & (F.col("bugfix") | F.col("rationale"))).select(
            "case_id", *_reason(3, nth, "bugfix_history", "DANGEROUS", F.format_string('%s: shaped by %s commit %s "%s"', "where", F.when(F.col("bugfix"), "bug-fix").otherwise("HW/timing"), short, "subject"))
        ),
    ]
    contract = _first_few(of(signals).where(F.col("kind").isin(*CONTRACT_KINDS)), ["case_id", "kind"], F.col("where"), MOST_PLACES)
    more = F.when(F.col("n") > MOST_PLACES, F.format_string(" (+%d)", F.col("n") - MOST_PLACES)).otherwise("")
    found.append(contract.select("case_id", *_reason(4, F.col("first"), "contract_signal", "DANGEROUS", F.concat("kind", F.lit(" on "), "few", more))))
    critical = _first_few(of(touched).where("level <> 'low'"), ["case_id"], F.format_string("%s (%s)", "name", "level"), MOST_NAMES)
    changed = active.join(touched.select("case_id").distinct(), "case_id", "left_semi")
    found += [
        changed.where("completeness <> 'complete'").select("case_id", *_reason(5, 0, "incomplete_analysis", "RISKY", F.concat(F.lit("analysis completeness is "), "completeness"))),
        critical.select("case_id", *_reason(6, 0, "critical_symbol", "RISKY", F.col("few"))),
        active.where("related_tests = 0").select("case_id", *_reason(7, 0, "no_related_tests", "RISKY", F.lit("no test references the touched code"))),
    ]
    reasons = found[0]
    for more_of in found[1:]:
        reasons = reasons.unionByName(more_of)
    none = cases.select("case_id", *_reason(8, 0, "no_rule", "SAFE", F.lit("complete analysis, no critical signals, related tests found")))
    # Every case has the reason of none until it meets another: found by a window, as a join would work all rules out twice.
    other = F.max(F.col("place.step") < 8).over(Window.partitionBy("case_id"))
    either = spread(reasons.unionByName(none), "case_id").withColumn("_other", other)
    return either.where((F.col("place.step") < 8) | ~F.col("_other") | F.col("case_id").isNull()).drop("_other")


def with_floors(reasons: DataFrame) -> DataFrame:
    """``reasons`` with the floor of their case, in one pass over them."""
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    worst = F.max(F.struct(rank.alias("rank"), "verdict")).over(Window.partitionBy("case_id"))
    return reasons.withColumn("floor", worst["verdict"])


def floors(reasons: DataFrame) -> DataFrame:
    """(case_id, floor): the worst verdict of a case's reasons, which no later opinion goes below."""
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    return reasons.groupBy("case_id").agg(F.max(F.struct(rank.alias("rank"), "verdict")).alias("v")).select("case_id", F.col("v.verdict").alias("floor"))


def completeness(cases: DataFrame) -> DataFrame:
    """``cases`` with level (complete, partial or insufficient) and the reasons, an array of (level, text).

    Columns, all numbers but ``unanalysed`` (names of changed files that aren't
    C or C++, an array), ``scope`` and ``scan_covers``: bad_parse,
    history_failures, outside_functions, ambiguous, unresolved, boundary,
    variants, touched.
    """
    # The wording of the reasons.
    several = F.size("unanalysed")
    scope = F.when(F.coalesce("scope", F.lit("")) == "", "the scope").otherwise(F.col("scope"))
    few = F.array_join(F.slice(F.transform("unanalysed", T.basename), 1, MOST_FILES), ", ")
    rules = [
        (F.col("bad_parse") > 0, 2, F.format_string("%d changed file(s) failed to parse cleanly", "bad_parse")),
        (F.col("history_failures") > 0, 2, F.format_string("line history unavailable for %d hunk(s)", "history_failures")),
        (several > 0, 1, F.format_string("%d changed non-C/C++ file(s) not analysed (%s)", several, few)),
        (F.col("outside_functions") > 0, 1, F.format_string("%d change(s) outside any function (declarations, globals, macros): dependents found by name only", "outside_functions")),
        (F.col("ambiguous") > 0, 1, F.format_string("%d ambiguous dependency edge(s) reached (overloads / same-named methods)", "ambiguous")),
        (F.col("unresolved") > 0, 1, F.format_string("%d unresolved call(s) (function pointers / callbacks) in the touched code", "unresolved")),
        (F.col("boundary") > 0, 1, F.format_string("%d reference(s) from outside %s, matched by name", "boundary", scope)),
        (F.col("variants") > 0, 1, F.format_string("#else/#elif platform variants in %d changed file(s) not analysed", "variants")),
        ((F.col("touched") > 0) & ~F.col("scan_covers"), 1, F.lit("no scan of this repo covers the change: git risk signals limited to the changed lines")),
    ]
    held = F.array_compact(F.array(*(F.when(holds, F.struct(F.lit(COMPLETENESS[level]).alias("level"), text.alias("text"))) for holds, level, text in rules)))
    worst = F.when(F.exists("reasons", lambda r: r["level"] == "insufficient"), "insufficient").when(F.size("reasons") > 0, "partial").otherwise("complete")
    return cases.withColumn("reasons", held).withColumn("level", worst)
