"""Findings of a review, coded by severity, and what a change of one line risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.operators.intervals import overlap_join
from lodestone.operators.lineage import spread
from lodestone.operators.ranking import top_per_key

# Severities from the mildest, and how many signals of a contract are told.
SEVERITIES = ("INFO", "RISKY", "DANGEROUS", "STOP")
MOST_CONTRACT_CLAIMS = 6


def _place(path: str, line: str) -> Column:
    return F.concat_ws(":", F.substring_index(path, "/", -1), F.col(line).cast("string"))


def _claims(rows: DataFrame, part: int, severity: Column, title: Column, text: Column, own: bool) -> DataFrame:
    """Claims of one sort of finding; ``own``: each place is a finding of its own."""
    at = (F.col("path").cast("string"), F.col("line").cast("int")) if own else (F.lit(None).cast("string"), F.lit(None).cast("int"))
    return rows.select("review_id", F.lit(part).alias("part"), severity.alias("severity"), title.alias("title"), at[0].alias("path"), at[1].alias("line"), text.alias("text"))


def finding_claims(hunks: DataFrame, comments: DataFrame, contracts: DataFrame, changes: DataFrame, gaps: DataFrame, missing: DataFrame) -> DataFrame:
    """(review_id, part, severity, title, path, line, text): one row for each claim that a finding rests on.

    All tables have review_id. ``hunks`` has path, line, strong and weak (commits
    behind the old lines) and the key commit's subject; without such commits a
    hunk is no finding. ``comments`` (path, line, comment) are workaround comments
    above changed lines, ``contracts`` (path, line, kind, snippet) the signals
    touched, ``changes`` (path, class) the changed files, ``gaps`` (level, text)
    what the analysis lacks, ``missing`` (name) critical code without a test.
    A review whose changes are all of another class than code changes no
    behaviour: it has one mild finding, and gaps and missing tests don't matter.
    """
    # The wording of titles.
    strong = F.col("strong") > 0
    told = F.when(strong, "Alters code with an explicit workaround history (").otherwise("Alters code with bug-fix history (")
    history = _claims(hunks.where("strong + weak > 0"), 1, F.when(strong, "STOP").otherwise("DANGEROUS"), F.concat(told, F.coalesce("subject", F.lit("")), F.lit(")")), _place("path", "line"), True)
    above = _claims(comments, 2, F.lit("STOP"), F.lit("Changes code under a workaround comment"), F.concat(_place("path", "line"), F.lit(": "), F.coalesce("comment", F.lit(""))), True)

    # The kinds of a review are few whatever it touches.
    kinds = contracts.groupBy("review_id", "kind").agg(F.min(F.struct("path", "line")).alias("first")).groupBy("review_id").agg(F.array_sort(F.collect_list(F.struct("first", "kind"))).alias("kinds"))
    touches = F.concat(F.lit("Touches "), F.array_join(F.transform("kinds", lambda k: F.replace(k["kind"], F.lit("_"), F.lit(" "))), ", "), F.lit(" code"))
    shown = top_per_key(contracts, ["review_id"], ["path", "line", "kind", "snippet"], MOST_CONTRACT_CLAIMS).join(kinds, "review_id")
    contract = _claims(shown, 3, F.lit("DANGEROUS"), touches, F.concat(_place("path", "line"), F.lit(" ("), F.col("kind"), F.lit("): "), F.coalesce("snippet", F.lit(""))), False)

    free = changes.groupBy("review_id").agg(F.every(F.col("class") != "code").alias("free")).where("free").select("review_id")
    harmless = _claims(changes.join(free, "review_id", "left_semi"), 4, F.lit("INFO"), F.lit("Behaviour-free change"), F.concat_ws(": ", "path", "class"), False)
    worst = gaps.groupBy("review_id").agg(F.when(F.max((F.col("level") == "insufficient").cast("int")) == 1, "insufficient").otherwise("partial").alias("worst"))
    lacking = _claims(gaps.join(worst, "review_id").join(free, "review_id", "left_anti"), 5, F.lit("RISKY"), F.concat(F.lit("Analysis is "), "worst"), F.col("text"), False)
    tests = _claims(missing.join(free, "review_id", "left_anti"), 6, F.lit("RISKY"), F.lit("No related test found"), F.col("name").cast("string"), False)
    return history.unionByName(above).unionByName(contract).unionByName(harmless).unionByName(lacking).unionByName(tests)


def findings(claims: DataFrame) -> DataFrame:
    """(review_id, place, severity, title, path, line, claims): findings of each review from the gravest on.

    Those of one severity come in the order of their sort, then by place. Claims
    are dealt out by review, which counting and numbering share.
    """
    one = spread(claims, "review_id").groupBy("review_id", "part", "severity", "title", "path", "line").agg(F.count("*").alias("claims"))
    grave = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    order = Window.partitionBy("review_id").orderBy(grave.desc(), "part", "path", "line", "title")
    return one.withColumn("place", F.row_number().over(order)).select("review_id", "place", "severity", "title", "path", "line", "claims")


def change_risk(lines: DataFrame, functions: DataFrame, signals: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """What a change of each line (query_id, path, line) risks.

    Returns query_id, kinds (sorted kinds of the signals on the line, those of the
    history left out), function_id and level of the innermost function around it
    (null outside of any), and, within ``depth`` steps of it, how many nodes
    depend on it (dependents), how many of these lie outside, and how many of the
    edges followed are ambiguous or unresolved, its own unresolved calls counted
    too. ``functions`` has id, path, start, end and level, ``edges`` what
    ``graph.impact`` takes.
    """
    marked = signals.where("source <> 'git'").select("path", "kind", F.col("start").alias("s"), F.col("end").alias("e"))
    kinds = overlap_join(lines, marked, "path", ("line", "line"), ("s", "e")).groupBy("query_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    around = overlap_join(lines, functions.select("path", "id", "level", F.col("start").alias("s"), F.col("end").alias("e")), "path", ("line", "line"), ("s", "e"))
    inner = around.groupBy("query_id").agg(F.min_by(F.struct("id", "level"), F.struct(F.col("e") - F.col("s"), -F.col("s"), "id")).alias("f")).select("query_id", F.col("f.id").alias("function_id"), "f.level")
    starts = inner.select(F.col("function_id").alias("start"), F.col("function_id").alias("node")).distinct()
    nodes = graph.impact(edges, starts, depth)
    met = nodes.groupBy(F.col("start").alias("function_id")).agg(F.count("*").alias("dependents"), F.count_if("boundary").alias("outside"))
    open_ends = edges.where("resolution = 2").join(starts.select("start", F.col("node").alias("src")).hint("merge"), "src").select("start", "resolution")
    walked = graph.impact_edges(edges, starts, nodes, depth).select("start", "resolution").unionByName(open_ends)
    ends = walked.groupBy(F.col("start").alias("function_id")).agg(F.count_if(F.col("resolution") == 1).alias("ambiguous"), F.count_if(F.col("resolution") == 2).alias("unresolved"))
    found = lines.select("query_id").join(kinds.hint("merge"), "query_id", "left").join(inner.hint("merge"), "query_id", "left").join(met.hint("merge"), "function_id", "left").join(ends.hint("merge"), "function_id", "left")
    none = F.array().cast("array<string>")
    return found.select("query_id", F.coalesce("kinds", none).alias("kinds"), "function_id", "level", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("dependents", "ambiguous", "unresolved", "outside")))
