"""Quality rules: word statistics in SQL functions and learned decision lists.

The statistics and the rules run inside Spark's own expressions. Learning takes
the statistics of a bounded sample of labelled documents to the driver, where
sequential covering grows and prunes conjunctions of thresholds. The result is
one ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD_SQL, labelled_sample, quoted

WINDOW = 8  # words of a repeated passage


def _repeated_words(hashes: F.Column) -> F.Column:
    """A hash of every window of WINDOW words, by which those that occur twice or more are found.

    ``hashes`` holds a hash for each word.
    """
    n = F.size(hashes)
    windows = F.when(
        n >= WINDOW,
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))
    return windows


def base_statistics(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as one struct ``row``, with word counts and the statistics that the rules use.

    Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, and for
    the learned rules more ratios in a struct ``m``. What names the columns of
    ``docs`` have doesn't matter. A null text has no words.
    """
    docs = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    # Lengths that replacing leaves behind: regular expressions for sets of characters, plain search for one.
    without = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    without_one = lambda char: F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))
    step = docs.withColumn("_words", F.regexp_extract_all(text, F.lit(WORD_SQL), 0))
    step = step.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    step = step.withColumn("_windows", _repeated_words(F.col("_hashes")))
    step = step.withColumn("_lines", F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD_SQL))))
    step = step.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": without(r"[#*$%&|<>]+").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_bars": without_one("|"),
            "_marks": without_one("!"),
            "_upper": without(r"[A-Z]+"),
            "_distinct": F.size(F.array_distinct("_hashes")),
            "_repeats": F.size("_windows") > F.size(F.array_distinct("_windows")),
        }
    )
    # Windows with their places in the order of their hashes: equal ones are neighbours.
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("_placed", F.when(F.col("_repeats"), placed))
    at = F.filter(
        F.transform(
            "_placed",
            lambda x, i: F.when((x["h"] == F.get(F.col("_placed"), i - 1)["h"]) | (x["h"] == F.get(F.col("_placed"), i + 1)["h"]), x["i"]),
        ),
        lambda x: x.isNotNull(),
    )
    step = step.withColumn("_at", F.when(F.col("_repeats"), F.array_sort(at)))
    # Each window adds its words up to the start of the next one.
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_at"), i + 1) - p, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    words, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    measures = F.struct(
        F.col("n_words").cast("double").alias("words"),
        (F.col("word_chars") / words).alias("word_length"),
        (F.col("n_symbols") / words).alias("symbols_per_word"),
        (F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / words).alias("repeat_share"),
        (F.col("_distinct") / words).alias("distinct_share"),
        (F.col("_bars") / words).alias("bars_per_word"),
        (F.col("_marks") / words).alias("marks_per_word"),
        (F.col("_upper") / chars).alias("upper_share"),
        (F.size("_lines") / words).alias("lines_per_word"),
    )
    # A generator is a barrier: a filter on a statistic is else pushed below it, which
    # writes the nested expressions out many times over.
    found = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", measures.alias("m"))
    return step.select("row", F.explode(F.array(found)).alias("s")).select("row", "s.*")


MEASURES = ("words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share", "bars_per_word", "marks_per_word", "upper_share", "lines_per_word")


def base_failed() -> F.Column:
    """Under 20 words, or over 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """``measure <= at`` if ``below``, else ``measure > at``."""

    measure: str
    below: bool
    at: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.measure] <= self.at if self.below else row[self.measure] > self.at

    def column(self) -> F.Column:
        measure = F.col(f"m.{self.measure}")
        return measure <= F.lit(self.at) if self.below else measure > F.lit(self.at)

    def __str__(self) -> str:
        return f"{self.measure} {'<=' if self.below else '>'} {self.at:.6g}"


Rule = tuple[Test, ...]


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """Information gained by narrowing a rule from (p0, n0) to (p, n) covered rows."""
    if not p:
        return -math.inf
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _thresholds(values: list[float], most: int = 24) -> list[float]:
    """Up to ``most`` cut points between distinct values, at even ranks."""
    ordered = sorted(values)
    ranks = {round(i * (len(ordered) - 1) / (most + 1)) for i in range(1, most + 1)}
    cuts = {ordered[i] for i in ranks}
    return sorted(c for c in cuts if c < ordered[-1])


def _grow(bad: list[dict], good: list[dict], most: int) -> Rule:
    """Adds the test of the largest gain until no good row is covered or nothing gains."""
    rule: Rule = ()
    while good and len(rule) < most:
        best, test = 0.0, None
        for measure in MEASURES:
            for cut in _thresholds([r[measure] for r in bad] + [r[measure] for r in good]):
                p, n = sum(r[measure] <= cut for r in bad), sum(r[measure] <= cut for r in good)
                for below, hit, miss in ((True, p, n), (False, len(bad) - p, len(good) - n)):
                    gain = _gain(hit, miss, len(bad), len(good))
                    if gain > best:
                        best, test = gain, Test(measure, below, cut)
        if test is None:
            break
        rule = (*rule, test)
        bad, good = [r for r in bad if test.holds(r)], [r for r in good if test.holds(r)]
    return rule


def _worth(rule: Rule, bad: list[dict], good: list[dict]) -> float:
    """(hits - misses) / covered on the pruning rows."""
    p = sum(all(t.holds(r) for t in rule) for r in bad)
    n = sum(all(t.holds(r) for t in rule) for r in good)
    return (p - n) / (p + n) if p + n else -1.0


def _prune(rule: Rule, bad: list[dict], good: list[dict]) -> Rule:
    """Drops final tests while that doesn't lower the worth on the pruning rows."""
    while len(rule) > 1 and _worth(rule[:-1], bad, good) >= _worth(rule, bad, good):
        rule = rule[:-1]
    return rule


def learn(rows: list[dict], max_rules: int = 12, max_tests: int = 4, least_precision: float = 0.9) -> list[Rule]:
    """Sequential covering: rules for rejecting, each learned on what is left.

    ``rows`` hold the measures and ``y`` (1: good). Two thirds grow a rule, one
    third prunes it; rows that the rule covers are then removed. It stops at
    ``max_rules`` or when a rule's precision on the pruning rows is below
    ``least_precision``. Without rows of both classes the list is empty.
    """
    out: list[Rule] = []
    bad, good = [r for r in rows if not r["y"]], [r for r in rows if r["y"]]
    while bad and good and len(out) < max_rules:
        split = lambda xs, keep: [x for i, x in enumerate(xs) if (i % 3 == 0) != keep]
        rule = _grow(split(bad, True), split(good, True), max_tests)
        check_bad, check_good = split(bad, False), split(good, False)
        rule = _prune(rule, check_bad, check_good) if rule else rule
        hits = sum(all(t.holds(r) for t in rule) for r in check_bad)
        misses = sum(all(t.holds(r) for t in rule) for r in check_good)
        if not rule or hits < 2 or hits / (hits + misses) < least_precision:
            break
        out.append(rule)
        bad = [r for r in bad if not all(t.holds(r) for t in rule)]
        good = [r for r in good if not all(t.holds(r) for t in rule)]
    return out


def verdict(rules: list[Rule]) -> F.Column:
    """The ordered list as one conditional expression: the first rule that holds rejects."""
    out = None
    for rule in rules:
        condition = None
        for test in rule:
            condition = test.column() if condition is None else condition & test.column()
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn_from(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> list[Rule]:
    """Rules learned from at most ``per_class`` labelled documents of each quality.

    Documents that the base test rejects teach nothing, as no rule sees them.
    """
    sample = base_statistics(labelled_sample(docs, labels, "quality", per_class)).where(~base_failed())
    rows = sample.select("row.doc_id", "row.y", "m.*").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return learn([r.asDict() for r in rows])


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The statistics, base_failed and kept, beside the struct ``row`` of each document's own columns."""
    return base_statistics(docs).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def apply(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """All columns of ``docs`` with the statistics, base_failed and kept.

    A null or empty text has no words and fails the base test; one of any length
    is judged whole. Repeated rows are judged each on their own; an empty table
    gives no rows. Labels of one class teach no rule, and the base test alone
    judges. Columns of
    ``docs`` that have one of the added names, in any case, are replaced; all
    others come through, whatever their names.
    """
    own = [c for c in docs.columns if c.lower() not in ADDED]
    return judged(docs, rules).select(*(F.col("row").getField(c).alias(c) for c in own), *ADDED)


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that the base test and the rules keep, with their own columns only."""
    return judged(docs, rules).where("kept").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
