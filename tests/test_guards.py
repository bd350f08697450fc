"""Guarded places, rule floors, line histories, renames and interval joins against sequential models."""

import random

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import guards, history_rules, intervals, renames
from lodestone.sources import line_history


def test_overlaps_by_brute_force(spark):
    dice = random.Random(1)
    some = lambda n, longest: [(i, dice.choice("ab") if i % 9 else None, lo := dice.choice([dice.randrange(-50, 400), dice.randrange(10**7)]), lo + int(dice.random() ** 6 * longest)) for i in range(n)]
    for points, ranges in ((some(300, 1), some(300, 60)), (some(200, 5000), some(200, 10**8)), (some(200, 30), some(200, 30))):
        left, right = (spark.createDataFrame([*rows, (999, "a", 9, 3), (998, "a", None, 3)], f"{n} int, key string, {n}_from long, {n}_to long") for n, rows in (("i", points), ("j", ranges)))
        meets = [(p[0], r[0]) for p in points for r in ranges if p[1] and p[1] == r[1] and p[2] <= r[3] and r[2] <= p[3]]
        found = intervals.overlap_join(left, right, "key", ("i_from", "i_to"), ("j_from", "j_to"))
        assert sorted((r["i"], r["j"]) for r in found.select("i", "j").collect()) == sorted(meets)
        single = left.withColumn("i_to", F.col("i_from"))
        inside = {(p[0], r[0]) for p in [*points, (999, "a", 9)] for r in ranges if p[1] and p[1] == r[1] and r[2] <= p[2] <= r[3]}
        found = intervals.overlap_join(single, right, "key", ("i_from", "i_from"), ("j_from", "j_to"))
        assert {(r["i"], r["j"]) for r in found.select("i", "j").collect()} == inside
        rest = intervals.overlap_join(single, right, "key", ("i_from", "i_from"), ("j_from", "j_to"), "left_anti")
        assert {r["i"] for r in rest.collect()} == {998, 999, *(p[0] for p in points)} - {i for i, _ in inside}


def test_many_lines_and_ranges_of_one_file_make_no_square(spark):
    n = 20_000
    lines = spark.range(n).select(F.lit("f").alias("path"), F.col("id").alias("line"))
    ranges = spark.range(n).select(F.lit("f").alias("path"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    met = intervals.overlap_join(lines, ranges, "path", ("line", "line"), ("a", "b"))
    assert met.count() == 2 * n - 1
    plan = met._jdf.queryExecution().toString()
    assert "_cell" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


SOURCE = """int spin() {
  // first
  // the fan stalls: a quirk
  // of old motors

  set(1);
#if X
  set(2); // hack: wait a bit longer
  set(3);
  set(4);
  set(5);
}
"""
CODE = ["int spin() {", "", "", "", "", "  set(1);", "", "  set(2);", "  set(3);", "  set(4);", "  set(5);", "}", ""]


def grown(spark, evidence, fn=(1, 12)):
    files = spark.createDataFrame([("f.c", SOURCE, "\n".join(CODE))], "path string, text string, code string")
    rows = spark.createDataFrame([(1, i, *e) for i, e in enumerate(evidence)], "guard_id int, nth int, start int, end int, weight int, is_comment boolean")
    r = guards.guarded_ranges(guards.line_classes(files), spark.createDataFrame([(1, "f.c", *fn)], "guard_id int, path string, fn_start int, fn_end int"), rows).first()
    return r["start"], r["end"], r["comment_line"], r["comment"]


def test_ranges_grow_around_comments(spark):
    # A comment block from any of its lines, down to the third line of code under it.
    assert grown(spark, [(3, 3, 3, True)]) == (2, 9, 2, "first the fan stalls: a quirk of old motors")
    # Beside code that line counts as the first one.
    assert grown(spark, [(8, 8, 3, True)]) == (8, 10, 8, "hack: wait a bit longer")
    assert grown(spark, [(10, 11, 5, False)]) == (10, 11, None, None)
    # The function's ends stop it, and fourteen lines.
    assert grown(spark, [(3, 3, 1, True), (8, 8, 1, True)], (3, 9)) == (3, 9, 3, "the fan stalls: a quirk of old motors")
    assert grown(spark, [(2, 40, 5, False)], (1, 40)) == (2, 15, None, None)
    # The weightiest comment is told, the first one on ties.
    assert grown(spark, [(3, 3, 1, True), (8, 8, 3, True)])[2:] == (8, "hack: wait a bit longer")


def by_hand(cards, most=8, of_file=3):
    taken = []
    for rank, i, path, keys in sorted(cards, key=lambda c: (-c[0], c[1])):
        twin = next((g for g in taken if g["keys"] & set(keys)), None)
        if twin:
            twin["copies"].append(i)
            twin["keys"] |= set(keys)
        elif len(taken) < most and sum(g["path"] == path for g in taken) < of_file:
            taken.append({"id": i, "path": path, "keys": set(keys), "copies": []})
    return [(g["id"], g["copies"]) for g in taken]


def test_cards_stand_for_their_copies(spark):
    dice = random.Random(5)
    made = {s: [(float(dice.randrange(6)), i, f"p{dice.randrange(4)}", [f"k{dice.randrange(25)}" for _ in range(dice.randrange(1, 4))]) for i in range(20)] for s in range(40)}
    rows = [(s, i, path, rank, keys) for s, cards in made.items() for rank, i, path, keys in cards]
    found = {}
    for r in guards.group_cards(spark.createDataFrame(rows, "snapshot int, id int, path string, rank double, keys array<string>"), "snapshot").orderBy("snapshot", "card_no").collect():
        found.setdefault(r["snapshot"], []).append((r["id"], r["copies"]))
    assert found == {s: by_hand(cards) for s, cards in made.items()}
    # A third copy that shares a key with the second alone joins the first.
    chain = [("s", 1, "a", 3.0, ["x"]), ("s", 2, "a", 2.0, ["x", "y"]), ("s", 3, "a", 1.0, ["y"])]
    assert guards.group_cards(spark.createDataFrame(chain, "s string, id int, path string, rank double, keys array<string>"), "s").first()["copies"] == [2, 3]


def test_titles_and_clips(spark):
    rows = [("drv: keep the delay", "subject", "x y.", None), ("tidy", "body", "Plain. A quirk of chips: wait, then go!", None), ("tidy", None, None, "u"), (None, None, None, "drv: old"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "subject string, stated string, comment string, undone string")
    title = guards.title(F.col("subject"), F.col("stated"), F.col("comment"), F.col("undone"), F.lit("f"))
    assert [r[0] for r in df.select(title).collect()] == ["Keep the delay", "A quirk of chips: wait, then go", "Tidy", "Reverted before: old", "f: code with a workaround history"]
    cut = spark.createDataFrame([("one two, three",), ("short",), ("abcdefghijkl",)], "t string").select(T.clip_words(F.col("t"), 10), T.clip_mark(F.col("t"), 9)).collect()
    assert [tuple(r) for r in cut] == [("one two…", "one two,…"), ("short", "short"), ("abcdefghijk…", "abcdefgh…")]


HISTORY = "id int, pos int, sha string, subject string, body string, author_name string, authored_at timestamp, bugfix boolean, rationale boolean, revert boolean, revert_of string"


def history(spark, *rows):
    dated = [(1, i, sha, subject, body, "A", day, bug, why, rev, of) for i, (sha, subject, body, day, bug, why, rev, of) in enumerate(rows)]
    return spark.createDataFrame(dated, HISTORY.replace("timestamp", "string")).withColumn("authored_at", F.to_timestamp("authored_at"))


def test_origins_reverts_and_key_commits(spark):
    rows = history(
        spark,
        ("a1", "Revert the wait", "This reverts commit b2.\n\nit broke start up", "2024-03-10 12:00:00", False, False, True, "b2"),
        ("b2", "drop the wait", "", "2024-03-08 00:00:00", False, False, False, None),
        ("c3", "drv: work-around in code", "", "2024-02-01 00:00:00", True, False, False, None),
        ("d4", "tidy", "Say so. An erratum needs it. End.", "2024-01-02 00:00:00", True, False, False, None),
        ("e5", "quirks", "", "2024-01-01 00:00:00", False, False, False, None),
    )
    o = guards.origins(rows, "id").first()
    assert (o["sha"], o["stated"], o["said"]) == ("e5", "subject", "quirks")
    o = guards.origins(rows.where("sha IN ('b2', 'd4')"), "id").first()
    assert (o["sha"], o["stated"], o["said"]) == ("d4", "body", "An erratum needs it.")
    none = rows.limit(0).select("sha", "subject", "author_name", "authored_at")
    r = guards.reverted_before(rows, none, "id").first()
    assert (r["revert_sha"], r["change_sha"], r["days"], r["reason"]) == ("a1", "b2", 3, "it broke start up")
    # A change outside of the history counts if it is known; else nothing is said.
    assert guards.reverted_before(rows.where("sha <> 'b2'"), none, "id").count() == 0
    known = rows.where("sha = 'b2'").select("sha", "subject", "author_name", "authored_at")
    assert guards.reverted_before(rows.where("sha <> 'b2'"), known, "id").first()["change_subject"] == "drop the wait"
    k = history_rules.key_commits(rows, "id").first()
    assert (k["sha"], k["revert"], k["explicit"]) == ("a1", True, False)
    assert history_rules.key_commits(rows.where("sha IN ('b2', 'c3')"), "id").first()["explicit"]
    assert history_rules.key_commits(rows.where("sha = 'b2'"), "id").count() == 0


def test_floors(spark):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)

    def floor(free=False, complete="complete", tests=1, history=(), comments=(), signals=(), touched=()):
        reasons = history_rules.floor_reasons(
            make([(1, free, complete, tests)], "case_id int, behaviour_free boolean, completeness string, related_tests int"),
            make([(1, i, *h) for i, h in enumerate(history)], "case_id int, nth int, where string, sha string, subject string, revert boolean, bugfix boolean, rationale boolean, explicit boolean"),
            make([(1, i, *c) for i, c in enumerate(comments)], "case_id int, nth int, where string, comment string"),
            make([(1, i, *s) for i, s in enumerate(signals)], "case_id int, nth int, where string, kind string"),
            make([(1, i, *t) for i, t in enumerate(touched)], "case_id int, nth int, name string, level string"),
        )
        told = [(r["rule"], r["detail"]) for r in reasons.orderBy("place").collect()]
        words = guards.because(reasons, history_rules.floors(reasons)).first()["because"]
        return history_rules.floors(reasons).first()["floor"], told, words

    assert floor() == ("SAFE", [("no_rule", "complete analysis, no critical signals, related tests found")], ["no rule"])
    assert floor(free=True, tests=0, comments=[("a:1", "x")])[:2] == ("SAFE", [("change_class", "Only comments, whitespace, log/message strings or docs change: no behaviour change.")])
    risky = floor(complete="partial", tests=0, touched=[(f"f{i}", lv) for i, lv in enumerate(["low", "high", "medium", "high", "high", "high"])])
    assert risky[0] == "RISKY" and [r for r, _ in risky[1]] == ["incomplete_analysis", "critical_symbol", "no_related_tests"] and risky[1][1][1] == "f1 (high), f2 (medium), f3 (high), f4 (high)"
    assert floor(complete="partial")[0] == "SAFE"  # nothing is touched
    contract = floor(signals=[(f"a:{i}", k) for i, k in enumerate(["timing", "bus_io", "isr", "timing", "timing", "timing"])])
    assert contract[:2] == ("DANGEROUS", [("contract_signal", "timing on a:0, a:3, a:4 (+1)"), ("contract_signal", "isr on a:2")])
    assert contract[2] == ["touches timing calls", "touches an interrupt handler"]
    said = [("a:1", "0123456789abc", "s", *flags) for flags in ((True, True, False, False), (False, True, False, True), (False, False, True, False), (False, False, False, False))]
    stop = floor(history=said, comments=[("a:9", "hack")])
    assert stop[0] == "STOP" and [r for r, _ in stop[1]] == ["reverted_before", "explicit_workaround", "workaround_comment", "bugfix_history"]
    assert stop[1][3][1] == 'a:1: shaped by HW/timing commit 0123456789 "s"' and stop[2][0] == "a change to these lines was reverted before"


def test_line_history(spark):
    record = lambda sha, message, diff: f"\x1e{sha}\x1fAda\x1fa@b\x1f60\x1f{message}\x1d\n{diff}"
    text = record("s1", "Fix it\n\nmore\x1fof it ", "--- a/f\n+++ b/f\n@@ -1 +1 @@\n-old\n+new  line\n" + "+x\n" * 50) + record("s2", "first", "+++ b/f\n+ne w line\n+y") + "\x1eno mark"
    logs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    found = line_history.line_history(logs, 2)
    one, two = found.orderBy("pos").collect()
    assert (one["sha"], one["subject"], one["body"], one["bugfix"], one["removed"], len(one["added"]), one["truncated"]) == ("s1", "Fix it", "more\x1fof it", True, ["old"], 40, True)
    assert (two["pos"], two["added"], two["authored_at"].timestamp()) == (1, ["ne w line", "y"], 60)
    now = spark.createDataFrame([(1, "new line"), (1, "  "), (2, "new line")], "id int, line string")
    assert [tuple(r) for r in line_history.introduced_by(found, now).collect()] == [(1, "s2")]
    assert line_history.introduced_by(found, now.where("line = '  '")).count() == 0


def sequential(changes, files):
    alias, out = {f: f for f in files}, []
    for commit, change, status, path, old in sorted(changes):
        if path in alias:
            out.append((commit, change, alias[path]))
            if status.startswith("R") and old is not None:
                alias[old] = alias[path]
    return out


def test_renames_by_a_sequential_model(spark):
    dice = random.Random(9)
    for names, today in ((6, 2), (30, 5), (4, 0)):
        changes = [(c, k, dice.choice(["M", "R", "R", "C"]), f"n{dice.randrange(names)}", f"n{dice.randrange(names)}") for c in range(60) for k in range(dice.randrange(4))]
        files = [f"n{i}" for i in range(today)]
        rows = spark.createDataFrame([*changes, (99, 0, "M", None, None)], "commit int, change int, status string, path string, old_path string")
        found = renames.follow_renames(rows, spark.createDataFrame([(f,) for f in files], "path string")).collect()
        assert sorted(tuple(r) for r in found) == sorted(sequential(changes, files)), (names, today)


def test_a_long_chain_of_renames_and_a_name_that_is_used_again(spark):
    chain = [(i, 0, "R100", f"n{i}", f"n{i + 1}") for i in range(40)] + [(40, 0, "M", "n40", None), (41, 0, "M", "n3", None), (2, 1, "M", "n9", None)]
    rows = spark.createDataFrame(chain, "commit int, change int, status string, path string, old_path string")
    found = {(r["commit"], r["change"]): r["file"] for r in renames.follow_renames(rows, spark.createDataFrame([("n0",), ("n9",)], "path string")).collect()}
    assert found[40, 0] == found[41, 0] == "n0" and found[2, 1] == "n9" and found[9, 0] == "n0"


def test_rounds_follow_the_blocks_not_the_renames(spark, monkeypatch):
    """A file that went by two names in turn, 600 renames long, is followed through 8 blocks in a few rounds."""
    written = []
    monkeypatch.setattr(renames, "stored", lambda df, name, real=renames.stored: written.append(name) or real(df, name))
    rows = [(2 * k + step, 0, "R" if step else "M", f"n{k % 2}", f"n{(k + 1) % 2}" if step else None) for k in range(600) for step in (0, 1)]
    changes = spark.createDataFrame(rows, "commit long, change int, status string, path string, old_path string")
    found = renames.follow_renames(changes, spark.createDataFrame([("n0",)], "path string")).collect()
    assert sorted((r["commit"], r["file"]) for r in found) == [(c, "n0") for c in range(1200)]
    assert written.count("heads") <= 5
