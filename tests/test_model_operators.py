"""Reach, impact, claims, components, changes, reviews, control tables and streams on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import claims, components, control, graph, ranking, review
from lodestone.sources import changes, repository


def test_reach_of_a_long_chain_and_of_each_start(spark):
    chain = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(60)] + [("n0", "n60")], "src string, dst string")
    start = spark.createDataFrame([("n0",)], "node string")
    assert sorted(r["depth"] for r in graph.reach(chain, start).collect()) == list(range(61))
    with pytest.raises(RuntimeError):
        graph.reach(chain, start, most_depth=20)
    tree = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "b"), ("d", "a")], "src string, dst string")
    starts = spark.createDataFrame([("a", "a"), ("b", "b")], "start string, node string")
    assert sorted(tuple(r) for r in graph.reach(tree, starts).collect()) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "b", 0), ("b", "c", 1), ("b", "d", 1)]


def test_impact(spark):
    rows = [("b", "a", "calls", "name_match", 0), ("c", "a", "calls", "name_match", 1), ("d", "b", "calls", "name_match", 1), ("d", "c", "calls", "name_match", 0), ("e", "d", "calls", "reference_index", 0), ("f", "e", "calls", "name_match", 0), ("a", "b", "calls", "name_match", 2), ("z", "a", "co_changes", "git_cochange", 0)]
    edges = spark.createDataFrame(rows, "src string, dst string, kind string, method string, resolution int")
    starts = spark.createDataFrame([("a",)], "node string")
    nodes = graph.impact(edges, starts, 3)
    assert sorted(tuple(r) for r in nodes.collect()) == [("b", 1, 0, False), ("c", 1, 1, False), ("d", 2, 1, False), ("e", 3, 1, True)]
    assert sorted((r["src"], r["dst"]) for r in graph.impact_edges(edges, starts, nodes, 3).collect()) == [("a", "b"), ("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d")]
    symbols = spark.createDataFrame([("sym:x#f", "x"), ("sym:y#g", "y")], "id string, path string")
    files = spark.createDataFrame([("comp:1", "x")], "id string, path string")
    found = graph.start_set(spark.createDataFrame([("comp:1",), ("file:y",), ("sym:z#h",)], "node string"), symbols, files)
    assert {r["node"] for r in found.collect()} == {"file:x", "file:y", "sym:x#f", "sym:y#g", "sym:z#h"}


def test_edge_counts(spark):
    edges = spark.createDataFrame([("a", "b", "calls", "name_match", "resolved"), ("a", "b", "uses_macro", "name_match", "ambiguous"), ("f", "b", "calls", "reference_index", "resolved"), ("a", "b", "co_changes", "git_cochange", "resolved")], "src string, dst string, kind string, method string, resolution string")
    rows = {r["node"]: r for r in graph.edge_counts(edges).collect()}
    assert (rows["b"]["in_resolved"], rows["b"]["in_ambiguous"], rows["b"]["outside"], rows["a"]["out_resolved"]) == (1, 1, 1, 1)


EVIDENCE = [(0, "E1", "code", "int x = 1;  // reset the\n chip", None), (0, "E2", "commit", "Fix the reset race", None), (0, "C1", "code", "claim one", "inferred"), (1, "E9", "code", "other", None)]
CLAIMS = [
    # id, status, basis, confidence, cite, quote -> status, reasons
    (1, "verified", "code_fact", None, ["E1"], "reset the chip", "verified", None),
    (2, "verified", "inference", None, ["E1"], None, "inferred", "basis is inference"),
    (3, "verified", "code_fact", None, [], None, "unknown", "no valid citation; inferred without a valid citation"),
    (4, "verified", "commit_statement", None, ["E1"], None, "inferred", "commit_statement without a commit citation"),
    (5, "verified", "comment_statement", "high", ["E2"], None, "inferred", "comment_statement without a code citation"),
    (6, "verified", "code_fact", None, ["E1"], "not there", "unknown", "quoted text is not in the cited evidence; inferred without a valid citation"),
    (7, "verified", "code_fact", None, ["C1"], None, "inferred", "cannot be more certain than the claims it is built on"),
    (8, "inferred", "odd", "odd", ["E9", "E2"], None, "inferred", None),
    (9, "sure", "code_fact", None, ["E1"], None, "unknown", None),
    (10, "verified", "code_fact", None, ["E1", "E2", "E7"], "x = 1 ... chip", "verified", None),
    (11, "verified", "code_fact", None, ["E1"], "chip … x = 1", "unknown", "quoted text is not in the cited evidence; inferred without a valid citation"),
    (12, "inferred", "code_fact", None, None, "x", "unknown", "inferred without a valid citation"),
]


def test_claims(spark):
    given = spark.createDataFrame([(i, 0, f" text {i} ", s, b, c, cite, q) for i, s, b, c, cite, q, *_ in CLAIMS] + [(13, 0, "  ", "verified", "code_fact", None, None, None)], "claim_id int, packet int, text string, status string, basis string, confidence string, cite array<string>, quote string")
    rows = {r["claim_id"]: r for r in claims.validate(given, spark.createDataFrame(EVIDENCE, "packet int, id string, kind string, text string, status string")).collect()}
    assert set(rows) == set(range(1, 13))
    for i, *_, status, reason in CLAIMS:
        assert (rows[i]["status"], rows[i]["reason"]) == (status, reason), i
    assert rows[5]["confidence"] == "high" and rows[2]["confidence"] == "low" and rows[1]["confidence"] is None and rows[2]["basis"] == "inference"
    assert [tuple(x) for x in rows[10]["citations"]] == [("code", "E1"), ("commit", "E2")] and rows[6]["citations"] == []


def test_prefixes_and_directories(spark):
    files = spark.createDataFrame([(p,) for p in ("d/AP_Imu_Inv.cpp", "d/AP_Imu_Bmi.cpp", "d/AP_Baro.cpp", "d/e/Other.cpp", "top.c")], "path string").withColumn("g", F.lit(1))
    length = lambda share: components.prefix_lengths(files, ["g"], F.split(T.stem(F.col("path")), "_"), share).first()["length"]
    assert (length(0.6), length(0.4), length(1.0)) == (1, 2, 0)
    assert components.common_directory(files.where("path LIKE 'd/%'"), ["g"]).first()["directory"] == "d"
    assert components.common_directory(files, ["g"]).first()["directory"] == ""
    assert [tuple(r) for r in components.largest_directories(files, 1).collect()] == [("d", 4)]


def test_communities(spark):
    paths = [f"lib/{g}{i}.c" for g in "ab" for i in range(5)] + ["lib/tools/x.c"]
    links = [(f"lib/{g}{i}.c", f"lib/{g}{j}.c", 3) for g in "ab" for i in range(5) for j in range(i)] + [("lib/a0.c", "lib/b0.c", 1), ("lib/a0.c", "lib/tools/x.c", 50)]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    found = {r["path"]: (r["directory"], r["community"]) for r in components.communities(files, spark.createDataFrame(links, "a string, b string, weight long")).collect()}
    assert len({found[f"lib/a{i}.c"] for i in range(5)}) == len({found[f"lib/b{i}.c"] for i in range(5)}) == 1 and len(set(found.values())) == 3
    many = spark.createDataFrame([(p,) for p in paths] + [(f"lib/z/AP_Z_{i}.c",) for i in range(30)], "path string")
    names = {r["path"]: r["name"] for r in components.components(many, spark.createDataFrame(links, "a string, b string, weight long"), "lib").collect()}
    assert names["lib/tools/x.c"] == "x" and names["lib/z/AP_Z_3.c"] == "AP_Z_0 (z) +29" and names["lib/a1.c"] == "a0 +4" and names["lib/b1.c"] == "b0 +4"


@pytest.mark.parametrize(
    ("path", "old", "new", "kind"),
    [
        ("a.md", "x", "y", "docs"),
        ("a.py", "x", "y", "code"),
        ("a.c", None, "int a;", "code"),
        ("a.c", "int a; // one\n", "int  a;\n/* two */", "comment_whitespace"),
        ("a.c", 'void f() { hal.printf("a"); }', 'void f() { hal.printf("b %d"); }', "log_string"),
        ("a.c", 'void f() { send("a"); }', 'void f() { send("b"); }', "code"),
        ("a.c", 'void f() { printf("a", g("x")); }', 'void f() { printf("a", g("y")); }', "code"),
        ("a.c", "#define A 1\nint a;", "#define A 2\nint a;", "code"),
        ("a.c", "int a = 1;", "int a = 2;", "code"),
    ],
)
def test_change_class(spark, path, old, new, kind):
    rows = spark.createDataFrame([(path, old, new)], "path string, old_text string, new_text string")
    assert changes.change_classes(rows).first()["change_class"] == kind


def test_diffs_and_line_ownership(spark):
    text = "diff --git a/x.c b/x.c\n--- a/x.c\n+++ b/x.c\n@@ -3,2 +3 @@ f()\n-one\n-two\n+--- three\n@@ -9,0 +9 @@\n+four\ndiff --git a/y b/y\n"
    diffs = spark.createDataFrame([(1, text)], "id int, text string")
    assert [(r["file_no"], r["hunk_no"], r["side"], r["text"]) for r in repository.diff_lines(diffs).orderBy("hunk_no", "place").collect()] == [(1, 0, "removed", "one"), (1, 0, "removed", "two"), (1, 0, "added", "--- three"), (1, 1, "added", "four")]
    zero, sha = "0" * 40, "a" * 40
    raw = spark.createDataFrame([(1, f":000000 100644 {zero} {sha} A\0new file.c\0:100644 000000 {sha} {zero} D\0old.c\0")], "id int, text string")
    assert sorted(tuple(r) for r in repository.raw_diff(raw).collect()) == [(1, "new file.c", None, sha), (1, "old.c", sha, None)]
    blame = f"{sha} 5 1 2\nauthor A\nfilename old.c\n{'b' * 40} 9 3 1\nsummary x\nfilename now.c"
    rows = repository.blame_ranges(spark.createDataFrame([("now.c", blame)], "path string, text string")).orderBy("start").collect()
    assert [tuple(r) for r in rows] == [("now.c", 1, 2, sha, "old.c", 5), ("now.c", 3, 3, "b" * 40, "now.c", 9)]


def test_review_joins(spark):
    hunks = spark.createDataFrame([(1, "a.c", 12, 1), (2, "a.c", 30, 0), (3, "a.c", 0, 0)], "hunk_id int, path string, old_start int, old_count int")
    functions = spark.createDataFrame([("outer", "a.c", 10, 20), ("inner", "a.c", 12, 13), ("late", "a.c", 30, 31), ("top", "a.c", 1, 2)], "id string, path string, start int, end int")
    assert sorted(tuple(r) for r in review.hunk_functions(hunks, functions).collect()) == [(1, "inner"), (2, "late"), (3, "top")]
    signals = spark.createDataFrame([("a.c", 12, 12, "timing", "static", "s", 2), ("a.c", 8, 8, "workaround_comment", "comment", "s", 3), ("a.c", 8, 8, "timing", "static", "s", 2), ("a.c", 12, 12, "git_bugfix", "git", "s", 1)], "path string, start int, end int, kind string, source string, snippet string, weight int")
    assert sorted((r["hunk_id"], r["kind"]) for r in review.hunk_signals(hunks, signals).collect()) == [(1, "timing"), (1, "workaround_comment")]
    parsed = spark.createDataFrame([("tests/test_a.c", [("read_fifo", 1), ("init", 2)]), ("lib/a.c", [("read_fifo", 1)])], "path string, names array<struct<name string, line int>>")
    touched = spark.createDataFrame([("f1", "read_fifo", "a.c", 11, 13, "low"), ("f2", "init", "a.c", 40, 41, "high"), ("f3", "quiet_one", "a.c", 50, 51, "low")], "id string, name string, path string, start int, end int, level string")
    tests = review.related_tests(touched, parsed)
    assert [tuple(r) for r in tests.collect()] == [("read_fifo", "tests/test_a.c")]
    assert [tuple(r) for r in review.untested(touched, tests, signals).collect()] == [("f2", "init")]
    final = review.final_verdicts(spark.createDataFrame([(1, "SAFE"), (2, "RISKY")], "review_id int, verdict string"), spark.createDataFrame([(1, "STOP", 1), (1, "RISKY", 2)], "review_id int, verdict string, at int"))
    assert sorted(tuple(r) for r in final.collect()) == [(1, "RISKY", True), (2, "RISKY", False)]
    row = spark.range(1).select(review.raised(F.lit("RISKY"), F.lit("STOP"), F.lit(1)).alias("a"), review.raised(F.lit("RISKY"), F.lit("STOP"), F.lit(0)).alias("b"), review.raised(F.lit("STOP"), F.lit("SAFE"), F.lit(2)).alias("c")).first()
    assert tuple(row) == ("STOP", "RISKY", "STOP")


def test_control_tables(spark):
    runs = spark.createDataFrame([(1, "s1", "done", 1), (2, "s1", "running", 2), (3, "s2", "failed", 1), (4, "s3", "queued", 1)], "run_id int, snapshot_id string, state string, at int")
    found = control.scan_once(spark.createDataFrame([("s1",), ("s2",), ("s3",)], "snapshot_id string"), runs)
    assert sorted((r["snapshot_id"], r["run_id"]) for r in found.collect()) == [("s1", 1), ("s2", None), ("s3", 4)]
    assert [r["state"] for r in control.mark_interrupted(runs).orderBy("run_id").collect()] == ["done", "failed", "failed", "failed"]
    ledger = spark.createDataFrame([(1, 5, False), (1, 7, True), (2, 9, True)], "run_id int, tokens int, cached boolean")
    assert sorted(tuple(r) for r in control.token_totals(ledger).collect()) == [(1, 5), (2, 0)]
    cache = spark.createDataFrame([("a", 1)], "k string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 3)], "k string, v int")
    assert sorted(tuple(r) for r in control.insert_absent(cache, new, ["k"]).collect()) == [("a", 1), ("b", 3)]
    assert sorted(tuple(r) for r in control.upsert(cache, new.dropDuplicates(), ["k"], "v").collect()) == [("a", 2), ("b", 3)]
    refs = spark.createDataFrame([("r1", "x"), ("r2", "x"), ("r1", "y")], "owner string, thing string")
    gone = control.delete_with_references(refs, spark.createDataFrame([("x",), ("y",), ("z",)], "thing string"), spark.createDataFrame([("r1",)], "owner string"), ("owner", "thing"))
    assert [r["thing"] for r in gone.collect()] == ["y"]
    row = spark.range(1).select(control.permalink(F.lit("o/n"), F.lit("abc"), F.lit("d/x.c"), F.lit(3), F.lit(5)).alias("a"), control.citation_label(F.lit("code"), F.lit("x.c"), F.lit(3), F.lit(3), F.lit(None)).alias("b")).first()
    assert tuple(row) == ("https://github.com/o/n/blob/abc/d/x.c#L3-L5", "x.c:3")


def test_text_functions(spark):
    row = spark.range(1).select(
        T.sentences(F.lit("One.  Two!\nThree? e.g. this")).alias("s"), T.comment_prose(F.lit("/* a\n * b\n */\n// c")).alias("c"), T.repository(F.lit("https://github.com/o/n.git")).alias("r"),
        T.repository(F.lit("nothing here")).alias("n"), T.percentage(F.lit(0.004)).alias("p"), T.percentage(F.lit(0.126)).alias("q"), T.is_test(F.lit("lib/tests/a.c")).alias("t"), T.is_comment_or_blank(F.lit("  * x")).alias("b"),
        T.without_prefix(F.lit("lib/a"), F.lit("lib/")).alias("w"), T.is_source(F.lit("a.S")).alias("src"), T.is_traced(F.lit("a.S")).alias("tr"),
    ).first()
    assert (row["s"], row["c"], row["r"], row["n"], row["p"], row["q"], row["t"], row["b"], row["w"], row["src"], row["tr"]) == (["One.", "Two!", "Three?", "e.g.", "this"], "a b c", "o/n", None, "<1%", "13%", True, True, "a", False, True)


def test_ranks_with_ties(spark):
    rows = [(i, 5.0 if i < 700 else float(i % 7)) for i in range(1000)]
    found = {r["i"]: r["rank"] for r in ranking.global_rank(spark.createDataFrame(rows, "i int, s double"), "s", "i", buckets=9).collect()}
    assert found == {i: k for k, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}


def test_streams(spark, tmp_path):
    from lodestone.streaming import history

    rows = [("2024-01-01 00:00:00", "u", "a"), ("2024-01-01 00:05:00", "u", "a"), ("2024-01-01 02:00:00", "u", "b")]
    spark.createDataFrame(rows, "at string, who string, kind string").withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    for name, shape in (("progress", lambda s: history.progress(s, "at", "kind")), ("sessions", lambda s: history.sessions(s, "at", "who"))):
        stream = shape(spark.readStream.schema("at timestamp, who string, kind string").parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert sorted(r["n"] for r in spark.table(name).collect()) == [1, 2]


def modularity(links, of):
    degree, inside = {}, 0.0
    for (a, b), w in links.items():
        degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w
        inside += 2 * w * (of[a] == of[b])
    both, total = sum(degree.values()), {}
    for v, d in degree.items():
        total[of[v]] = total.get(of[v], 0) + d
    return inside / both - sum((t / both) ** 2 for t in total.values())


def partitions(n, so_far=(), k=0):
    if len(so_far) == n:
        yield so_far
        return
    for c in range(k + 1):
        yield from partitions(n, (*so_far, c), max(k, c + 1))


def test_communities_against_all_partitions():
    dice = random.Random(1)
    for _ in range(40):
        nodes = [f"n{i}" for i in range(dice.randrange(3, 8))]
        links = {(a, b): float(dice.randrange(1, 6)) for i, a in enumerate(nodes) for b in nodes[i + 1 :] if dice.random() < 0.5}
        if links:
            best = max(modularity(links, dict(zip(nodes, p, strict=True))) for p in partitions(len(nodes)))
            assert modularity(links, components.louvain(links, nodes)) >= max(best - 0.06, 0 if best > 0 else best)
