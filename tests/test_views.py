from lodestone.operators import fences, findings, graph, node_details, onboarding


def claims_of(spark, hunks=(), comments=(), contracts=(), changes=(), gaps=(), missing=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return findings.finding_claims(
        make(hunks, "review_id int, path string, line int, strong int, weak int, subject string"),
        make(comments, "review_id int, path string, line int, comment string"),
        make(contracts, "review_id int, path string, line int, kind string, snippet string"),
        make(changes, "review_id int, path string, class string"),
        make(gaps, "review_id int, level string, text string"),
        make(missing, "review_id int, name string"),
    )


def told(claims):
    return [(r.severity, r.title, r.claims) for r in findings.findings(claims).orderBy("review_id", "place").collect()]


def test_findings_by_severity(spark):
    found = told(
        claims_of(
            spark,
            hunks=[(1, "a/x.c", 3, 0, 2, "fix"), (1, "a/x.c", 9, 1, 0, "work round"), (1, "a/x.c", 20, 0, 0, None)],
            comments=[(1, "a/x.c", 8, "HACK")],
            contracts=[(1, "a/x.c", n, kind, "s") for n, kind in enumerate(["timing", "isr", "hw_register"] * 3)],
            changes=[(1, "a/x.c", "code"), (1, "b.md", "docs")],
            gaps=[(1, "partial", "p"), (1, "insufficient", "i")],
            missing=[(1, "f"), (1, "g")],
        )
    )
    assert found == [
        ("STOP", "Alters code with an explicit workaround history (work round)", 1),
        ("STOP", "Changes code under a workaround comment", 1),
        ("DANGEROUS", "Alters code with bug-fix history (fix)", 1),
        ("DANGEROUS", "Touches timing, isr, hw register code", 6),
        ("RISKY", "Analysis is insufficient", 2),
        ("RISKY", "No related test found", 2),
    ]


def test_harmless_changes_and_nulls(spark):
    assert told(claims_of(spark, changes=[(1, "b.md", "docs")], gaps=[(1, "partial", "p")], missing=[(1, "f")])) == [("INFO", "Behaviour-free change", 1)]
    assert told(claims_of(spark)) == []
    nulls = claims_of(spark, hunks=[(1, None, None, 1, 0, None)], contracts=[(1, None, None, "isr", None)])
    assert told(nulls) == [("STOP", "Alters code with an explicit workaround history ()", 1), ("DANGEROUS", "Touches isr code", 1)]
    assert nulls.where("text IS NULL").count() == 0


def test_change_risk(spark):
    lines = spark.createDataFrame([(1, "a.c", 5), (2, "a.c", 50), (3, "b.c", 1)], "query_id int, path string, line int")
    functions = spark.createDataFrame([("outer", "a.c", 1, 20, "low"), ("inner", "a.c", 4, 6, "high")], "id string, path string, start int, end int, level string")
    signals = spark.createDataFrame([("a.c", 5, 5, "isr", "static"), ("a.c", 5, 5, "revert", "git"), ("a.c", 1, 9, "guard", "static")], "path string, start int, end int, kind string, source string")
    edges = spark.createDataFrame([("p", "inner", "calls", 0, "exact"), ("q", "p", "calls", 1, "name_match"), ("r", "inner", "calls", 2, "reference_index"), ("s", "q", "calls", 0, "exact"), ("t", "s", "calls", 0, "exact"), ("inner", "out", "calls", 2, "exact"), ("inner", "p", "co_changes", 1, "exact")], "src string, dst string, kind string, resolution int, method string")
    found = {r.query_id: tuple(r)[1:] for r in findings.change_risk(lines, functions, signals, edges).collect()}
    assert found == {1: (["guard", "isr"], "inner", "high", 4, 1, 2, 1), 2: ([], None, None, 0, 0, 0, 0), 3: ([], None, None, 0, 0, 0, 0)}


def test_impact_of_each_start(spark):
    edges = spark.createDataFrame([("b", "a", "calls", 0, "exact"), ("c", "b", "calls", 1, "exact"), ("a", "c", "calls", 0, "exact")], "src string, dst string, kind string, resolution int, method string")
    starts = spark.createDataFrame([("a", "a"), ("c", "c")], "start string, node string")
    found = graph.impact(edges, starts, 3).select("start", "node", "depth", "resolution").collect()
    assert {tuple(r) for r in found} == {("a", "b", 1, 0), ("a", "c", 2, 1), ("c", "a", 1, 0), ("c", "b", 2, 0)}


def test_assumptions_told_once(spark):
    rows = [("timing", "b.c", 9, "wait(1)", "static"), ("isr", "z.c", 1, "ISR()", "static"), ("timing", "b.c", 2, "wait(1)", "static"), ("timing", "a.c", 7, "wait(1)", "static"), ("guard", "a.c", 1, "x", "static"), ("isr", "a.c", 1, "y", "git")]
    signals = spark.createDataFrame(rows, "kind string, path string, start int, snippet string, source string")
    assert [(r.kind, r.path, r.start) for r in onboarding.assumptions(signals).collect()] == [("isr", "z.c", 1), ("timing", "a.c", 7), ("timing", "b.c", 2)]
    assert onboarding.assumptions(signals.limit(0)).count() == 0


def test_interfaces_resolved_first(spark):
    rows = [("o1", "n1", "reference_index", 2), ("o2", "n1", "reference_index", 2), ("o1", "n2", "reference_index", 0), ("x", "n3", "exact", 0)]
    edges = spark.createDataFrame(rows, "src string, dst string, method string, resolution int")
    assert [tuple(r) for r in onboarding.interfaces(edges).collect()] == [("n2", 1, True), ("n1", 2, False)]


def test_hidden_couplings(spark):
    files = spark.createDataFrame([("d/Lib.cpp",), ("d/Lib_can.cpp",), ("d/Lib.h",), ("d/Other.c",)], "path string")
    includes = spark.createDataFrame(
        [("v/a.c", 1, "d/Lib.h"), ("v/b.c", 1, "d/Lib.h"), ("v/c.c", 4, "d/Lib.h"), ("v/a.c", 2, "d/Lib_can_registers.h"), ("v/b.c", 2, "d/Lib_can_registers.h"), ("v/a.c", 3, "d/Lib_types.h"), ("v/a.c", 4, "d/Others.h"), ("v/a.c", 5, "d/Other.h")],
        "path string, line int, header string",
    )
    # Lib_types.h is of the public header's own module; Others.h of no source's name.
    assert {tuple(r) for r in onboarding.hidden_couplings(files, includes).collect()} == {("d/Lib_can_registers.h", "d/Lib_can.cpp", 2), ("d/Other.h", "d/Other.c", 1)}
    assert onboarding.hidden_couplings(files, includes.limit(0)).count() == 0


def test_fence_candidates(spark):
    signals = spark.createDataFrame(
        [
            (1, "a.c", 10, 10, "workaround_comment", "hack", None),
            (2, "a.c", 18, 19, "git_workaround", None, "c1"),
            (3, "a.c", 28, 28, "workaround_comment", "the silicon needs this delay", None),
            (4, "a.c", 28, 29, "git_workaround", None, "c2"),
            (5, "a.c", 90, 90, "git_revert", None, "c2"),
            (6, "a.c", 12, 12, "isr", None, None),
            (7, "b.c", 1, 1, "git_revert", None, None),
        ],
        "id int, path string, start int, end int, kind string, snippet string, detail string",
    )
    functions = spark.createDataFrame([("f", "a.c", 1, 60, "medium"), ("g", "a.c", 27, 29, "high")], "id string, path string, start int, end int, level string")
    commits = spark.createDataFrame([("c1", "Work-around for a glitch"), ("c2", "Tidy")], "sha string, subject string")
    found = {tuple(r) for r in fences.fence_candidates(signals, functions, commits).collect()}
    assert found == {("f", 1, 2, 18, 19, 3, 2, 4.5), ("g", 1, 3, 28, 28, 3, 1, 5.0)}
    assert fences.fence_candidates(signals.limit(0), functions, commits).count() == 0


def test_node_details(spark):
    nodes = spark.createDataFrame([("comp", "a.c", None, None), ("comp", "b.c", None, None), ("fn", "a.c", 5, 9)], "node_id string, path string, start int, end int")
    signals = spark.createDataFrame([("a.c", 1, "isr", 3), ("a.c", 7, "timing", 2), ("b.c", 2, "guard", 1)], "path string, start int, kind string, weight int")
    assert sorted((r.node_id, r.path, r.start) for r in node_details.node_signals(nodes, signals).collect()) == [("comp", "a.c", 1), ("comp", "a.c", 7), ("comp", "b.c", 2), ("fn", "a.c", 7)]
    commits, files = spark.createDataFrame([("s1", 1), ("s2", 2)], "sha string, at int"), spark.createDataFrame([("s1", "a.c"), ("s1", "b.c"), ("s2", "b.c")], "sha string, path string")
    assert sorted((r.node_id, r.sha) for r in node_details.node_commits(nodes, commits, files).collect()) == [("comp", "s1"), ("comp", "s2"), ("fn", "s1")]
    pairs = spark.createDataFrame([("a.c", "b.c", 5, 0.5), ("b.c", "z.c", 4, 0.4), ("y.c", "a.c", 3, 0.3)], "a string, b string, count int, strength double")
    assert sorted((r.node_id, r.path, r["count"]) for r in node_details.node_co_changes(nodes, pairs).collect()) == [("comp", "b.c", 5), ("comp", "y.c", 3), ("comp", "z.c", 4), ("fn", "b.c", 5), ("fn", "y.c", 3)]
    authors = spark.createDataFrame([("a.c", "x@x", "X", 2), ("b.c", "x@x", "Xx", 3), ("b.c", "y@y", None, 4)], "path string, email string, name string, commits int")
    assert sorted(tuple(r) for r in node_details.node_authors(nodes, authors).collect()) == [("comp", 1, "x@x", "X", 5), ("comp", 2, "y@y", None, 4), ("fn", 1, "x@x", "X", 2)]
