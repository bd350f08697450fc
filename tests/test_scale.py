"""What keeps steps in proportion to their input: who meets whom, and what is never broadcast."""

import random

from pyspark.sql import functions as F

from lodestone.operators import cochange, components, findings, graph_view, history_rules, intervals, lineage, lookup, meters, model_stats, search, signals, structure
from lodestone.plans import history, lookups, sources_model
from lodestone.sources import c_structure


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_intervals_of_one_key_meet_near_ones_only(spark):
    """Without a length in common cells, 2000 hunks and 2000 signals of one file made 4 million pairs and more."""
    hunks = spark.range(2000).selectExpr("id AS hunk", "1 AS path", "id * 100 AS first", "id * 100 + 2 AS last")
    marks = spark.range(2000).selectExpr("id AS mark", "1 AS path", "id * 100 + 1 AS start", "id * 100 + 4 AS end")
    left, right, on = intervals._meeting(hunks, marks, "path", ("first", "last"), ("start", "end"))
    assert left.join(right, on).count() < 3 * 2000
    met = intervals.overlap_join(hunks, marks, "path", ("first", "last"), ("start", "end"))
    assert sorted((r.hunk, r.mark) for r in met.select("hunk", "mark").collect()) == [(i, i) for i in range(2000)]


def test_long_and_short_intervals_meet_once(spark):
    """Every pair that overlaps comes once, whichever is longer and however long."""
    spans = [(0, 0), (0, 1), (3, 9), (7, 8), (8, 8), (5, 700), (511, 513), (-20, 3), (600, 600), (-(1 << 26), 1 << 26), (9, 4)]
    rows = spark.createDataFrame([(i, 1, a, b) for i, (a, b) in enumerate(spans)], "id long, path int, a long, b long")
    met = intervals.overlap_join(rows.withColumnRenamed("id", "one"), rows.selectExpr("id AS two", "path", "a AS c", "b AS d"), "path", ("a", "b"), ("c", "d"))
    want = [(i, k) for i, (a, b) in enumerate(spans) for k, (c, d) in enumerate(spans) if a <= b and c <= d and a <= d and b >= c]
    assert sorted((r.one, r.two) for r in met.select("one", "two").collect()) == want


def test_overlaps_are_never_broadcast(spark):
    points = spark.range(10).selectExpr("id", "1 AS path", "id AS at", "id AS at_end")
    ranges = spark.range(10).selectExpr("1 AS path", "id AS lo", "id + 3 AS hi")
    for how in ("inner", "left_anti", "left_semi"):
        assert "Broadcast" not in plan(intervals.overlap_join(points, ranges, "path", ("at", "at_end"), ("lo", "hi"), how))


def rows_of_joins(df):
    """The most rows that a join of the executed plan yields."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    top, most, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(top)
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        inner = node.executedPlan() if name.startswith("AdaptiveSparkPlan") else node.plan() if "QueryStage" in name else None
        todo += [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_queries_of_the_same_words_are_searched_once(spark):
    """500 queries and 500 texts with one word made 250000 rows before the best were taken."""
    hays = spark.range(500).selectExpr("0 AS step", "id AS nth", "'a timing line' AS hay", "1.0D AS factor", "0.0D AS bonus", "concat('line ', id) AS line")
    queries = spark.range(500).selectExpr("id AS query_id", "CASE WHEN id % 2 = 0 THEN 'timing line' ELSE 'Line, timing!' END AS query")
    found = search.search(queries, hays, 3)
    assert rows_of_joins(found) < 10_000
    assert sorted((r.query_id, r.place, r.line) for r in found.collect()) == [(q, k + 1, f"line {k}") for q in range(500) for k in range(3)]


def test_targets_of_one_file_share_its_first_signals(spark):
    """1000 targets and 1000 signals of one file made a million rows, for names and for symbols."""
    marks = spark.range(1000).selectExpr("id AS signal_id", "'src/a.c' AS path", "id * 10 AS start")
    symbols = spark.range(1000).selectExpr("concat('f', id) AS name", "concat('f', id) AS short_name", "'src/a.c' AS path", "id * 10 AS start", "id * 10 + 5 AS end")
    targets = spark.range(2000).selectExpr("id AS query_id", "CASE WHEN id < 1000 THEN concat('f', id) ELSE 'a.c' END AS name")
    found = lookup.signals_for(marks, symbols, targets, ["start", "signal_id"], 3)
    assert rows_of_joins(found) < 20_000
    want = [(q, q) for q in range(1000)] + [(q, k) for q in range(1000, 2000) for k in range(3)]
    assert sorted((r.query_id, r.signal_id) for r in found.collect()) == want


def test_the_graph_of_files_is_never_broadcast(spark):
    """Parsed and exploded rows are many times as large as estimated."""
    parsed = c_structure.structure(spark.createDataFrame([("a.cpp", "#define LIMIT_A 1\nint f() { return g(LIMIT_A); }\nint g(int n) { return n; }\n")], "path string, text string"))
    symbols = structure.symbols(parsed)
    edges = structure.edges(parsed, symbols, parsed.select("path"), parsed)
    assert "Broadcast" not in plan(edges)
    assert "Broadcast" not in plan(signals.symbol_factors(symbols, signals.code_signals(parsed), edges))


def test_texts_made_of_a_small_table_are_spread(spark):
    """The key column of a table of parts is one file, which one task read."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df in (sources_model._files(spark, "/root/testdata/sf0.001"), lookups._diffs(spark, "/root/testdata/sf0.001")):
        assert df.rdd.getNumPartitions() == parts


def test_reaches_are_never_broadcast(spark, monkeypatch):
    """Each round sent its front, what was seen and the links to the driver and back."""
    plans = []
    monkeypatch.setattr(meters, "cut", lambda df: plans.append(plan(df)) or lineage.cut(df))
    edges = spark.range(1, 60).selectExpr("id AS src", "id div 2 AS dst", "'calls' AS kind", "'exact' AS method", "'resolved' AS resolution")
    starts = spark.range(1, 4).selectExpr("id AS start", "id AS node")
    nodes = spark.range(60).selectExpr("id AS node", "concat('f', id) AS path", "true AS symbol")
    files = nodes.select("path")
    found = meters.reach_meter(edges, starts, nodes, files, files.selectExpr("'c' AS component", "path"))
    assert len(plans) > 5 and not any("BroadcastHash" in p for p in plans)
    assert "BroadcastHash" not in plan(found)
    assert [(r.start, r.files, r.symbols, r.components, r.by_depth) for r in found.orderBy("start").collect()] == [
        (1, 58, 58, 0, [2, 4, 8, 16, 28]),
        (2, 30, 30, 0, [2, 4, 8, 16]),
        (3, 26, 26, 0, [2, 4, 8, 12]),
    ]


def test_names_of_symbols_are_never_broadcast(spark):
    symbols = spark.range(20).selectExpr("id", "concat('a::f', id) AS name", "concat('f', id) AS short_name")
    found = lookup.symbol_lookup(symbols, symbols.selectExpr("id AS query_id", "name"), ["id"])
    assert "Broadcast" not in plan(found)
    assert found.select("query_id", "id", "total").orderBy("id").collect() == [(i, i, 1) for i in range(20)]


def shuffles(df):
    return [line for line in plan(df).splitlines() if "Exchange" in line]


def test_lines_are_dealt_out_before_repeats_are_dropped(spark):
    """Tasks that read a large table held all their rows, as hardly one repeats."""
    touched = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (2, 2), (3, 2), (3, 1), (4, None)], "commit long, file long")
    once = cochange.once(touched)
    assert len(shuffles(once)) == 1 and "REPARTITION_BY_NUM" in shuffles(once)[0]
    assert len(shuffles(cochange.commit_pairs(touched))) == 2  # one for the files and one for their number, both by commit
    assert cochange.pairs(touched).collect() == [(1, 2, 3, 1.0)]
    commits = history._file_commits(spark, "/root/testdata/sf0.001")
    assert len([s for s in shuffles(commits) if "l_orderkey" in s]) == 1


def test_claims_of_a_review_move_once(spark):
    """Counting and numbering each had a shuffle, and tasks got as many claims as pack into a size."""
    rows = "review_id long, part int, severity string, title string, path string, line int, text string"
    claims = spark.createDataFrame([(1, 1, "STOP", "t", "p", 1, "x"), (1, 1, "STOP", "t", "p", 1, "y"), (1, 2, "INFO", "u", None, None, "z")], rows)
    found = findings.findings(claims)
    assert len(shuffles(found)) == 1 and "REPARTITION_BY_NUM" in shuffles(found)[0]
    assert [(r.place, r.severity, r.claims) for r in found.orderBy("place").collect()] == [(1, "STOP", 2), (2, "INFO", 1)]


def test_edges_with_views_are_dealt_out(spark):
    """By their packed size too many edges with texts of views came to one task."""
    edges = spark.createDataFrame([("a", "b", "calls", 0, 2, 1), ("b", "c", "calls", 1, 3, 2)], "src string, dst string, kind string, resolution int, weight int, ord long")
    places = spark.createDataFrame([("a", "x/a.c"), ("b", "y/b.c"), ("c", "z/c.c")], "node string, path string")
    files = places.where("node <> 'c'").select("path")
    symbols = spark.createDataFrame([("a",), ("b",)], "id string")
    nodes, shown = graph_view.graph_view(edges, places, files, files.selectExpr("concat('c', left(path, 1)) AS component", "path"), symbols)
    assert sum("REPARTITION_BY_NUM" in s for s in shuffles(shown)) >= 2
    assert sorted(map(tuple, shown.where("level = 'component'").collect())) == [("component", "cx", "cy", "calls", 0, 2), ("component", "cy", "dir:z", "calls", 1, 3)]
    assert nodes.where("boundary").count() == 3


def test_connected_parts_have_the_communities_of_their_directory(spark, monkeypatch):
    """One task took a whole directory, though its connected parts don't bear on each other."""
    links = {}
    for part in range(3):  # two triangles with a bridge, three times, mixed by name, and a heavier one
        at = lambda k, part=part: f"d/{k}{part}"
        for a, b in ((0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)):
            links[at(a), at(b)] = 1.0 + part * (a + b)
    paths = sorted({p for pair in links for p in pair} | {"d/alone"})
    whole = components.louvain(links, paths)
    files = spark.createDataFrame([(p,) for p in [*paths, "e/a", "e/b", "e/c", "e/d"]], "path string")
    pairs = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "a string, b string, weight double")
    parts = {r.node: r.part for r in components.connected(pairs).collect()}
    assert parts == {p: f"d/0{p[-1]}" for p in paths if p != "d/alone"}
    found = components.communities(files, pairs)
    assert "part" in next(line for line in plan(found).splitlines() if "FlatMapGroupsInPandas" in line)
    assert {r.path: r.community for r in found.where("directory = 'd'").collect()} == whole
    assert [r.community for r in found.where("directory = 'e'").collect()] == [0] * 4


def test_chains_are_one_part(spark):
    chain = spark.range(40).selectExpr("format_string('%03d', id) AS a", "format_string('%03d', id + 1) AS b")
    assert components.connected(chain).where("part = '000'").count() == 41


def test_links_shrink_from_round_to_round(spark, monkeypatch):
    """Every round went over all links, and each was worked out twice."""
    pairs = [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(60)] + [("hub", f"s{k:02d}") for k in range(30)] + [("x", "y"), ("y", "z"), ("z", "x"), ("x", "x"), ("y", "x"), (None, "x")]
    links = spark.createDataFrame(pairs, "a string, b string")
    want = {**{f"c{k:03d}": "c000" for k in range(61)}, "hub": "hub", **{f"s{k:02d}": "hub" for k in range(30)}, **dict.fromkeys("xyz", "x")}
    sizes, kept = [], components.stored

    def stored(df, name):
        out = kept(df, name)
        sizes.extend([out.count()] if name == "links" else [])
        return out

    monkeypatch.setattr(components, "stored", stored)
    assert {r.node: r.part for r in components.connected(links).collect()} == want and sizes == [93]
    monkeypatch.setattr(components, "FEW_LINKS", 0)
    assert {r.node: r.part for r in components.connected(links).collect()} == want
    rounds = sizes[1:]
    assert len(rounds) > 2 and rounds[-1] == 0 and all(b < a for a, b in zip(rounds, rounds[1:])) and sum(rounds) < 4 * rounds[0]


def test_rules_of_a_floor_are_worked_out_once(spark):
    """The floor and the cases without a rule each worked all rules out again."""
    cases = spark.createDataFrame([(1, True, "complete", 1), (2, False, "partial", 0), (3, False, "complete", 2), (3, False, "complete", 2), (None, True, "complete", 1)], "case_id long, behaviour_free boolean, completeness string, related_tests int")
    none = spark.createDataFrame([], "case_id long, nth int, where string, sha string, subject string, revert boolean, bugfix boolean, rationale boolean, explicit boolean, comment string, kind string, name string, level string")
    reasons = history_rules.floor_reasons(cases, none, none, none, none)
    both = history_rules.with_floors(reasons)
    assert len(shuffles(both)) == len(shuffles(reasons))
    assert sum("no_rule" in line for line in plan(both).splitlines()) == 1
    want = sorted(map(str, reasons.join(history_rules.floors(reasons).withColumnRenamed("case_id", "c"), F.col("case_id").eqNullSafe(F.col("c"))).select("case_id", "rule", "verdict", "floor").collect()))
    assert sorted(map(str, both.select("case_id", "rule", "verdict", "floor").collect())) == want
    assert sorted((r.case_id or 0, r.rule) for r in both.collect()) == [(0, "change_class"), (0, "no_rule"), (1, "change_class"), (2, "no_related_tests"), (3, "no_rule"), (3, "no_rule")]


def test_intervals_are_in_cells_of_the_other_sides_lengths(spark):
    """A line had a row for every length of cells, most of which no range has."""
    some = random.Random(4)
    rows = lambda n, most: [(i, some.choice("ab"), (s := some.randrange(3000)), s + some.randrange(-1, most)) for i in range(n)]
    for most in ((25, 9), (9, 25), (1, 600), (600, 1)):
        left = spark.createDataFrame([*rows(60, most[0]), (60, "a", None, 5)], "i int, k string, s int, e int")
        right = spark.createDataFrame([*rows(60, most[1]), (60, None, 1, 5)], "j int, k string, t int, f int")
        known = intervals.lengths(left, ("s", "e")), intervals.lengths(right, ("t", "f"))
        found = intervals.overlap_join(left, right, "k", ("s", "e"), ("t", "f"), known=known).select("i", "j").collect()
        want = [(a.i, b.j) for a in left.collect() for b in right.collect() if None not in (a.s, b.k) and a.k == b.k and a.s <= a.e and b.t <= b.f and a.s <= b.f and a.e >= b.t]
        assert sorted(map(tuple, found)) == sorted(want)
    ranges = spark.createDataFrame([(k, "p", 25 * k, 25 * k + 24) for k in range(40)], "id int, path string, start int, end int")
    lines = spark.createDataFrame([("p", k, k + 3) for k in range(960)], "path string, s int, e int")
    known = intervals.lengths(ranges, ("start", "end")), intervals.lengths(lines, ("s", "e"))
    moved = intervals._meeting(ranges, lines, "path", ("start", "end"), ("s", "e"), known)[1].count()
    assert moved < 2 * 960 < intervals._meeting(ranges, lines, "path", ("start", "end"), ("s", "e"))[1].count()


def test_key_commits_of_lines_move_once(spark):
    """Lines met their commits in a shuffle by commit, and points were dealt out twice."""
    ranges = spark.createDataFrame([(1, "a", 10, 20), (2, "a", 40, 41)], "id int, path string, start int, end int")
    blame = spark.createDataFrame([("a", 1, 14, "x"), ("a", 15, 17, "y"), ("a", 40, 40, "z")], "path string, start int, end int, sha string")
    commits = spark.createDataFrame([(x, False, False, x == "y") for x in "xyz"], "sha string, revert boolean, rationale boolean, bugfix boolean")
    found = model_stats.key_commit_in(ranges, blame, commits)
    # Both sides to their cells, and what met to its range; the one by commit and a second one by range are gone.
    moved = [s for s in shuffles(found) if "hashpartitioning" in s]
    assert len(moved) == 3 and not any("sha" in s for s in moved), moved
    assert sorted(map(tuple, found.collect())) == [(1, "y", 6), (2, "z", 1)]


def test_repeats_are_found_by_hashes(spark):
    """All columns of all rows were shuffled to find repeats."""
    rows = spark.createDataFrame([(1, "a", None), (1, "a", 2.0), (2, None, -0.0), (3, "", float("nan"))], "k int, t string, x double")
    assert not shuffles(lineage.distinct_rows(rows))
    twice = rows.unionByName(rows.where("k <> 1")).unionByName(spark.createDataFrame([(2, None, 0.0)], rows.schema))
    found = lineage.distinct_rows(twice)
    assert found.columns == rows.columns and found.count() == 4 == twice.distinct().count()
