"""Displayed diffs and look-ups on small literal inputs."""

from lodestone.operators import lookup
from lodestone.sources import display_diff as D


def test_display_diff(spark):
    text = (
        "diff --git a/a.c b/a.c\n--- a/a.c\n+++ b/a.c\n@@ -3,3 +3,3 @@ f()\n x\n--- y\n+++ z\n w\n"
        "diff --git a/n.c b/n.c\nnew file mode 100644\n--- /dev/null\n+++ b/n.c\n@@ -0,0 +1,2 @@\n+p\r@@ -1 +1 @@\n+q\n\\ No newline at end of file\n"
        "diff --git a/i b/i\nBinary files /dev/null and b/i differ\ndiff --git a/mode.sh b/mode.sh\nold mode 100644\nnew mode 100755\n"
    )
    diffs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    files = [tuple(r)[1:] for r in D.diff_files(diffs, most_lines=3).orderBy("file_no").collect()]
    assert files == [
        (1, "a.c", "modified", False, 1, 1, True),
        (2, "n.c", "added", False, 2, 0, False),
        (3, "i", "added", True, 0, 0, False),
        (4, "mode.sh", "modified", False, 0, 0, False),
    ]
    rows = [tuple(r)[1:] for r in D.diff_rows(diffs, most_lines=3).orderBy("file_no", "row_no").collect()]
    assert rows == [
        (1, 1, 1, "ctx", 3, 3, "x"), (1, 1, 2, "del", 4, None, "-- y"), (1, 1, 3, "add", None, 4, "++ z"),
        (2, 1, 1, "add", None, 1, "p\r@@ -1 +1 @@"), (2, 1, 2, "add", None, 2, "q"),
    ]
    assert D.diff_files(diffs, most_files=2).count() == 2


SYMBOLS = [("a.c", 1, 9, "N::C::run", "run"), ("a.c", 11, 12, "run", "run"), ("b.c", 1, 5, "D::run", "run"), ("b.c", 6, 8, "overrun", "overrun")]


def symbols(spark):
    return spark.createDataFrame(SYMBOLS, "path string, start int, end int, name string, short_name string")


def test_symbols(spark):
    names = spark.createDataFrame([(1, "run"), (2, " C::run "), (3, "N::C::run"), (4, "un"), (5, None)], "query_id int, name string")
    rows = lookup.symbol_lookup(symbols(spark), names, ["path", "start"], 2).select("query_id", "name", "total").collect()
    assert sorted(map(tuple, rows)) == [(1, "N::C::run", 3), (1, "run", 3), (2, "N::C::run", 1), (3, "N::C::run", 1)]


def test_windows(spark):
    files = spark.createDataFrame([("f", "\n".join(map(str, range(1, 201)))), ("e", None)], "path string, text string")
    wanted = [(1, "f", 5, 7), (2, "f", -3, 2), (3, "f", 190, 900), (4, "f", 1, 200), (5, "f", 10, None), (6, "e", 4, 9), (7, "none", 1, 2), (8, "f", 9, 3)]
    rows = lookup.code_window(files, spark.createDataFrame(wanted, "query_id int, path string, start int, end int")).collect()
    found = {r["query_id"]: (r["start"], r["end"], r["body"].split("\n")[0], len(r["body"].split("\n"))) for r in rows}
    assert found == {1: (5, 7, "5", 3), 2: (1, 2, "1", 2), 3: (190, 200, "190", 11), 4: (1, 80, "1", 80), 5: (10, 50, "10", 41), 6: (4, 1, "", 1), 8: (9, 3, "", 1)}


def test_neighbours(spark):
    edges = [("a", "x", "calls", "exact", "name"), ("b", "x", "uses", "ambiguous", "reference_index"), ("c", "x", "co_changes", "exact", "git"), ("x", "d", "calls", "exact", "name"), ("x", "x", "calls", "exact", "name")]
    edges = spark.createDataFrame(edges, "src string, dst string, kind string, resolution string, method string")
    nodes = spark.createDataFrame([(1, "x"), (1, "x")], "query_id int, node string")
    ask = lambda direction, most: sorted((r["other"], r["total"], r["outside"]) for r in lookup.neighbours(edges, nodes, direction, ["other"], most).collect())
    assert ask("callers", 9) == [("a", 3, 1), ("b", 3, 1), ("x", 3, 1)] and ask("callers", 1) == [("a", 3, 1)] and ask("callees", 9) == [("d", 2, 0), ("x", 2, 0)]


def test_signals(spark):
    signals = spark.createDataFrame([("a.c", 3, "isr"), ("a.c", 10, "timing"), ("lib/b.c", 2, "bus_io")], "path string, start int, kind string")
    targets = spark.createDataFrame([(1, "run"), (2, "a.c"), (3, "b.c"), (4, "overrun"), (5, "lib/b.c")], "query_id int, name string")
    rows = lookup.signals_for(signals, symbols(spark), targets, ["path", "start"]).select("query_id", "kind").collect()
    assert sorted(map(tuple, rows)) == [(1, "isr"), (2, "isr"), (2, "timing"), (3, "bus_io"), (5, "bus_io")]
