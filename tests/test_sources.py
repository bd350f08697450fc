"""Parsers on literal inputs, and messages and levels on edge cases."""

import pytest

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import graph, ranking
from lodestone.sources import repository as R


def test_tree(spark):
    text = "\x00".join(("100644 blob aa\ta/b.c", "100755 blob bb\twith\ttab", "120000 blob cc\tlink", "160000 commit dd\tsub", ""))
    rows = R.tree_entries(spark.createDataFrame([(text,)], "text string")).collect()
    assert sorted(tuple(r) for r in rows) == [("a/b.c", "aa"), ("with\ttab", "bb")]


def test_log(spark):
    z = R.NO_OBJECT
    text = f"{R.RECORD}s1{R.FIELD}Ann{R.FIELD}a@x{R.FIELD}100{R.FIELD}Fix it\n\nbody\n{R.GROUP}\n:000000 100644 {z} b1 A\tnew.c\n:100644 100644 b2 b3 R090\told.c\tmoved.c\n{R.RECORD}s0{R.FIELD}Bo{R.FIELD}b@x{R.FIELD}50{R.FIELD}Start{R.GROUP}\n"
    log = R.log_entries(spark.createDataFrame([(text,)], "text string"))
    rows = sorted(log.collect(), key=lambda r: r["log_pos"])
    assert [r["sha"] for r in rows] == ["s1", "s0"] and rows[0]["message"] == "Fix it\n\nbody" and rows[1]["changes"] == []
    assert [tuple(c) for c in rows[0]["changes"]] == [("A", None, "b1", "new.c", None), ("R", "b2", "b3", "moved.c", "old.c")]
    assert {(r["commit"], r["file"]) for r in R.commit_files(log).collect()} == {("s1", "new.c"), ("s1", "moved.c")}


def test_diff(spark):
    text = "diff --git a/x.c b/x.c\n--- a/x.c\n+++ b/x.c\n@@ -1 +1,2 @@ f()\n-a\n+b\n+c\n@@ -9,2 +10,0 @@\n-a\n-b\ndiff --git a/n b/n\n--- /dev/null\n+++ b/n\n@@ -0,0 +1 @@\n+z\n"
    rows = R.diff_hunks(spark.createDataFrame([(1, text)], "id int, text string")).orderBy("file_no", "hunk_no").collect()
    assert [tuple(r)[2:] for r in rows] == [("x.c", "x.c", 0, 1, 1, 1, 2), ("x.c", "x.c", 1, 9, 2, 10, 0), (None, "n", 0, 0, 0, 1, 1)]


def test_messages(spark):
    df = spark.createDataFrame([(1, "Fix crash (#12, #12) #7\n\nbody\n"), (2, 'Revert "x"\n\nThis reverts commit abcdef123.'), (3, "préfix été")], "i int, m string")
    flags = T.message_flags(F.col("m"))
    rows = df.select("i", T.subject(F.col("m")).alias("s"), T.body(F.col("m")).alias("b"), *(c.alias(k) for k, c in flags.items())).orderBy("i").collect()
    assert (rows[0]["s"], rows[0]["b"], rows[0]["bugfix"], rows[0]["refs"]) == ("Fix crash (#12, #12) #7", "body", True, [12, 7])
    assert rows[1]["revert"] and rows[1]["revert_of"] == "abcdef123" and not rows[2]["revert"]


def test_paths(spark):
    df = spark.createDataFrame([("a/./b/../c.cpp",), (".gitignore",), ("x/Makefile",), ("s.S",), ("../up",)], "p string")
    rows = df.select(T.normalize_path(F.col("p")).alias("n"), T.language(F.col("p")).alias("l")).collect()
    assert [tuple(r) for r in rows] == [("a/c.cpp", "cpp"), (".gitignore", "other"), ("x/Makefile", "make"), ("s.S", "asm"), ("up", "other")]


def test_levels_with_ties(spark):
    scores = [5.0] * 7 + [3.0] * 5 + [0.0, -1.0, 9.5]
    rows = ranking.levels(spark.createDataFrame(list(enumerate(scores)), "id long, score double"), "score", "id", 0.2, 0.5).collect()
    order = sorted((i for i, s in enumerate(scores) if s > 0), key=lambda i: (-scores[i], i))
    want = {i: "high" if k < 3 else "medium" if k < 7 else "low" for k, i in enumerate(order)}
    assert {r["id"]: r["level"] for r in rows} == {i: want.get(i, "low") for i in range(len(scores))}


def test_reach_on_a_cycle(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("x", "y")], "src string, dst string")
    rows = graph.reach(edges, spark.createDataFrame([("a",)], "node string")).collect()
    assert {r["node"]: r["depth"] for r in rows} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_reach_past_its_bound(spark):
    edges = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(4)], "src string, dst string")
    start = spark.createDataFrame([("n0",)], "node string")
    assert graph.reach(edges, start, most_depth=4).count() == 5
    with pytest.raises(RuntimeError):
        graph.reach(edges, start, most_depth=3)
