"""Queries of displayed changes and of look-ups in the source model, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import lookup
from lodestone.plans.common import spread, table
from lodestone.sources import display_diff


def _diffs(spark, sf_dir):
    """A diff of two files for each part, with as many added lines as its size."""
    size = F.col("p_size")
    new = F.when(size % 5 == 0, "/dev/null").otherwise(F.concat(F.lit("b/"), "p_name"))
    added = F.array_join(F.transform(F.sequence(F.lit(1), size), lambda k: F.concat(F.lit("+++ "), k.cast("string"))), "\n")
    text = F.concat(
        F.lit("diff --git a/x b/y\n--- a/"), "p_name", F.lit("\n+++ "), new, F.lit("\n@@ -"), size.cast("string"), F.lit(",3 +7 @@ f()\n one\n--- two\n"), added, F.lit("\n@@ odd\n last\n\\ No newline at end of file\n@@ -900 +950,0 @@\n-gone\n"),
        F.lit("diff --git a/old.bin b/new.bin\nBinary files a/old.bin and /dev/null differ\n"),
    )
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey").select(F.col("p_partkey").alias("id"), text.alias("text"))


def display_diff_files(spark, sf_dir):
    """Files of each part's diff with their counters; over 30 rows a file is cut."""
    return display_diff.diff_files(_diffs(spark, sf_dir), most_lines=30)


DIFF_FILES = """SELECT p_partkey AS id, 1 AS file_no, p_name AS path, CASE WHEN p_size % 5 = 0 THEN 'deleted' ELSE 'modified' END AS status, false AS binary, p_size AS additions, 2 AS deletions, p_size + 4 > 30 AS truncated FROM part
UNION ALL SELECT p_partkey, 2, 'new.bin', 'deleted', true, 0, 0, false FROM part"""


def display_diff_rows(spark, sf_dir):
    """The first 30 rows of each file of each part's diff with both line numbers."""
    return display_diff.diff_rows(_diffs(spark, sf_dir), most_lines=30)


DIFF_ROWS = """WITH r AS (SELECT p_partkey AS id, 1 AS hunk_no, 1 AS row_no, 'ctx' AS kind, p_size AS old, 7 AS new, 'one' AS text FROM part UNION ALL SELECT p_partkey, 1, 2, 'del', p_size + 1, NULL, '-- two' FROM part
UNION ALL SELECT p_partkey, 1, k + 2, 'add', NULL, 7 + k, '++ ' || k FROM (SELECT *, unnest(range(1, p_size + 1)) AS k FROM part)
UNION ALL SELECT p_partkey, 1, p_size + 3, 'ctx', p_size + 2, p_size + 8, 'last' FROM part UNION ALL SELECT p_partkey, 2, p_size + 4, 'del', 900, NULL, 'gone' FROM part)
SELECT 1 AS file_no, * FROM r WHERE row_no <= 30"""


def symbol_lookup(spark, sf_dir):
    """Parts as symbols of a type and a brand, looked up by each short name, each name of two parts and each whole name."""
    scope, short = F.concat_ws("::", "p_type", "p_brand"), F.concat(F.lit("m"), (F.col("p_partkey") % 97).cast("string"))
    symbols = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", F.concat_ws("::", scope, short).alias("name"), short.alias("short_name"), F.concat_ws("::", "p_brand", short).alias("scoped"))
    names = symbols.select(F.explode(F.array("name", "short_name", "scoped")).alias("name")).distinct().select(F.col("name").alias("query_id"), "name")
    return lookup.symbol_lookup(symbols, names, ["p_partkey"]).select("query_id", "p_partkey", "total")


SYMBOLS = """WITH s AS (SELECT p_partkey, p_type || '::' || p_brand || '::m' || p_partkey % 97 AS name, 'm' || p_partkey % 97 AS short, p_brand || '::m' || p_partkey % 97 AS scoped FROM part),
n AS (SELECT name AS n FROM s UNION SELECT short FROM s UNION SELECT scoped FROM s)
SELECT n AS query_id, p_partkey, count(*) OVER (PARTITION BY n) AS total FROM n JOIN s ON name = n OR short = n OR ends_with(name, '::' || n) QUALIFY row_number() OVER (PARTITION BY n ORDER BY p_partkey) <= 3"""


def code_window(spark, sf_dir):
    """A window of lines of every document, some without an end, before the first line or past the last one."""
    doc = F.col("doc_id")
    files = table(spark, sf_dir, "documents").select(doc.cast("string").alias("path"), "text")
    wanted = table(spark, sf_dir, "documents").select(doc.alias("query_id"), doc.cast("string").alias("path"), (doc % 9 - 1).cast("int").alias("start"), (doc % 7 * 20).cast("int").alias("end"))
    return lookup.code_window(files, wanted).select("query_id", "start", "end", "total", F.md5("body").alias("body_md5"))


WINDOW = r"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l, doc_id % 9 - 1 AS a, CASE doc_id % 7 WHEN 0 THEN doc_id % 9 + 39 ELSE doc_id % 7 * 20 END AS e FROM documents),
s AS (SELECT *, len(l) AS total, greatest(1, a) AS s FROM l), w AS (SELECT *, least(e, total, s + 79) AS t FROM s)
SELECT doc_id AS query_id, s AS start, t AS "end", total, md5(CASE WHEN t < s THEN '' ELSE array_to_string(l[s:t], chr(10)) END) AS body_md5 FROM w"""


def neighbours(spark, sf_dir):
    """The first 40 parts that call on each supplier, and how many do in all and by name alone."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.when(F.col("l_returnflag") == "N", "co_changes").otherwise("calls").alias("kind")).agg(F.min("l_linestatus").alias("resolution"))
    edges = lines.withColumn("method", F.when(F.col("resolution") == "F", "reference_index").otherwise("exact"))
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_suppkey").alias("node"))
    return lookup.neighbours(edges, nodes, "callers", ["other", "kind"]).select("query_id", "other", "kind", "method", "total", "outside")


NEIGHBOURS = """WITH e AS (SELECT l_partkey AS other, l_suppkey AS query_id, CASE min(l_linestatus) WHEN 'F' THEN 'reference_index' ELSE 'exact' END AS method FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag <> 'N' GROUP BY 1, 2)
SELECT query_id, other, 'calls' AS kind, method, count(*) OVER w AS total, count(*) FILTER (method = 'reference_index') OVER w AS outside FROM e WINDOW w AS (PARTITION BY query_id)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY other) <= 40"""


CATALOGUE = {
    "display_diff_files": (display_diff_files, DIFF_FILES),
    "display_diff_rows": (display_diff_rows, DIFF_ROWS),
    "symbol_lookup": (symbol_lookup, SYMBOLS),
    "code_window": (code_window, WINDOW),
    "neighbours": (neighbours, NEIGHBOURS),
}
