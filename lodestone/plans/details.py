"""Queries of nodes' details, start sets, directories and predicates of paths and lines, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import components, graph, lookup, node_details
from lodestone.plans.common import table
from lodestone.sources import repository


def _nations(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("node_id"), F.col("c_custkey").alias("path"))


def node_commits(spark, sf_dir):
    """The last orders of each nation, as commits of its customers' files."""
    orders = table(spark, sf_dir, "orders")
    commits = orders.select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("at"))
    return node_details.node_commits(_nations(spark, sf_dir), commits, orders.select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").alias("path"))).select("node_id", "sha", "at")


NODE_COMMITS = f"""SELECT c_nationkey AS node_id, o_orderkey AS sha, o_orderdate AS "at" FROM orders JOIN customer ON c_custkey = o_custkey
QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate DESC, o_orderkey) <= {node_details.MOST_COMMITS}"""


def node_co_changes(spark, sf_dir):
    """Customers that change along with those of each nation: the next but one, and the double."""
    c = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    pair = lambda b, n: customer.select(c.alias("a"), b.alias("b"), n.alias("count"), F.lit(0.5).alias("strength"))
    pairs = pair(c + 2, c % 13 + 1).unionByName(pair(c * 2 + 1, c % 7 + 1))
    return node_details.node_co_changes(_nations(spark, sf_dir).where("path % 9 = 0"), pairs)


NODE_CO_CHANGES = f"""WITH p AS (SELECT c_custkey AS a, c_custkey + 2 AS b, c_custkey % 13 + 1 AS n FROM customer UNION ALL SELECT c_custkey, c_custkey * 2 + 1, c_custkey % 7 + 1 FROM customer),
m AS (SELECT c_nationkey AS node_id, c_custkey AS path FROM customer WHERE c_custkey % 9 = 0), f AS (SELECT node_id, a, b, b AS path, n FROM p JOIN m ON m.path = a), s AS (SELECT node_id, a, b, a AS path, n FROM p JOIN m ON m.path = b),
u AS (SELECT * FROM f UNION ALL SELECT * FROM s WHERE (node_id, a, b) NOT IN (SELECT node_id, a, b FROM f))
SELECT node_id, path, n AS "count", 0.5::DOUBLE AS strength FROM u QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY n DESC, path) <= {node_details.MOST_CO_CHANGES}"""


def target_signals(spark, sf_dir):
    """Signals of targets that name a part, as a function of its brand's file, a brand or nothing."""
    k = F.col("p_partkey")
    symbols = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("A::f"), k.cast("string")).alias("name"), F.concat(F.lit("f"), k.cast("string")).alias("short_name"), F.concat(F.lit("src/"), "p_brand").alias("path"), k.alias("start"), (k + F.col("p_size")).alias("end"))
    o = F.col("o_orderkey")
    signals = table(spark, sf_dir, "orders").select(o.alias("signal_id"), F.concat(F.lit("src/Brand#"), (o % 25 + 1).cast("string")).alias("path"), F.col("o_custkey").alias("start"))
    target = F.when(k % 2 == 0, F.concat(F.lit("f"), k.cast("string"))).otherwise(F.col("p_brand"))
    targets = table(spark, sf_dir, "part").where("p_size < 5").select(k.alias("query_id"), target.alias("name"))
    return lookup.signals_for(signals, symbols, targets, ["start", "signal_id"]).select("query_id", "signal_id")


TARGET_SIGNALS = f"""WITH s AS (SELECT o_orderkey AS id, 'Brand#' || (o_orderkey % 25 + 1) AS b, o_custkey AS start FROM orders), t AS (SELECT p_partkey AS k, p_brand AS b, p_size AS z, p_partkey % 2 = 0 AS named, p_partkey % 6 = 0 AS there FROM part WHERE p_size < 5),
m AS (SELECT k, s.id, s.start FROM t JOIN s USING (b) WHERE there AND s.start BETWEEN k AND k + z UNION ALL SELECT k, s.id, s.start FROM t JOIN s USING (b) WHERE NOT named)
SELECT k AS query_id, id AS signal_id FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY start, id) <= {lookup.MOST_SIGNALS}"""


def start_sets(spark, sf_dir):
    """What some brands, files of parts and parts stand for."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    path = F.concat("p_brand", F.lit("/f"), (F.col("p_size") % 6).cast("string"))
    symbols = part.select(F.concat(F.lit("sym:"), k.cast("string")).alias("id"), path.alias("path"))
    ids = part.where("p_size = 1").select(F.when(k % 3 == 0, F.concat(F.lit("comp:"), "p_brand")).when(k % 3 == 1, F.concat(F.lit("file:"), path)).otherwise(F.concat(F.lit("sym:"), k.cast("string"))).alias("node"))
    return graph.start_set(ids, symbols, part.select(F.concat(F.lit("comp:"), "p_brand").alias("id"), path.alias("path")).distinct())


START_SETS = """WITH p AS (SELECT p_partkey AS k, p_brand AS b, p_brand || '/f' || p_size % 6 AS path, p_size FROM part), i AS (SELECT * FROM p WHERE p_size = 1),
f AS (SELECT DISTINCT path FROM p WHERE b IN (SELECT b FROM i WHERE k % 3 = 0) UNION SELECT path FROM i WHERE k % 3 = 1)
SELECT 'file:' || path AS node FROM f UNION SELECT 'sym:' || k FROM p WHERE path IN (FROM f) UNION SELECT 'sym:' || k FROM i WHERE k % 3 = 2"""


def directories(spark, sf_dir):
    """The directory that each brand's parts share, and the largest directories of all."""
    part = table(spark, sf_dir, "part")
    path = F.concat_ws("/", F.lit("src"), F.when(F.col("p_brand").endswith("1"), F.lit("one")).otherwise(F.col("p_brand")), F.when(F.col("p_brand").endswith("2"), F.lit("deep")).otherwise((F.col("p_size") % 3).cast("string")), F.concat(F.lit("f"), F.col("p_partkey").cast("string")))
    files = part.select("p_brand", path.alias("path"))
    shared = components.common_directory(files, ["p_brand"]).select(F.col("p_brand").alias("of"), "directory", F.lit(None).cast("long").alias("files"))
    return shared.unionByName(components.largest_directories(files.select("path"), 3).select(F.lit("all").alias("of"), "directory", "files"))


DIRECTORIES = """WITH f AS (SELECT p_brand AS b, 'src/' || CASE WHEN p_brand LIKE '%1' THEN 'one' ELSE p_brand END AS two, CASE WHEN p_brand LIKE '%2' THEN 'deep' ELSE (p_size % 3)::VARCHAR END AS last FROM part),
s AS (SELECT b, any_value(two) AS two, CASE WHEN count(DISTINCT last) = 1 THEN '/' || any_value(last) ELSE '' END AS rest FROM f GROUP BY 1),
n AS (SELECT two || '/' || last AS directory, count(*) AS files FROM f GROUP BY 1 HAVING count(*) <= 500 ORDER BY 2 DESC, 1 LIMIT 3) SELECT b AS "of", two || rest AS directory, NULL::BIGINT AS files FROM s UNION ALL SELECT 'all', directory, files FROM n"""


def path_predicates(spark, sf_dir):
    """What paths made of pages say of their files, and the repositories that their addresses name."""
    k = F.col("page_id")
    pick = lambda *values: F.get(F.array(*map(F.lit, values)), (k % len(values)).cast("int"))
    path = F.concat(pick("lib/tests/", "lib/", "test_", "gtest/x/", "contest/"), F.lit("a"), pick(".c", ".S", "_test.cpp", ".py", ".hpp", "_tests.c"))
    address = F.concat(pick("https://github.com/", "git@github.com:", "", "http://other.org/"), F.lit("o.w/n-"), k.cast("string"), pick("", ".git", "/"))
    return table(spark, sf_dir, "pages").select("page_id", T.is_source(path).alias("source"), T.is_traced(path).alias("traced"), T.is_test(path).alias("test"), T.repository(address).alias("repository"))


PREDICATES = """WITH p AS (SELECT page_id AS k, ['lib/tests/', 'lib/', 'test_', 'gtest/x/', 'contest/'][page_id % 5 + 1] AS d, ['.c', '.S', '_test.cpp', '.py', '.hpp', '_tests.c'][page_id % 6 + 1] AS e FROM pages)
SELECT k AS page_id, e <> '.S' AND e <> '.py' AS source, e <> '.py' AS traced, d IN ('lib/tests/', 'test_', 'gtest/x/') OR e IN ('_test.cpp', '_tests.c') AS test, CASE WHEN k % 4 < 3 THEN 'o.w/n-' || k END AS repository FROM p"""


def line_predicates(spark, sf_dir):
    """Lines of documents that are comments or blank, some marked as comments, and the prose of each document's first three lines as one comment."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("l"))
    mark = lambda x, i: F.concat(F.when(i % 3 == 0, "  // ").when(i % 3 == 1, "* ").otherwise(""), x)
    lines = F.transform("l", mark)
    prose = F.concat(F.array_join(F.transform(F.slice("l", 1, 3), lambda x, i: F.concat(F.when(i == 0, "/* ").otherwise(" * "), F.translate(x, "*/", "  "))), "\n"), F.lit(" */"))
    return docs.select("doc_id", F.size(F.filter(lines, T.is_comment_or_blank)).alias("comments"), T.comment_prose(prose).alias("prose"))


LINE_PREDICATES = r"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
n AS (SELECT doc_id, len(list_filter(l, lambda x, i: (i - 1) % 3 < 2 OR regexp_matches(x, '^\s*($|//|/\*|\*)')))::INTEGER AS comments, trim(regexp_replace(array_to_string(l[1:3], ' '), '[*/]', ' ', 'g')) AS p FROM d),
s AS (SELECT doc_id, comments, trim(regexp_replace(p, '\s+', ' ', 'g')) AS p FROM n) SELECT doc_id, comments, CASE WHEN length(p) > 400 THEN left(p, 397) || '...' ELSE p END AS prose FROM s"""


def diff_changed_lines(spark, sf_dir):
    """Parts written as diffs of two hunks and their changed lines read back."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1 @@\n-old "), k, F.lit("\n--sign\n+new\n@@ -9 +8,0 @@ f()\n-"), "p_name", F.lit("\n\\ No newline\n"))
    return repository.diff_lines(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text")))


DIFF_LINES = """SELECT p_partkey AS id, 1 AS file_no, h AS hunk_no, p AS place, s AS side, CASE t WHEN 'old' THEN 'old ' || p_partkey WHEN 'name' THEN p_name ELSE t END AS text
FROM part, (VALUES (0, 1, 'removed', 'old'), (0, 2, 'removed', '-sign'), (0, 3, 'added', 'new'), (1, 1, 'removed', 'name')) v(h, p, s, t)"""


CATALOGUE = {
    "node_commits": (node_commits, NODE_COMMITS),
    "node_co_changes": (node_co_changes, NODE_CO_CHANGES),
    "target_signals": (target_signals, TARGET_SIGNALS),
    "start_sets": (start_sets, START_SETS),
    "directories": (directories, DIRECTORIES),
    "path_predicates": (path_predicates, PREDICATES),
    "line_predicates": (line_predicates, LINE_PREDICATES),
    "diff_changed_lines": (diff_changed_lines, DIFF_LINES),
}
