"""Queries of findings, of the risk of a change and of what newcomers are told, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import fences, findings, node_details, onboarding
from lodestone.plans.common import table


def review_findings(spark, sf_dir):
    """Orders as reviews: lines with a history, comments, contract signals, a class of change, gaps and missing tests."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("review_id"), F.col("l_partkey").cast("string").alias("path"), F.col("l_linenumber").alias("line"), "l_returnflag", "l_linestatus", F.concat("l_returnflag", F.col("l_suppkey").cast("string")).alias("subject"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"), "o_orderstatus", "o_orderpriority")
    hunks = lines.withColumn("strong", (F.col("l_returnflag") == "R").cast("int")).withColumn("weak", (F.col("l_returnflag") == "A").cast("int"))
    comments = lines.where("line = 3").withColumn("comment", F.col("subject"))
    contracts = lines.where("l_linestatus = 'O'").withColumn("kind", F.when(F.col("line") % 3 == 0, "isr").when(F.col("line") % 3 == 1, "hw_register").otherwise("timing")).withColumn("snippet", F.col("subject"))
    k = F.col("review_id")
    changes = orders.select("review_id", F.lit("a").alias("path"), F.when(k % 3 == 0, "docs").otherwise("log_string").alias("class")).unionByName(orders.select("review_id", F.lit("b").alias("path"), F.when(k % 5 == 0, "comments").otherwise("code").alias("class")))
    gaps = orders.where("o_orderstatus <> 'F'").select("review_id", F.when(F.col("o_orderstatus") == "P", "insufficient").otherwise("partial").alias("level"), F.col("o_orderpriority").alias("text"))
    missing = orders.where(k % 4 == 0).select("review_id", F.col("o_orderpriority").alias("name"))
    return findings.findings(findings.finding_claims(hunks, comments, contracts, changes, gaps, missing))


FINDINGS = """WITH l AS (SELECT l_orderkey AS review_id, CAST(l_partkey AS VARCHAR) AS path, l_linenumber AS line, l_returnflag AS f, l_linestatus AS s, l_returnflag || l_suppkey AS subject,
  CASE l_linenumber % 3 WHEN 0 THEN 'isr' WHEN 1 THEN 'hw_register' ELSE 'timing' END AS kind FROM lineitem),
kinds AS (SELECT review_id, kind, min((path, line)) AS first FROM l WHERE s = 'O' GROUP BY 1, 2),
titles AS (SELECT review_id, 'Touches ' || string_agg(replace(kind, '_', ' '), ', ' ORDER BY first, kind) || ' code' AS title FROM kinds GROUP BY 1),
c AS (SELECT review_id, 1 AS part, CASE f WHEN 'R' THEN 4 ELSE 3 END AS sev, CASE f WHEN 'R' THEN 'Alters code with an explicit workaround history (' ELSE 'Alters code with bug-fix history (' END || subject || ')' AS title, path, line FROM l WHERE f IN ('R', 'A')
UNION ALL SELECT review_id, 2, 4, 'Changes code under a workaround comment', path, line FROM l WHERE line = 3
UNION ALL SELECT review_id, 3, 3, title, NULL, NULL FROM (SELECT * FROM l WHERE s = 'O' QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY path, line) <= 6) JOIN titles USING (review_id)
UNION ALL SELECT o_orderkey, 4, 1, 'Behaviour-free change', NULL, NULL FROM orders, range(2) WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, 5, 2, 'Analysis is ' || CASE o_orderstatus WHEN 'P' THEN 'insufficient' ELSE 'partial' END, NULL, NULL FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 6, 2, 'No related test found', NULL, NULL FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 5 <> 0),
g AS (SELECT review_id, part, sev, title, path, line, count(*) AS claims FROM c GROUP BY ALL)
SELECT review_id, row_number() OVER (PARTITION BY review_id ORDER BY sev DESC, part, path NULLS FIRST, line NULLS FIRST, title) AS place, ['INFO', 'RISKY', 'DANGEROUS', 'STOP'][sev] AS severity, title, path, line, claims FROM g"""


def change_risk(spark, sf_dir):
    """Parts as functions of a brand that call the part of half their number; a line near the start of each is changed."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("path"), F.col("p_partkey").alias("start"), "p_size", "p_type")
    lines = part.select(F.col("p_partkey").alias("query_id"), "path", (F.col("start") + 5).alias("line"))
    functions = part.select(F.col("p_partkey").alias("id"), "path", "start", (F.col("start") + F.col("p_size")).alias("end"), F.when(F.col("p_size") > 40, "high").otherwise("low").alias("level"))
    signals = part.select("path", "start", (F.col("start") + 9).alias("end"), F.col("p_type").alias("kind"), F.when(F.col("p_partkey") % 4 == 0, "git").otherwise("static").alias("source"))
    edges = part.select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 2).alias("dst"), F.lit("calls").alias("kind"), (F.col("p_size") % 3).alias("resolution"), F.when(F.col("p_size") % 7 == 0, "reference_index").otherwise("exact").alias("method"))
    found = findings.change_risk(lines, functions, signals, edges.where("src <> dst"))
    return found.withColumn("kinds", F.array_join("kinds", ","))


RISK = """WITH e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst, p_size % 3 AS r, p_size % 7 = 0 AS o FROM part WHERE p_partkey <> p_partkey // 2),
i1 AS (SELECT dst AS start, src AS node, r, o FROM e), i2 AS (SELECT start, src AS node, e.r, e.o FROM i1 JOIN e ON e.dst = node), i3 AS (SELECT start, src AS node, e.r, e.o FROM i2 JOIN e ON e.dst = node),
n AS (SELECT start, count(node) AS dependents, count(*) FILTER (r = 1) AS ambiguous, count(*) FILTER (r = 2) AS unresolved, count(*) FILTER (o) AS outside FROM (FROM i1 UNION ALL FROM i2 UNION ALL FROM i3 UNION ALL SELECT src, NULL, r, NULL FROM e WHERE r = 2) GROUP BY 1),
f AS (SELECT q.p_partkey AS query_id, p.p_partkey AS function_id, CASE WHEN p.p_size > 40 THEN 'high' ELSE 'low' END AS level FROM part q JOIN part p ON p.p_brand = q.p_brand AND q.p_partkey + 5 BETWEEN p.p_partkey AND p.p_partkey + p.p_size
  QUALIFY row_number() OVER (PARTITION BY q.p_partkey ORDER BY p.p_size, p.p_partkey DESC) = 1),
k AS (SELECT q.p_partkey AS query_id, string_agg(DISTINCT p.p_type, ',' ORDER BY p.p_type) AS kinds FROM part q JOIN part p ON p.p_brand = q.p_brand AND q.p_partkey + 5 BETWEEN p.p_partkey AND p.p_partkey + 9 AND p.p_partkey % 4 <> 0 GROUP BY 1)
SELECT p_partkey AS query_id, coalesce(kinds, '') AS kinds, function_id, level, coalesce(dependents, 0) AS dependents, coalesce(ambiguous, 0) AS ambiguous, coalesce(unresolved, 0) AS unresolved, coalesce(outside, 0) AS outside
FROM part LEFT JOIN k ON k.query_id = p_partkey LEFT JOIN f ON f.query_id = p_partkey LEFT JOIN n ON n.start = function_id"""


def assumption_list(spark, sf_dir):
    """Order lines as signals of a part: the first 40 assumptions, each snippet of a part once."""
    kinds = F.array(*map(F.lit, ("hw_access", "isr", "guard", "timing", "watchdog", "hw_register", "timing_constant")))
    lines = table(spark, sf_dir, "lineitem")
    signals = lines.select(F.element_at(kinds, F.col("l_linenumber").cast("int")).alias("kind"), F.col("l_partkey").cast("string").alias("path"), F.col("l_orderkey").alias("start"), F.col("l_returnflag").alias("snippet"), F.when(F.col("l_linestatus") == "F", "static").otherwise("git").alias("source"))
    return onboarding.assumptions(signals)


ASSUMPTIONS = """WITH s AS (SELECT ['hw_access', 'isr', 'guard', 'timing', 'watchdog', 'hw_register', 'timing_constant'][l_linenumber] AS kind, CAST(l_partkey AS VARCHAR) AS path, l_orderkey AS start, l_returnflag AS snippet FROM lineitem WHERE l_linestatus = 'F'),
n AS (SELECT *, list_position(['isr', 'timing', 'timing_constant', 'watchdog', 'hw_register', 'hw_access'], kind) AS nth FROM s WHERE kind <> 'guard')
SELECT kind, path, start, snippet FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY path, snippet ORDER BY nth, start) = 1) ORDER BY nth, path, start, snippet LIMIT 40"""


def interface_list(spark, sf_dir):
    """Parts that suppliers name from outside, all of them."""
    lines = table(spark, sf_dir, "lineitem")
    edges = lines.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.when(F.col("l_returnflag") == "N", "reference_index").otherwise("exact").alias("method"), (F.col("l_linenumber") % 4).alias("resolution"))
    return onboarding.interfaces(edges, None)


INTERFACES = "SELECT l_partkey AS node, count(DISTINCT l_suppkey) AS files, min(l_linenumber % 4) = 0 AS resolved FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1"


def hidden_couplings(spark, sf_dir):
    """Suppliers include the headers of parts, whose sources bear whole names or parts of them."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), "p_size")
    whole, inner = part.where("p_size % 2 = 0").select(F.concat(F.lit("src/m"), "k", F.lit(".cpp")).alias("path")), part.where("p_size % 3 = 0").select(F.concat(F.lit("src/m"), "k", F.lit("_regs.c")).alias("path"))
    end = F.when(F.col("l_linenumber") % 3 == 0, ".h").when(F.col("l_linenumber") % 3 == 1, "_regs.h").otherwise("_regs_x.h")
    includes = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("line"), F.concat(F.lit("inc/m"), F.col("l_partkey").cast("string"), end).alias("header"))
    return onboarding.hidden_couplings(whole.unionByName(inner), includes)


COUPLINGS = """WITH u AS (SELECT 'm' || l_partkey || CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '_regs' ELSE '_regs_x' END AS stem, count(*) AS includers FROM lineitem GROUP BY 1),
s AS (SELECT 'm' || p_partkey AS own, '.cpp' AS ext FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'm' || p_partkey || '_regs', '.c' FROM part WHERE p_size % 3 = 0),
p AS (SELECT stem AS public FROM u ORDER BY includers DESC, 'inc/' || stem || '.h' LIMIT 1),
c AS (SELECT u.*, split_part(stem, '_', 1) AS one, split_part(stem, '_', 1) || '_' || split_part(stem, '_', 2) AS two FROM u),
o AS (SELECT stem, includers, own, ext FROM c JOIN s ON own = one UNION SELECT stem, includers, own, ext FROM c JOIN s ON own = two),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY stem ORDER BY length(own) DESC) = 1)
SELECT 'inc/' || stem || '.h' AS header, 'src/' || own || ext AS owner, includers FROM b, p WHERE stem <> public AND own <> public"""


def fence_candidates(spark, sf_dir):
    """Parts as functions, nested in part; orders as evidence near the line of their customer, whose segment is the commit's subject."""
    orders, at = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    start = F.col("o_custkey") + at % 40
    kind = F.when(at % 4 == 0, "git_revert").when(at % 4 == 1, "git_workaround").when(at % 4 == 2, "workaround_comment").otherwise("isr")
    signals = orders.select(at.alias("id"), (F.col("o_custkey") % 50).alias("path"), start.alias("start"), (start + at % 3).alias("end"), kind.alias("kind"), F.when(at % 8 == 2, "a quirk of chips").otherwise("hack").alias("snippet"), F.col("o_custkey").alias("detail"))
    key = F.col("p_partkey")
    functions = table(spark, sf_dir, "part").select(key.alias("id"), (key % 50).alias("path"), (key - 20).alias("start"), (key + F.col("p_size")).alias("end"), F.when(F.col("p_size") > 40, "high").when(F.col("p_size") > 20, "medium").otherwise("low").alias("level"))
    commits = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sha"), F.when(F.col("c_custkey") % 3 == 0, "A Work-around").otherwise(F.col("c_mktsegment")).alias("subject"))
    return fences.fence_candidates(signals, functions, commits)


FENCES = """WITH s AS (SELECT o_orderkey AS id, o_custkey % 50 AS path, o_custkey + o_orderkey % 40 AS start, o_custkey + o_orderkey % 40 + o_orderkey % 3 AS "end",
  CASE o_orderkey % 8 WHEN 0 THEN 5 WHEN 4 THEN 5 WHEN 2 THEN 3 WHEN 6 THEN 1 WHEN 1 THEN 3 * (o_custkey % 3 = 0)::INT WHEN 5 THEN 3 * (o_custkey % 3 = 0)::INT ELSE 0 END AS weight FROM orders),
i AS (SELECT s.*, p_partkey AS function_id, CASE WHEN p_size > 40 THEN 2 WHEN p_size > 20 THEN 1 ELSE 0 END AS bonus FROM s JOIN part ON p_partkey % 50 = path AND start BETWEEN p_partkey - 20 AND p_partkey + p_size WHERE weight > 0
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY p_size, p_partkey DESC) = 1),
l AS (SELECT *, CASE WHEN start - lag("end") OVER w <= 8 THEN 0 ELSE 1 END AS opens FROM i WINDOW w AS (PARTITION BY function_id ORDER BY start, id)),
g AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY function_id ORDER BY start, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM l)
SELECT function_id, group_no, id AS signal_id, start, "end", weight, count(*) OVER (PARTITION BY function_id, group_no) AS near, weight + least(count(*) OVER (PARTITION BY function_id, group_no) - 1, 4) * 0.5::DOUBLE + bonus AS score
FROM g QUALIFY row_number() OVER (PARTITION BY function_id, group_no ORDER BY weight DESC, start, id) = 1"""


def _nations(spark, sf_dir):
    """Nations as components of customers, every tenth customer a symbol of some lines besides."""
    customers = table(spark, sf_dir, "customer")
    whole = customers.select(F.col("c_nationkey").alias("node_id"), F.col("c_custkey").alias("path"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    return whole.unionByName(customers.where("c_custkey % 10 = 0").select((F.col("c_custkey") + 1000).alias("node_id"), F.col("c_custkey").alias("path"), F.lit(100).alias("start"), F.lit(5000).alias("end")))


NATIONS = "n AS (SELECT c_nationkey AS node_id, c_custkey AS path, NULL AS first, NULL AS last FROM customer UNION ALL SELECT c_custkey + 1000, c_custkey, 100, 5000 FROM customer WHERE c_custkey % 10 = 0)"


def node_signals(spark, sf_dir):
    """The 30 weightiest orders of each node."""
    signals = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("start"), F.col("o_orderpriority").alias("kind"), (F.col("o_orderkey") % 4).alias("weight"))
    return node_details.node_signals(_nations(spark, sf_dir), signals)


NODE_SIGNALS = f"""WITH {NATIONS} SELECT node_id, path, o_orderkey AS start, o_orderpriority AS kind, o_orderkey % 4 AS weight FROM n JOIN orders ON o_custkey = path AND (first IS NULL OR o_orderkey BETWEEN first AND last)
QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY o_orderkey % 4 DESC, path, o_orderkey) <= 30"""


def node_authors(spark, sf_dir):
    """Clerks by the priority of their orders: the five that wrote most of each node."""
    authors = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("path"), (F.col("o_orderkey") % 97).alias("email")).agg(F.count("*").alias("commits")).withColumn("name", F.concat(F.lit("N"), F.col("path").cast("string")))
    return node_details.node_authors(_nations(spark, sf_dir), authors)


NODE_AUTHORS = f"""WITH {NATIONS}, a AS (SELECT node_id, o_orderkey % 97 AS email, count(*) AS commits, 'N' || min(path) AS name FROM n JOIN orders ON o_custkey = path GROUP BY 1, 2)
SELECT node_id, row_number() OVER (PARTITION BY node_id ORDER BY commits DESC, email) AS nth, email, name, commits FROM a QUALIFY nth <= 5"""


CATALOGUE = {
    "review_findings": (review_findings, FINDINGS),
    "change_risk": (change_risk, RISK),
    "assumption_list": (assumption_list, ASSUMPTIONS),
    "interface_list": (interface_list, INTERFACES),
    "hidden_couplings": (hidden_couplings, COUPLINGS),
    "fence_candidates": (fence_candidates, FENCES),
    "node_signals": (node_signals, NODE_SIGNALS),
    "node_authors": (node_authors, NODE_AUTHORS),
}
