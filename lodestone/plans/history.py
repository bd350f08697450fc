"""History queries: commit = order, file = part, author = customer; F fixes, P reverts, 1-URGENT has a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import cochange, graph, ranking, review
from lodestone.plans.common import spread, table

_DAY = "yyyy-MM-dd"


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS commit", "l_partkey AS file")


def cochange_pairs(spark, sf_dir):
    """Parts that share at least three orders of 2 to 25 parts."""
    return cochange.pairs(_touched(spark, sf_dir), min_support=3, max_files=25)


_PAIRS = """
WITH t AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS f FROM lineitem),
n AS (SELECT f, count(*) AS n FROM t GROUP BY f),
ok AS (SELECT c FROM t GROUP BY c HAVING count(*) BETWEEN 2 AND 25),
u AS (SELECT t.* FROM t JOIN ok USING (c)),
p AS (SELECT a.f AS a, b.f AS b, count(*) AS support FROM u a JOIN u b ON a.c = b.c AND a.f < b.f
      GROUP BY a.f, b.f HAVING count(*) >= 3)
"""
COCHANGE = (
    _PAIRS
    + """SELECT p.a AS file_a, p.b AS file_b, p.support, p.support / least(x.n, y.n)::DOUBLE AS strength
FROM p JOIN n x ON x.f = p.a JOIN n y ON y.f = p.b"""
)


def cochange_recent_shas(spark, sf_dir):
    """The five newest common orders of each such pair."""
    when = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS commit", "o_orderdate AS at")
    return cochange.recent_commits(_touched(spark, sf_dir), when)


RECENT = (
    _PAIRS
    + """, r AS (SELECT p.a, p.b, x.c, row_number() OVER (PARTITION BY p.a, p.b ORDER BY o_orderdate DESC, x.c DESC) AS r
FROM p JOIN u x ON x.f = p.a JOIN u y ON y.f = p.b AND y.c = x.c JOIN orders ON o_orderkey = x.c)
SELECT a AS file_a, b AS file_b, string_agg(c::VARCHAR, ',' ORDER BY r) AS commits FROM r WHERE r <= 5 GROUP BY a, b"""
)


def _file_commits(spark, sf_dir):
    # Dealt out by commit first: hardly a line repeats, so a task that reads many would hold them all.
    once = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey").distinct()
    return once.join(table(spark, sf_dir, "orders").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))


def file_history_rollup(spark, sf_dir):
    """Per part: commits, fixes, reverts, reasons, authors, first and last day."""
    return (
        _file_commits(spark, sf_dir)
        .groupBy(F.col("l_partkey").alias("file"))
        .agg(
            F.count("*").alias("commits"),
            F.count_if(F.col("o_orderstatus") == "F").alias("bugfix_commits"),
            F.count_if(F.col("o_orderstatus") == "P").alias("reverts"),
            F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("rationale_commits"),
            F.count_distinct("o_custkey").alias("authors"),
            F.date_format(F.min("o_orderdate"), _DAY).alias("first_at"),
            F.date_format(F.max("o_orderdate"), _DAY).alias("last_at"),
        )
    )


_FC = "WITH fc AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), j AS (SELECT * FROM fc JOIN orders ON o_orderkey = l_orderkey)"
ROLLUP = f"""{_FC}
SELECT l_partkey AS file, count(*) AS commits, count(*) FILTER (o_orderstatus = 'F') AS bugfix_commits, count(*) FILTER (o_orderstatus = 'P') AS reverts,
count(*) FILTER (o_orderpriority = '1-URGENT') AS rationale_commits, count(DISTINCT o_custkey) AS authors,
strftime(min(o_orderdate), '%Y-%m-%d') AS first_at, strftime(max(o_orderdate), '%Y-%m-%d') AS last_at FROM j GROUP BY 1"""


def top_authors_per_file(spark, sf_dir):
    """The three customers with most orders of each part."""
    counts = _file_commits(spark, sf_dir).groupBy(F.col("l_partkey").alias("file"), F.col("o_custkey").alias("author")).agg(F.count("*").alias("commits"))
    return ranking.top_per_key(counts, ["file"], [F.desc("commits"), F.asc("author")], 3, "rank")


TOP_AUTHORS = f"""{_FC}, c AS (SELECT l_partkey AS file, o_custkey AS author, count(*) AS commits FROM j GROUP BY 1, 2)
SELECT file, author, commits, row_number() OVER (PARTITION BY file ORDER BY commits DESC, author) AS rank FROM c QUALIFY rank <= 3"""


def author_stats_latest_name(spark, sf_dir):
    """Per customer: orders, first and last day, and the status of the last one."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("author"))
        .agg(
            F.count("*").alias("commits"),
            F.date_format(F.min("o_orderdate"), _DAY).alias("first_at"),
            F.date_format(F.max("o_orderdate"), _DAY).alias("last_at"),
            F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("latest_name"),
        )
    )


AUTHOR_STATS = """SELECT o_custkey AS author, count(*) AS commits, strftime(min(o_orderdate), '%Y-%m-%d') AS first_at, strftime(max(o_orderdate), '%Y-%m-%d') AS last_at,
arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS latest_name FROM orders GROUP BY 1"""

_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_LINE_SQL = ", ".join(_LINE_ORDER)


def edge_dedup_weight(spark, sf_dir):
    """One edge per supplier and part: its weight and the first row's columns."""
    return graph.dedup_edges(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey"], F.struct(*_LINE_ORDER), ["l_orderkey", "l_linenumber"])


EDGE_DEDUP = f"""SELECT l_suppkey, l_partkey, count(*) AS weight, arg_min(l_orderkey, ({_LINE_SQL})) AS first_l_orderkey,
arg_min(l_linenumber, ({_LINE_SQL})) AS first_l_linenumber FROM lineitem GROUP BY 1, 2"""


def fan_in_points(spark, sf_dir):
    """Points of a part by its returned and its other lines."""
    hit = F.col("l_returnflag") == "N"
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("file")).agg(F.count_if(hit).alias("resolved"), F.count_if(~hit).alias("ambiguous"))
    return counts.withColumn("points", graph.fan_in_points(F.col("resolved"), F.col("ambiguous")))


FAN_IN = """SELECT *, round(log2(1 + resolved + ambiguous / 2) * 10) / 10 AS points FROM (SELECT l_partkey AS file,
count(*) FILTER (l_returnflag = 'N') AS resolved, count(*) FILTER (l_returnflag <> 'N') AS ambiguous FROM lineitem GROUP BY 1)"""


def criticality_capped_sum(spark, sf_dir):
    """Per order and flag the first three lines count; their sum, to one decimal."""
    first = ranking.top_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_returnflag"], [F.asc(c) for c in _LINE_ORDER[1:]], 3)
    return first.groupBy("l_orderkey", "l_returnflag").agg(F.round(F.sum("l_quantity"), 1).alias("points"))


CAPPED = f"""SELECT l_orderkey, l_returnflag, round(sum(l_quantity), 1) AS points FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag
ORDER BY {_LINE_SQL}) AS r FROM lineitem) WHERE r <= 3 GROUP BY 1, 2"""


def _levels(spark, sf_dir, name, key, score, high, medium):
    return ranking.levels(table(spark, sf_dir, name).select(F.col(key).alias("id"), F.col(score).alias("score")), "score", "id", high, medium)


def criticality_levels(spark, sf_dir):
    """Customers by balance: high, medium or low."""
    return _levels(spark, sf_dir, "customer", "c_custkey", "c_acctbal", 0.1, 0.35)


def levels_20_50(spark, sf_dir):
    """Suppliers by balance, with other cut-offs."""
    return _levels(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal", 0.2, 0.5)


def _levels_sql(name, key, score, high, medium):
    return f"""WITH p AS (SELECT {key} AS id, {score} AS score, row_number() OVER (ORDER BY {score} DESC, {key}) - 1 AS i, count(*) OVER () AS n FROM {name} WHERE {score} > 0)
SELECT id, score, CASE WHEN i < ceil(n * {high}::DOUBLE) THEN 'high' WHEN i < ceil(n * {medium}::DOUBLE) THEN 'medium' ELSE 'low' END AS level FROM p
UNION ALL SELECT {key}, {score}, 'low' FROM {name} WHERE NOT coalesce({score} > 0, false)"""


def component_max_rollup(spark, sf_dir):
    """The largest balance of each nation."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("component"))
    return table(spark, sf_dir, "customer").join(nation, "c_nationkey").groupBy("component").agg(F.max("c_acctbal").alias("criticality"), F.count("*").alias("files"))


COMPONENT_MAX = "SELECT n_name AS component, max(c_acctbal) AS criticality, count(*) AS files FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1"


def quota_top_n(spark, sf_dir):
    """The 20 dearest lines, at most three of a supplier."""
    order = [F.desc("l_extendedprice"), *(F.asc(c) for c in _LINE_ORDER)]
    return ranking.quota_top(table(spark, sf_dir, "lineitem"), "l_suppkey", order, 3, 20).select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


QUOTA = f"""SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, {_LINE_SQL}) AS r
FROM lineitem) WHERE r <= 3 ORDER BY l_extendedprice DESC, {_LINE_SQL} LIMIT 20"""


def unique_suffix(spark, sf_dir):
    """Part types made unique by ``~2`` and so on."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return ranking.unique_suffix(parts, "p_type", [F.asc("p_partkey")], "unique_name")


UNIQUE = """SELECT p_partkey, p_type, CASE WHEN r = 1 THEN p_type ELSE p_type || '~' || r END AS unique_name
FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part)"""


def critical_register(spark, sf_dir):
    """The 15 customers with the largest positive balance."""
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").orderBy(F.desc("c_acctbal"), "c_custkey").limit(15).select("c_custkey", "c_name", "c_acctbal")


REGISTER = "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 15"


def latest_per_group_with_others(spark, sf_dir):
    """The last order of each customer and how many others there are."""
    return ranking.latest_with_others(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "others")


LATEST = """SELECT o_custkey, o_orderkey, n - 1 AS others FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"""


def rank_map_order(spark, sf_dir):
    """All findings by severity: the priority's rank, then the order."""
    ranks = {p: i for i, p in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))}
    return review.severity_order(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ranks, "o_orderpriority", ["o_orderkey"])


RANK_MAP = """SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3
WHEN '5-LOW' THEN 4 ELSE 9 END AS severity FROM orders ORDER BY severity, o_orderkey"""

# The verdict lattice.
VERDICTS = ("SAFE", "RISKY", "DANGEROUS", "STOP")


def rule_floor(spark, sf_dir):
    """Verdict of each order: the worst of its rules, with the names of those that hold."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count("*").alias("n"))
    facts = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    rules = F.filter(
        F.array(
            F.when(F.col("o_orderstatus") == "P", F.struct(F.lit(3).alias("rank"), F.lit("reverted_before").alias("rule"))),
            F.when(F.col("o_orderstatus") == "F", F.struct(F.lit(2).alias("rank"), F.lit("bugfix_history").alias("rule"))),
            F.when(F.col("returned") >= 2, F.struct(F.lit(2).alias("rank"), F.lit("contract_signal").alias("rule"))),
            F.when(F.col("n") < 3, F.struct(F.lit(1).alias("rank"), F.lit("no_related_tests").alias("rule"))),
        ),
        lambda r: r.isNotNull(),
    )
    held = facts.select("o_orderkey", rules.alias("rules"))
    floor = F.coalesce(F.array_max(F.transform("rules", lambda r: r["rank"])), F.lit(0))
    return held.select("o_orderkey", F.get(F.array(*map(F.lit, VERDICTS)), floor).alias("floor"), F.array_join(F.transform("rules", lambda r: r["rule"]), ",").alias("reasons"))


RULE_FLOOR = """WITH l AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) AS n FROM lineitem GROUP BY 1),
f AS (SELECT * FROM orders JOIN l ON o_orderkey = l_orderkey),
r AS (SELECT o_orderkey, 1 AS k, 3 AS rank, 'reverted_before' AS rule FROM f WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 2, 2, 'bugfix_history' FROM f WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, 3, 2, 'contract_signal' FROM f WHERE returned >= 2 UNION ALL SELECT o_orderkey, 4, 1, 'no_related_tests' FROM f WHERE n < 3)
SELECT f.o_orderkey, ['SAFE', 'RISKY', 'DANGEROUS', 'STOP'][1 + coalesce(max(rank), 0)] AS floor, coalesce(string_agg(rule, ',' ORDER BY k), '') AS reasons
FROM f LEFT JOIN r USING (o_orderkey) GROUP BY 1"""


def key_commit(spark, sf_dir):
    """The strongest order of each part, the oldest first among equals: revert 3, fix 2, reason 1."""
    strength = F.when(F.col("o_orderstatus") == "P", 3).when(F.col("o_orderstatus") == "F", 2).when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)
    strong = _file_commits(spark, sf_dir).withColumn("strength", strength).where("strength > 0")
    return ranking.top_per_key(strong, ["l_partkey"], [F.desc("strength"), F.asc("o_orderdate"), F.asc("o_orderkey")], 1).select(F.col("l_partkey").alias("file"), F.col("o_orderkey").alias("commit"), "strength")


KEY_COMMIT = f"""{_FC}, s AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 3 WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS strength FROM j)
SELECT l_partkey AS file, o_orderkey AS commit, strength FROM s WHERE strength > 0
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY strength DESC, o_orderdate, o_orderkey) = 1"""


def module_links(spark, sf_dir):
    """Per supplier: parts, lines and its first three parts."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("module"), F.col("l_partkey").alias("file"))
        .agg(F.count("*").alias("n"))
        .withColumn("r", F.expr("row_number() OVER (PARTITION BY module ORDER BY file)"))
        .groupBy("module")
        .agg(
            F.count("*").alias("files"),
            F.sum("n").alias("references"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.col("file")))), lambda x: x.cast("string")), ",").alias("first_files"),
        )
    )


MODULE_LINKS = """WITH g AS (SELECT l_suppkey AS module, l_partkey AS file, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS r FROM lineitem GROUP BY 1, 2)
SELECT module, count(*) AS files, sum(n)::BIGINT AS "references", string_agg(CASE WHEN r <= 3 THEN file::VARCHAR END, ',' ORDER BY file) AS first_files FROM g GROUP BY 1"""


def hub_header_top1(spark, sf_dir):
    """The part with most lines."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("file")).agg(F.count("*").alias("included_by")).orderBy(F.desc("included_by"), "file").limit(1)


HUB = "SELECT l_partkey AS file, count(*) AS included_by FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"


def interface_usage(spark, sf_dir):
    """Per part: suppliers, whether any line was kept, and the first order that shows it."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("target"))
        .agg(F.count_distinct("l_suppkey").alias("files"), F.bool_or(F.col("l_returnflag") == "N").alias("resolved"), F.min("l_orderkey").alias("first_evidence"))
    )


INTERFACE = "SELECT l_partkey AS target, count(DISTINCT l_suppkey) AS files, bool_or(l_returnflag = 'N') AS resolved, min(l_orderkey) AS first_evidence FROM lineitem GROUP BY 1"


def completeness(spark, sf_dir):
    """Per customer the worst completeness of the orders: O is partial, P insufficient."""
    rank = F.when(F.col("o_orderstatus") == "P", 2).when(F.col("o_orderstatus") == "O", 1).otherwise(0)
    worst = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(rank).alias("r"))
    return worst.select("o_custkey", F.get(F.array(F.lit("complete"), F.lit("partial"), F.lit("insufficient")), F.col("r")).alias("completeness"))


COMPLETENESS = """SELECT o_custkey, ['complete', 'partial', 'insufficient'][1 + max(CASE o_orderstatus WHEN 'P' THEN 2 WHEN 'O' THEN 1 ELSE 0 END)] AS completeness FROM orders GROUP BY 1"""

CATALOGUE = {
    "cochange_pairs": (cochange_pairs, COCHANGE),
    "cochange_recent_shas": (cochange_recent_shas, RECENT),
    "file_history_rollup": (file_history_rollup, ROLLUP),
    "top_authors_per_file": (top_authors_per_file, TOP_AUTHORS),
    "author_stats_latest_name": (author_stats_latest_name, AUTHOR_STATS),
    "edge_dedup_weight": (edge_dedup_weight, EDGE_DEDUP),
    "fan_in_points": (fan_in_points, FAN_IN),
    "criticality_capped_sum": (criticality_capped_sum, CAPPED),
    "criticality_levels": (criticality_levels, _levels_sql("customer", "c_custkey", "c_acctbal", 0.1, 0.35)),
    "levels_20_50": (levels_20_50, _levels_sql("supplier", "s_suppkey", "s_acctbal", 0.2, 0.5)),
    "component_max_rollup": (component_max_rollup, COMPONENT_MAX),
    "quota_top_n": (quota_top_n, QUOTA),
    "unique_suffix": (unique_suffix, UNIQUE),
    "critical_register": (critical_register, REGISTER),
    "latest_per_group_with_others": (latest_per_group_with_others, LATEST),
    "rank_map_order": (rank_map_order, RANK_MAP),
    "rule_floor": (rule_floor, RULE_FLOOR),
    "key_commit": (key_commit, KEY_COMMIT),
    "module_links": (module_links, MODULE_LINKS),
    "hub_header_top1": (hub_header_top1, HUB),
    "interface_usage": (interface_usage, INTERFACE),
    "completeness": (completeness, COMPLETENESS),
}
