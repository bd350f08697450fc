"""Joins, intervals, sets, sessions and graphs over the star schema and the events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import graph, intervals, ranking
from lodestone.plans.common import table

_RANGE_SQL = "l_quantity::BIGINT AS lo, l_quantity::BIGINT + 5 * l_linenumber AS hi"


def _ranges(spark, sf_dir):
    """Symbol ranges inside an order: from the quantity, five longer per line number."""
    lo = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", lo.alias("lo"), (lo + 5 * F.col("l_linenumber")).alias("hi"))


def _points(spark, sf_dir):
    at = F.pmod(F.col("o_custkey"), F.lit(60)).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", at.alias("at"), at.alias("at_end"))


def innermost_interval(spark, sf_dir):
    """For each order's point the narrowest range that holds it."""
    joined = intervals.overlap_join(_points(spark, sf_dir), _ranges(spark, sf_dir), "o_orderkey", ("at", "at_end"), ("lo", "hi"))
    inner = intervals.innermost(joined.select("p.o_orderkey", "p.at", "r.lo", "r.hi", "r.l_linenumber", "r.l_partkey"), ["o_orderkey"], F.col("hi") - F.col("lo"), [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("lo")])
    return inner.select("o_orderkey", "at", "l_linenumber", "l_partkey", "lo", "hi")


_PR = f'''WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, {_RANGE_SQL} FROM lineitem), p AS (SELECT o_orderkey, o_custkey % 60 AS "at" FROM orders)'''
INNERMOST = f"""{_PR} SELECT o_orderkey, "at", l_linenumber, l_partkey, lo, hi FROM p JOIN r ON l_orderkey = o_orderkey AND "at" BETWEEN lo AND hi
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY hi - lo, l_linenumber, l_partkey, lo) = 1"""


def loose_signals_anti(spark, sf_dir):
    """Orders whose point is in no range."""
    points = _points(spark, sf_dir)
    return intervals.overlap_join(points, _ranges(spark, sf_dir), "o_orderkey", ("at", "at_end"), ("lo", "hi"), "left_anti").select("o_orderkey", "at")


LOOSE = f'''{_PR} SELECT o_orderkey, "at" FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE l_orderkey = o_orderkey AND "at" BETWEEN lo AND hi)'''


def interval_overlap_sum(spark, sf_dir):
    """Per order and part the length of the ranges within 10 to 40."""
    length = intervals.overlap_length((F.col("lo"), F.col("hi")), (F.lit(10), F.lit(40)))
    return _ranges(spark, sf_dir).groupBy("o_orderkey", "l_partkey").agg(F.sum(length).alias("overlap"))


OVERLAP = f"SELECT l_orderkey AS o_orderkey, l_partkey, sum(greatest(least(hi, 40) - greatest(lo, 10) + 1, 0))::BIGINT AS overlap FROM (SELECT l_orderkey, l_partkey, {_RANGE_SQL} FROM lineitem) GROUP BY 1, 2"


def asof_blame_lookup(spark, sf_dir):
    """For each error the user's last view at or before it."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    errors, views = events.where("event_type = 'error'"), events.where("event_type = 'view'")
    found = intervals.as_of(errors.withColumn("seen", F.lit(None).cast("long")), views.withColumn("seen", F.col("event_id")), "user_id", "ts", ["seen"], "event_id")
    return found.where("matched_seen IS NOT NULL").select("event_id", F.col("matched_seen").alias("view_id"))


ASOF = """SELECT e.event_id, v.event_id AS view_id FROM events e JOIN events v ON v.user_id = e.user_id AND v.ts <= e.ts
WHERE e.event_type = 'error' AND v.event_type = 'view' QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY v.ts DESC, v.event_id DESC) = 1"""


def gap_sessions(spark, sf_dir):
    """Sessions of each user with gaps of at most 30 minutes."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    numbered = ranking.sessions(table(spark, sf_dir, "events").withColumn("us", ts), ["user_id"], [F.asc("us"), F.asc("event_id")], F.col("us"), F.col("us"), 30 * 60 * 1_000_000)
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.sum("value").alias("value")).withColumn("value", F.round("value", 4))


SESSIONS = """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 1800000000 THEN 0 ELSE 1 END AS o FROM events),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g)
SELECT user_id, session, count(*) AS n, min(event_id) AS first_event, round(sum(value), 4) AS value FROM s GROUP BY 1, 2"""


def first_per_key(spark, sf_dir):
    """The first event of each user and type."""
    return ranking.top_per_key(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.asc("ts"), F.asc("event_id")], 1).select("user_id", "event_type", "event_id")


FIRST = "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1"


def semi_join_touching(spark, sf_dir):
    """Orders that touch a part of size 1."""
    touched = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").where("p_size = 1"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return table(spark, sf_dir, "orders").join(touched, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_custkey")


SEMI = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 1)"


def anti_join_missing(spark, sf_dir):
    """Customers without orders."""
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


ANTI = "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"


def left_lookup_default(spark, sf_dir):
    """The quality of each document, -1 where unknown."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


LOOKUP = "SELECT d.doc_id, coalesce(quality, -1) AS quality FROM documents d LEFT JOIN labels USING (doc_id)"


def longest_prefix_owner(spark, sf_dir):
    """Each part type's longest other type that it starts with, by equality of its prefixes' lengths."""
    types = table(spark, sf_dir, "part").select("p_type").distinct()
    stems = types.select(F.substring_index("p_type", " ", 2).alias("stem")).union(types.select(F.substring_index("p_type", " ", 1))).distinct()
    words = F.split("p_type", " ")
    prefixes = types.withColumn("stem", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))))
    return prefixes.join(stems, "stem").groupBy("p_type").agg(F.max_by("stem", F.length("stem")).alias("owner"))


OWNER = """WITH t AS (SELECT DISTINCT p_type FROM part), s AS (SELECT DISTINCT array_to_string(string_split(p_type, ' ')[1:k], ' ') AS stem FROM t, (VALUES (1), (2)) v(k))
SELECT p_type, arg_max(stem, length(stem)) AS owner FROM t JOIN s ON p_type = stem OR starts_with(p_type, stem || ' ') GROUP BY 1"""


def set_ops(spark, sf_dir):
    """Nations of suppliers and customers: both, either alone."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    parts = (("both", a.intersect(b)), ("suppliers_only", a.subtract(b)), ("all", a.union(b).distinct()))
    return parts[0][1].withColumn("part", F.lit(parts[0][0])).unionByName(parts[1][1].withColumn("part", F.lit(parts[1][0]))).unionByName(parts[2][1].withColumn("part", F.lit(parts[2][0])))


SETS = """SELECT k, 'both' AS part FROM (SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer)
UNION ALL SELECT k, 'suppliers_only' FROM (SELECT s_nationkey AS k FROM supplier EXCEPT SELECT c_nationkey FROM customer)
UNION ALL SELECT k, 'all' FROM (SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer)"""


def orphan_refcount(spark, sf_dir):
    """Parts that stay without a line once urgent orders are deleted."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    left = lines.join(orders.where("o_orderpriority <> '1-URGENT'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return lines.select("l_partkey").distinct().join(left, "l_partkey", "left_anti")


ORPHANS = """SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority <> '1-URGENT')"""


def insert_if_absent(spark, sf_dir):
    """Orders after inserting copies of all under keys shifted by 10, where the key is free."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    new = orders.select((F.col("o_orderkey") + 10).alias("o_orderkey"), "o_custkey").join(orders, "o_orderkey", "left_anti")
    return orders.unionByName(new)


INSERT = "SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey + 10, o_custkey FROM orders WHERE o_orderkey + 10 NOT IN (SELECT o_orderkey FROM orders)"


def component_dep_weights(spark, sf_dir):
    """Weights between brands and supplier nations."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    # Lines are summed up by part and supplier first, which is all that the joins need.
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    return lines.join(part, "l_partkey").join(supplier, "l_suppkey").groupBy("brand", "nation").agg(F.sum("n").alias("weight"))


DEPS = "SELECT p_brand AS brand, s_nationkey AS nation, count(*) AS weight FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2"


def weighted_degree(spark, sf_dir):
    """Weight of each node of the supplier-part graph."""
    lines = table(spark, sf_dir, "lineitem")
    ends = F.explode(F.array(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))))
    return lines.select(ends.alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


DEGREE = "SELECT node, count(*) AS degree FROM (SELECT unnest(['s' || l_suppkey, 'p' || l_partkey]) AS node FROM lineitem) GROUP BY 1"


def cascade_resolution(spark, sf_dir):
    """For each part the other parts of its brand and type, else of its type, else any: tier, count, first.

    Candidates are counted by tier, with the two least of them, so a part meets
    three rows whatever the number of its candidates.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.lit(0).alias("all"))
    tiers = (["p_brand", "p_type"], ["p_type"], ["all"])
    found = parts
    for k, keys in enumerate(tiers):
        first = F.min("p_partkey").alias("first")
        index = parts.groupBy(*keys).agg(F.count("*").alias("n"), first)
        second = parts.join(index.select(*keys, "first"), keys).where("p_partkey <> first").groupBy(*keys).agg(F.min("p_partkey").alias("second"))
        both = index.join(second, keys, "left").select(*keys, F.struct("n", "first", "second").alias(f"t{k}"))
        found = found.join(F.broadcast(both) if keys == ["all"] else both, keys)  # one row for all
    tier = F.when(F.col("t0.n") > 1, 1).when(F.col("t1.n") > 1, 2).when(F.col("t2.n") > 1, 3).otherwise(9)
    best = F.when(tier == 1, F.col("t0")).when(tier == 2, F.col("t1")).otherwise(F.col("t2"))
    target = F.when(best["first"] == F.col("p_partkey"), best["second"]).otherwise(best["first"])
    return found.select(F.col("p_partkey").alias("call"), tier.alias("tier"), (best["n"] - 1).alias("candidates"), target.alias("first_target"))


CASCADE = """WITH b AS (SELECT p_brand, p_type, count(*) AS n, min(p_partkey) AS f, list_sort(list(p_partkey))[2] AS s FROM part GROUP BY 1, 2), t AS (SELECT p_type, count(*) AS n, min(p_partkey) AS f, list_sort(list(p_partkey))[2] AS s FROM part GROUP BY 1),
a AS (SELECT count(*) AS n, min(p_partkey) AS f, list_sort(list(p_partkey))[2] AS s FROM part)
SELECT p_partkey AS call, CASE WHEN b.n > 1 THEN 1 WHEN t.n > 1 THEN 2 WHEN a.n > 1 THEN 3 ELSE 9 END AS tier, CASE WHEN b.n > 1 THEN b.n WHEN t.n > 1 THEN t.n ELSE a.n END - 1 AS candidates,
CASE WHEN b.n > 1 THEN CASE WHEN b.f = p_partkey THEN b.s ELSE b.f END WHEN t.n > 1 THEN CASE WHEN t.f = p_partkey THEN t.s ELSE t.f END ELSE CASE WHEN a.f = p_partkey THEN a.s ELSE a.f END END AS first_target
FROM part p JOIN b ON p.p_brand = b.p_brand AND p.p_type = b.p_type JOIN t ON p.p_type = t.p_type, a"""


def _dependency_edges(spark, sf_dir):
    """(src depends on dst): nation -> region, supplier and customer -> nation, order -> customer."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    pairs = (("nation", "n", "n_nationkey", "r", "n_regionkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("orders", "o", "o_orderkey", "c", "o_custkey"))
    out = None
    for t, p, a, q, b in pairs:
        edges = table(spark, sf_dir, t).select(name(p, a).alias("src"), name(q, b).alias("dst"))
        out = edges if out is None else out.unionByName(edges)
    return out


_EDGES_SQL = """e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders)"""


def reach_by_depth(spark, sf_dir):
    """How many nodes depend on region 0, by the number of steps."""
    start = spark.createDataFrame([("r0",)], "node string")
    return graph.reach(_dependency_edges(spark, sf_dir), start).groupBy("depth").agg(F.count("*").alias("nodes"))


REACH = f"""WITH RECURSIVE {_EDGES_SQL}, r(node, depth) AS (SELECT 'r0', 0 UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node)
SELECT depth, count(*) AS nodes FROM (SELECT node, min(depth) AS depth FROM r GROUP BY 1) GROUP BY 1"""


def reach_share_band(spark, sf_dir):
    """The share of all nodes that depend on each nation, and its name."""
    edges = _dependency_edges(spark, sf_dir)
    starts = edges.where(F.startswith("dst", F.lit("n"))).select(F.col("dst").alias("start"), F.col("dst").alias("node")).distinct()
    below = graph.reach(edges, starts).where("depth > 0").groupBy(F.col("start").alias("node")).agg(F.count("*").alias("n"))
    total = edges.agg(F.count_distinct("src").alias("total"))
    return below.join(F.broadcast(total)).select("node", F.round(F.col("n") / F.col("total"), 9).alias("share")).withColumn("band", graph.band(F.col("share")))  # one row


BAND = f"""WITH RECURSIVE {_EDGES_SQL}, r(start, node) AS (SELECT DISTINCT dst, dst FROM e WHERE dst LIKE 'n%' UNION SELECT r.start, e.src FROM r JOIN e ON e.dst = r.node),
s AS (SELECT start AS node, round((count(*) - 1) / (SELECT count(DISTINCT src) FROM e)::DOUBLE, 9) AS share FROM r GROUP BY 1)
SELECT node, share, CASE WHEN share >= 0.3 THEN 'System-wide' WHEN share >= 0.1 THEN 'Wide' ELSE 'Contained' END AS band FROM s"""


def graph_rollup_levels(spark, sf_dir):
    """Edges between part brands by parts on one order's consecutive lines: weight and best resolution."""
    following = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), following.alias("dst"), F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("resolution")).where("dst IS NOT NULL")
    edges = lines.groupBy("src", "dst").agg(F.count("*").alias("weight"), F.min("resolution").alias("resolution"))
    groups = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("group"))
    return graph.roll_up(edges, groups)


ROLL_UP = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem)
SELECT x.p_brand AS src_group, y.p_brand AS dst_group, count(*) AS weight, min(CASE a.l_returnflag WHEN 'N' THEN 0 ELSE 1 END) AS resolution
FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.k = a.k + 1 JOIN part x ON x.p_partkey = a.l_partkey JOIN part y ON y.p_partkey = b.l_partkey WHERE x.p_brand <> y.p_brand GROUP BY 1, 2"""

CATALOGUE = {
    "innermost_interval": (innermost_interval, INNERMOST),
    "loose_signals_anti": (loose_signals_anti, LOOSE),
    "interval_overlap_sum": (interval_overlap_sum, OVERLAP),
    "asof_blame_lookup": (asof_blame_lookup, ASOF),
    "gap_sessions": (gap_sessions, SESSIONS),
    "first_per_key": (first_per_key, FIRST),
    "semi_join_touching": (semi_join_touching, SEMI),
    "anti_join_missing": (anti_join_missing, ANTI),
    "left_lookup_default": (left_lookup_default, LOOKUP),
    "longest_prefix_owner": (longest_prefix_owner, OWNER),
    "set_ops": (set_ops, SETS),
    "orphan_refcount": (orphan_refcount, ORPHANS),
    "insert_if_absent": (insert_if_absent, INSERT),
    "component_dep_weights": (component_dep_weights, DEPS),
    "weighted_degree": (weighted_degree, DEGREE),
    "cascade_resolution": (cascade_resolution, CASCADE),
    "reach_by_depth": (reach_by_depth, REACH),
    "reach_share_band": (reach_share_band, BAND),
    "graph_rollup_levels": (graph_rollup_levels, ROLL_UP),
}
