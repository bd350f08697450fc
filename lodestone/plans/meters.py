"""Queries of the reach of changes, of walks with a budget and of the graph by levels, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph_view, meters
from lodestone.plans.common import spread, table



def _key():
    return F.col("p_partkey")


def _path():
    return F.concat("p_brand", F.lit("/"), (F.col("p_size") % 5).cast("string"))


def _edges(spark, sf_dir):
    """Each part depends on the parts of half and of a third of its number."""
    part = table(spark, sf_dir, "part")
    how = [(F.col("p_size") % 3).alias("resolution"), F.when(F.col("p_size") % 7 == 0, "reference_index").otherwise("exact").alias("method")]
    halves = part.select(_key().alias("src"), F.floor(_key() / 2).alias("dst"), F.lit("calls").alias("kind"), *how, (_key() * 2).alias("ord"))
    thirds = part.select(_key().alias("src"), F.floor(_key() / 3).alias("dst"), F.when(_key() % 5 == 0, "co_changes").otherwise("includes").alias("kind"), *how, (_key() * 2 + 1).alias("ord"))
    return halves.unionByName(thirds)


def _model(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    nodes = part.select(_key().alias("node"), _path().alias("path"), (F.col("p_size") % 2 == 0).alias("symbol"))
    files = part.where("p_brand NOT LIKE '%5'").select(_path().alias("path")).distinct()
    return nodes, files, files.select(F.concat(F.lit("c"), F.right("path", F.lit(1))).alias("component"), "path")


def _starts(spark, sf_dir):
    small = table(spark, sf_dir, "part").where("p_size = 1")
    return small.select(_key().alias("start"), F.explode(F.array(_key(), _key() + 1)).alias("node")).withColumn("nth", F.col("node") - F.col("start"))


_MODEL = """p AS (SELECT p_partkey AS n, p_size AS z, p_brand || '/' || p_size % 5 AS path, p_brand NOT LIKE '%5' AS inside FROM part),
e AS (SELECT n AS src, n // 2 AS dst, 'calls' AS kind, z % 3 AS res, z % 7 = 0 AS idx, n * 2 AS ord, inside FROM p UNION ALL SELECT n, n // 3, CASE WHEN n % 5 = 0 THEN 'co_changes' ELSE 'includes' END, z % 3, z % 7 = 0, n * 2 + 1, inside FROM p),
d AS (SELECT * FROM e WHERE kind <> 'co_changes'), st AS (SELECT n AS start, unnest([n, n + 1]) AS node FROM p WHERE z = 1)"""


def reach_meters(spark, sf_dir):
    """The reach of the smallest parts, each with the next one: what depends on them, and how sure that is."""
    edges = _edges(spark, sf_dir).withColumn("resolution", F.get(F.array(F.lit("resolved"), F.lit("ambiguous"), F.lit("unresolved")), F.col("resolution")))
    nodes, files, components = _model(spark, sf_dir)
    found = meters.reach_meter(edges, _starts(spark, sf_dir), nodes, files, components)
    return found.withColumn("by_depth", F.array_join(F.transform("by_depth", lambda x: x.cast("string")), ","))


def _reach_step(k: int) -> str:
    seen = " UNION ALL ".join(f"SELECT start, node FROM n{i}" for i in range(k))
    return f"""n{k} AS MATERIALIZED (SELECT a.start, l.src AS node, {k} AS depth, bool_or(l.outer_) AS outer_ FROM n{k - 1} a JOIN l ON l.dst = a.node
  WHERE NOT a.outer_ AND NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.start = a.start AND s.node = l.src) GROUP BY 1, 2)"""


_DEEPEST = 18  # the numbers of parts halve at least
METERS = f"""WITH {_MODEL}, l AS (SELECT src, dst, bool_or(idx OR NOT inside) AS outer_ FROM d GROUP BY 1, 2),
n0 AS (SELECT DISTINCT start, node, 0 AS depth, false AS outer_ FROM st), {", ".join(map(_reach_step, range(1, _DEEPEST)))},
w AS ({" UNION ALL ".join(f"FROM n{k}" for k in range(_DEEPEST))}),
k AS (SELECT w.*, p.path, z % 2 = 0 AS symbol FROM w LEFT JOIN p ON p.n = w.node), f AS (SELECT DISTINCT path FROM p WHERE inside),
own AS (SELECT DISTINCT start, path FROM k WHERE depth = 0 AND path IS NOT NULL), ownc AS (SELECT DISTINCT start, right(path, 1) AS c FROM own JOIN f USING (path)),
m AS (SELECT * FROM k WHERE depth > 0 AND NOT outer_), af AS (SELECT DISTINCT start, path FROM m WHERE path IS NOT NULL AND (start, path) NOT IN (FROM own)),
ac AS (SELECT DISTINCT start, right(path, 1) AS c FROM af JOIN f USING (path) WHERE (start, right(path, 1)) NOT IN (FROM ownc)),
bd AS (SELECT start, string_agg(n, ',' ORDER BY depth) AS by_depth, max(depth) AS deepest FROM (SELECT start, depth, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1),
q AS (SELECT w.start, d.res FROM w JOIN d ON d.dst = w.node WHERE NOT outer_ UNION ALL SELECT w.start, d.res FROM w JOIN d ON d.src = w.node WHERE depth = 0 AND d.res = 2),
c AS (SELECT start, count(*) FILTER (res = 1) AS ambiguous, count(*) FILTER (res = 2) AS unresolved FROM q GROUP BY 1),
o AS (SELECT start, count(DISTINCT coalesce(path, node::VARCHAR)) AS outside FROM k WHERE depth > 0 AND outer_ GROUP BY 1),
nf AS (SELECT start, count(*) AS files FROM af GROUP BY 1), ns AS (SELECT start, count(*) AS symbols FROM m WHERE symbol GROUP BY 1), nc AS (SELECT start, count(*) AS components FROM ac GROUP BY 1),
no AS (SELECT start, count(*) AS o FROM own GROUP BY 1), noc AS (SELECT start, count(*) AS oc FROM ownc GROUP BY 1),
t AS (SELECT (SELECT count(*) FROM f) AS ft, (SELECT count(DISTINCT right(path, 1)) FROM f) AS ct, (SELECT count(*) FROM p WHERE z % 2 = 0) AS stt)
SELECT s.start, coalesce(files, 0) AS files, greatest(ft - coalesce(o, 0), 0) AS files_total, coalesce(symbols, 0) AS symbols, stt AS symbols_total, coalesce(components, 0) AS components, greatest(ct - coalesce(oc, 0), 0) AS components_total,
CASE WHEN ft > coalesce(o, 0) THEN coalesce(files, 0) / (ft - coalesce(o, 0)) ELSE 0.0::DOUBLE END AS share, coalesce(deepest, 0) AS max_depth, coalesce(by_depth, '') AS by_depth, coalesce(outside, 0) AS outside, coalesce(ambiguous, 0) AS ambiguous,
coalesce(unresolved, 0) AS unresolved, coalesce(unresolved, 0) > 0 OR coalesce(outside, 0) > 0 AS lower_bound
FROM (SELECT DISTINCT start FROM st) s CROSS JOIN t LEFT JOIN nf USING (start) LEFT JOIN ns USING (start) LEFT JOIN nc USING (start) LEFT JOIN no USING (start) LEFT JOIN noc USING (start) LEFT JOIN bd USING (start) LEFT JOIN o USING (start) LEFT JOIN c USING (start)"""


def budget_impact(spark, sf_dir):
    """Walks from the smallest parts, each with the next one, that end at eight nodes: the nodes in their order."""
    nodes, files, _ = _model(spark, sf_dir)
    met, _edges_met = meters.impact_within(_edges(spark, sf_dir), _starts(spark, sf_dir), nodes, files, 3, 8)
    return met


def budget_counts(spark, sf_dir):
    """What the walks of ``budget_impact`` met, in numbers."""
    nodes, files, _ = _model(spark, sf_dir)
    edges, starts = _edges(spark, sf_dir), _starts(spark, sf_dir)
    return meters.impact_counts(edges, starts, *meters.impact_within(edges, starts, nodes, files, 3, 8))


def _budget_step(k: int) -> str:
    seen = " UNION ALL ".join(f"SELECT start, node FROM b{i}" for i in range(k))
    return f"""m{k} AS MATERIALIZED (SELECT b.start, b.place AS pp, b.before, d.src, d.dst, d.res, greatest(d.res, b.weakest) AS weakest, d.ord, d.idx OR NOT d.inside AS boundary FROM b{k - 1} b JOIN d ON d.dst = b.node WHERE b.before < 8),
v{k} AS MATERIALIZED (SELECT * FROM m{k} WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.start = m{k}.start AND s.node = m{k}.src) QUALIFY row_number() OVER (PARTITION BY start, src ORDER BY pp, ord) = 1),
r{k} AS MATERIALIZED (SELECT b.start, b.place AS pp, coalesce(g.n, 0) AS gain, b.before + coalesce(sum(g.n) OVER (PARTITION BY b.start ORDER BY b.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
  FROM b{k - 1} b LEFT JOIN (SELECT start, pp, count(*) AS n FROM v{k} GROUP BY 1, 2) g ON g.start = b.start AND g.pp = b.place WHERE b.before < 8),
t{k} AS MATERIALIZED (SELECT *, max(so_far + gain) OVER (PARTITION BY start) AS total FROM r{k} WHERE so_far < 8),
b{k} AS MATERIALIZED (SELECT v.start, v.src AS node, row_number() OVER (PARTITION BY v.start ORDER BY v.pp, v.ord) AS place, v.weakest, t.total AS before, v.boundary FROM v{k} v JOIN t{k} t ON t.start = v.start AND t.pp = v.pp)"""


_WALK = f"WITH {_MODEL}, b0 AS (SELECT start, node, row_number() OVER (PARTITION BY start ORDER BY node) AS place, 0 AS weakest, 0 AS before FROM st), " + ", ".join(map(_budget_step, (1, 2, 3)))
BUDGET = _WALK + " " + " UNION ALL ".join(f"SELECT start, node, {k} AS depth, place, weakest AS resolution, boundary FROM b{k}" for k in (1, 2, 3))
BUDGET_COUNTS = (
    _WALK
    + ", x AS ("
    + " UNION ALL ".join(f"SELECT m.start, m.res FROM m{k} m JOIN t{k} t ON t.start = m.start AND t.pp = m.pp" for k in (1, 2, 3))
    + " UNION ALL SELECT start, res FROM st JOIN e ON e.src = st.node WHERE res = 2), c AS (SELECT start, count(*) FILTER (res = 0) AS resolved, count(*) FILTER (res = 1) AS ambiguous, count(*) FILTER (res = 2) AS unresolved FROM x GROUP BY 1), n AS ("
    + "SELECT start, count(*) AS nodes, count(*) FILTER (boundary) AS boundary FROM ("
    + " UNION ALL ".join(f"SELECT start, boundary FROM b{k}" for k in (1, 2, 3))
    + ") GROUP BY 1) SELECT s.start, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("nodes", "boundary", "resolved", "ambiguous", "unresolved"))
    + " FROM (SELECT DISTINCT start FROM st) s LEFT JOIN n USING (start) LEFT JOIN c USING (start)"
)


def _view(spark, sf_dir):
    """Parts as symbols in files of directories by size; those of every fourth directory lie outside."""
    part, lines = spread(table(spark, sf_dir, "part"), "p_partkey"), table(spark, sf_dir, "lineitem")
    path = F.concat(F.lit("d"), F.col("p_size").cast("string"), F.lit("/f"), (_key() % 9).cast("string"))
    key = F.concat(F.lit("s"), _key().cast("string"))
    places = part.select(key.alias("node"), path.alias("path"))
    files = part.where("p_size % 4 > 0").select(path.alias("path")).distinct()
    components = files.select(F.concat(F.lit("c"), F.right("path", F.lit(1))).alias("component"), "path")
    symbols = part.where("p_size % 4 > 0").select(key.alias("id"), F.when(_key() % 3 == 0, "macro").otherwise("function").alias("kind"), path.alias("path"), F.when(F.col("p_size") > 20, F.floor("p_retailprice")).otherwise(0).alias("criticality"))
    node = lambda c: F.concat(F.lit("s"), c.cast("string"))
    kind = F.when(F.col("l_returnflag") == "N", "calls").when(F.col("l_returnflag") == "A", "includes").otherwise("co_changes")
    edges = lines.select(node(F.col("l_partkey")).alias("src"), node(F.col("l_suppkey") * 3).alias("dst"), kind.alias("kind"), (F.col("l_linenumber") % 3).alias("resolution"), F.col("l_linenumber").alias("weight"), (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return graph_view.graph_view(edges, places, files, components, graph_view.wanted_symbols(symbols, 600))


def graph_view_nodes(spark, sf_dir):
    """What the edges of the graph touch, at all levels."""
    return _view(spark, sf_dir)[0]


def graph_view_edges(spark, sf_dir):
    """The edges of the graph at all levels."""
    return _view(spark, sf_dir)[1]


_VIEW = """WITH p AS (SELECT 's' || p_partkey AS id, 'd' || p_size || '/f' || p_partkey % 9 AS path, 'd' || p_size AS dir, p_size % 4 > 0 AS inside, p_partkey % 3 = 0 AS macro, CASE WHEN p_size > 20 THEN floor(p_retailprice) ELSE 0 END AS crit FROM part),
w AS (SELECT id FROM p WHERE inside AND (NOT macro OR crit > 0) ORDER BY crit DESC, id LIMIT 600),
x AS (SELECT id, 'component' AS level, CASE WHEN inside THEN 'c' || right(path, 1) ELSE 'dir:' || dir END AS g, NOT inside AS b FROM p
UNION ALL SELECT id, 'file', CASE WHEN inside THEN 'file:' || path ELSE 'dir:' || dir END, NOT inside FROM p
UNION ALL SELECT p.id, 'symbol', CASE WHEN w.id IS NOT NULL THEN p.id WHEN NOT inside THEN 'dir:' || dir END, NOT inside FROM p LEFT JOIN w ON w.id = p.id),
e AS (SELECT 's' || l_partkey AS src, 's' || l_suppkey * 3 AS dst, CASE l_returnflag WHEN 'N' THEN 'calls' ELSE 'includes' END AS kind, l_linenumber % 3 AS res, l_linenumber AS weight, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS ord FROM lineitem WHERE l_returnflag <> 'R'),
m AS (SELECT a.level, a.g AS a, b.g AS b, a.b AS ab, b.b AS bb, kind, res, weight, ord FROM e JOIN x a ON a.id = src JOIN x b ON b.id = dst AND b.level = a.level),
s AS (SELECT level, a AS g, ord, 0 AS side FROM m WHERE ab UNION ALL SELECT level, b, ord, 1 FROM m WHERE bb),
g AS (SELECT level, a AS src, b AS dst, kind, min(res) AS resolution, sum(weight)::BIGINT AS weight FROM m WHERE a <> b GROUP BY 1, 2, 3, 4),
i AS (SELECT level, dst AS id, count(*) AS n FROM g WHERE level = 'symbol' GROUP BY 1, 2),
z AS (SELECT s.level, s.g AS id, count(*) + coalesce(max(i.n), 0) AS size, min((ord, side)) AS first FROM s LEFT JOIN i ON i.level = s.level AND i.id = s.g GROUP BY 1, 2),
k AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY level ORDER BY size DESC, first) <= CASE level WHEN 'component' THEN 12 WHEN 'file' THEN 25 ELSE 30 END),
v AS (SELECT * FROM g WHERE (NOT starts_with(src, 'dir:') OR (level, src) IN (SELECT level, id FROM k)) AND (NOT starts_with(dst, 'dir:') OR (level, dst) IN (SELECT level, id FROM k)))"""
VIEW_EDGES = _VIEW + " SELECT level, src, dst, kind, resolution, weight FROM v"
VIEW_NODES = (
    _VIEW
    + """, t AS (SELECT DISTINCT level, unnest([src, dst]) AS id FROM v)
SELECT t.level, t.id, CASE WHEN starts_with(t.id, 'file:') THEN 'file' ELSE t.level END AS kind, false AS boundary, 1 + coalesce(i.n, 0) AS size FROM t LEFT JOIN i ON i.level = t.level AND i.id = t.id WHERE NOT starts_with(t.id, 'dir:')
UNION ALL SELECT level, id, 'boundary', true, size FROM k"""
)


CATALOGUE = {
    "reach_meters": (reach_meters, METERS),
    "budget_impact": (budget_impact, BUDGET),
    "budget_counts": (budget_counts, BUDGET_COUNTS),
    "graph_view_nodes": (graph_view_nodes, VIEW_NODES),
    "graph_view_edges": (graph_view_edges, VIEW_EDGES),
}
