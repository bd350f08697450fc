"""Queries of the source model: files made of parts, of four kinds, scanned, resolved, matched and scored, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph, signals, structure
from lodestone.operators.lineage import cut
from lodestone.plans.common import spread, table
from lodestone.sources import c_structure, changes

_WANTED = ("path", "text", "code", "symbols", "calls", "indirect_calls", "names_in_functions", "names", "includes", "comments", "directives")
_LINKED = ("path", "symbols", "calls", "indirect_calls", "names_in_functions", "names", "includes")  # what edges are made of


def _files(spark, sf_dir):
    """(path, text): steps, shared functions and methods inside ``lib``, and programs outside in ``app``."""
    k = F.col("p_partkey")
    word = lambda c: c.cast("string")
    step = F.concat(
        F.lit('#include "m'), word(k + 4), F.lit('.h"\n#define LIMIT_'), word(k), F.lit(" 5\nvoid step_"), word(k), F.lit("() {\n  step_"), word(F.floor(k / 2)), F.lit("(); shared_"), word((k + 1) % 10),
        F.lit("();\n  (*cb)(1); P0::go(); use(LIMIT_"), word(k), F.lit(");\n}\n"),
    )
    errata = F.when(k % 8 == 1, "// éerrata of the chip, ").otherwise("// see errata of the chip, ")
    shared = F.concat(errata, word(k), F.lit("\nint shared_"), word(k % 10), F.lit("(int n) {\n  delay(3);\n  return step_"), word(k + 3), F.lit("(n);\n}\n"))
    name = F.concat(F.lit("P"), word(k % 3))
    method = F.concat(F.lit("class "), name, F.lit(" {\npublic:\n  void run();\n};\nvoid "), name, F.lit("::run() { go(); o->go(); register_read(1); }\nvoid "), name, F.lit("::go() { volatile int x = 1; }\n"))
    program = F.concat(F.lit('#include "lib/m'), word(k + 2), F.lit('.cpp"\nint main_'), word(k), F.lit("() { return shared_"), word(k % 10), F.lit("(1) + LIMIT_"), word(k - 3), F.lit("; }\n"))
    text = F.when(k % 4 == 0, step).when(k % 4 == 1, shared).when(k % 4 == 2, method).otherwise(program)
    path = F.concat(F.when(k % 4 == 3, "app/m").otherwise("lib/m"), word(k), F.lit(".cpp"))
    return spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(path.alias("path"), text.alias("text"))


def _parsed(spark, sf_dir, wanted=_WANTED):
    """The structures of the files inside and outside, scanned once: the graph reads them a dozen times."""
    parsed = cut(c_structure.structure(_files(spark, sf_dir), wanted))
    return parsed.where("path LIKE 'lib/%'"), parsed.where("path LIKE 'app/%'")


def _edges(spark, sf_dir, inside=None, outside=None):
    if inside is None:
        inside, outside = _parsed(spark, sf_dir, _LINKED)
    headers = table(spark, sf_dir, "part").where("p_partkey % 8 = 0").select(F.concat(F.lit("lib/m"), F.col("p_partkey").cast("string"), F.lit(".h")).alias("path"))
    paths = _files(spark, sf_dir).select("path").unionByName(headers)
    return structure.edges(inside, structure.symbols(inside), paths, outside)


_MODEL = """WITH p AS (SELECT p_partkey AS k, 'lib/m' || p_partkey || '.cpp' AS path FROM part),
sh AS (SELECT k % 10 AS c, 'sym:' || max(path) || '#shared_' || k % 10 AS id FROM p WHERE k % 4 = 1 GROUP BY 1, k % 10),
gl AS (SELECT k % 3 AS c, 'sym:' || max(path) || '#P' || k % 3 || '::go' AS id, min(path) AS first, count(*) OVER () AS n FROM p WHERE k % 4 = 2 GROUP BY 1, k % 3), g1 AS (SELECT * FROM gl ORDER BY first LIMIT 1),
st AS (SELECT k, path, 'sym:' || path || '#step_' || k AS id FROM p WHERE k % 4 = 0),
x AS (SELECT s.id AS src, t.id AS dst, 'calls' AS kind, 'name_match' AS method, 'resolved' AS resolution, 1 AS candidates, s.path, 3 AS line FROM st s JOIN st t ON t.k = s.k // 2
UNION ALL SELECT s.id, sh.id, 'calls', 'name_match', 'resolved', 1, path, 4 FROM st s JOIN sh ON c = (k + 1) % 10
UNION ALL SELECT id, 'open:' || id || ':5', 'calls', 'name_match', 'unresolved', 0, path, 5 FROM st
UNION ALL SELECT s.id, gl.id, 'calls', 'name_match', 'resolved', 1, path, 5 FROM st s JOIN gl ON c = 0
UNION ALL SELECT id, 'sym:' || path || '#LIMIT_' || k, 'uses_macro', 'name_match', 'resolved', 1, path, 5 FROM st
UNION ALL SELECT 'file:' || s.path, CASE WHEN h.k IS NULL THEN 'open:include:m' || (s.k + 4) || '.h' ELSE 'file:lib/m' || (s.k + 4) || '.h' END, 'includes', 'include_path', CASE WHEN h.k IS NULL THEN 'unresolved' ELSE 'resolved' END, count(h.k), s.path, 1
  FROM st s LEFT JOIN p h ON h.k = s.k + 4 AND h.k % 8 = 0 GROUP BY s.k, s.path, h.k
UNION ALL SELECT 'sym:' || p.path || '#shared_' || p.k % 10, t.id, 'calls', 'name_match', 'resolved', 1, p.path, 4 FROM p JOIN st t ON t.k = p.k + 3 WHERE p.k % 4 = 1
UNION ALL SELECT 'sym:' || path || '#P' || k % 3 || '::run', gl.id, 'calls', 'name_match', 'resolved', 1, path, 5 FROM p JOIN gl ON c = k % 3 WHERE k % 4 = 2
UNION ALL SELECT 'sym:' || path || '#P' || k % 3 || '::run', g1.id, 'calls', 'name_match', 'ambiguous', g1.n, path, 5 FROM p, g1 WHERE k % 4 = 2
UNION ALL SELECT 'file:app/m' || a.k || '.cpp', 'file:' || b.path, 'includes', 'reference_index', 'resolved', 1, 'app/m' || a.k || '.cpp', 1 FROM p a JOIN p b ON b.k = a.k + 2 WHERE a.k % 4 = 3
UNION ALL SELECT 'file:app/m' || k || '.cpp', sh.id, 'calls', 'reference_index', 'resolved', 1, 'app/m' || k || '.cpp', 2 FROM p JOIN sh ON c = k % 10 WHERE k % 4 = 3
UNION ALL SELECT 'file:app/m' || a.k || '.cpp', 'sym:' || b.path || '#LIMIT_' || b.k, 'uses_macro', 'reference_index', 'resolved', 1, 'app/m' || a.k || '.cpp', 2 FROM p a JOIN p b ON b.k = a.k - 3 WHERE a.k % 4 = 3),
e AS (SELECT src, dst, kind, first(method ORDER BY resolution DESC) AS method, max(resolution) AS resolution, first(candidates ORDER BY resolution DESC)::BIGINT AS candidates, first(path) AS path, min(line) AS line, count(*) AS weight FROM x GROUP BY 1, 2, 3)"""


def source_edges(spark, sf_dir):
    """The graph of the files: calls by every way of writing them, includes, macros, open ends and uses from outside."""
    return _edges(spark, sf_dir)


EDGES = _MODEL + " SELECT * FROM e"


def source_external_calls(spark, sf_dir):
    """How many calls of each function leave the files."""
    inside, _ = _parsed(spark, sf_dir, ("path", "symbols", "calls"))
    return structure.external_calls(structure.resolve_calls(inside, structure.symbols(inside)))


EXTERNAL = """WITH p AS (SELECT p_partkey AS k, 'sym:lib/m' || p_partkey || '.cpp#' AS f FROM part), n AS (SELECT max(k) AS top FROM p),
c AS (SELECT f || 'step_' || k AS caller, 1 + CASE WHEN k // 2 % 4 = 0 THEN 0 ELSE 1 END + CASE WHEN (k + 1) % 10 IN (SELECT k % 10 FROM p WHERE k % 4 = 1) THEN 0 ELSE 1 END AS n FROM p WHERE k % 4 = 0
UNION ALL SELECT f || 'shared_' || k % 10, 1 + CASE WHEN k + 3 <= top THEN 0 ELSE 1 END FROM p, n WHERE k % 4 = 1 UNION ALL SELECT f || 'P' || k % 3 || '::run', 1 FROM p WHERE k % 4 = 2) SELECT caller, n::BIGINT AS external_calls FROM c"""


def source_edge_counts(spark, sf_dir):
    """Incoming and outgoing edges of each node, by how sure they are."""
    return graph.edge_counts(_edges(spark, sf_dir))


EDGE_COUNTS = (
    _MODEL
    + ", d AS (SELECT src AS node, 'out' AS side, method, resolution FROM e UNION ALL SELECT dst, 'in', method, resolution FROM e) SELECT node, "
    + ", ".join(f"count(*) FILTER (method <> 'reference_index' AND side = '{d}' AND resolution = '{r}') AS {d}_{r}" for d in ("in", "out") for r in ("resolved", "ambiguous", "unresolved"))
    + ", count(*) FILTER (method = 'reference_index' AND side = 'in') AS outside FROM d GROUP BY 1"
)


def source_signals(spark, sf_dir):
    """Signals of the files' code and comments; an accented letter ends no word."""
    return signals.code_signals(_parsed(spark, sf_dir, ("path", "text", "code", "symbols", "comments", "directives"))[0]).drop("place")


_SIGNALS = """s AS (SELECT path, 1 AS start, 'workaround_comment' AS kind, 'comment' AS source, CASE WHEN k % 8 = 1 THEN 'éerrata of the chip, ' ELSE 'see errata of the chip, ' END || k AS snippet, 'errata' AS detail, 3 AS weight FROM p WHERE k % 4 = 1
UNION ALL SELECT path, 3, 'timing', 'static', 'delay(3);', 'delay(', 2 FROM p WHERE k % 4 = 1
UNION ALL SELECT path, 5, 'hw_register', 'static', 'void P' || k % 3 || '::run() { go(); o->go(); register_read(1); }', 'register_read(', 2 FROM p WHERE k % 4 = 2
UNION ALL SELECT path, 6, 'hw_access', 'static', 'void P' || k % 3 || '::go() { volatile int x = 1; }', 'volatile', 2 FROM p WHERE k % 4 = 2)"""
SIGNALS = "WITH p AS (SELECT p_partkey AS k, 'lib/m' || p_partkey || '.cpp' AS path FROM part), " + _SIGNALS + ' SELECT path, start, start AS "end", kind, source, snippet, detail, weight FROM s'


def _scored(spark, sf_dir):
    inside, outside = _parsed(spark, sf_dir)
    symbols, found = structure.symbols(inside), signals.code_signals(inside)
    return symbols, found, signals.score_symbols(symbols, found, _edges(spark, sf_dir, inside, outside))


def source_scores(spark, sf_dir):
    """How critical each function is, by its signals, its callers and its uses from outside, with its rank's level."""
    return _scored(spark, sf_dir)[2].select("id", "path", "name", "score", "level", F.array_join(F.transform("factors", lambda f: F.concat(f["factor"], F.lit(" "), f["detail"])), "; ").alias("factors"))


_SCORES = f"""{_MODEL}, {_SIGNALS}, f AS (SELECT path, 'step_' || k AS name, NULL AS kind, NULL AS line FROM p WHERE k % 4 = 0 UNION ALL SELECT path, 'shared_' || k % 10, 'timing', 3 FROM p WHERE k % 4 = 1
UNION ALL SELECT path, 'P' || k % 3 || '::run', 'hw_register', 5 FROM p WHERE k % 4 = 2 UNION ALL SELECT path, 'P' || k % 3 || '::go', 'hw_access', 6 FROM p WHERE k % 4 = 2),
i AS (SELECT *, 'sym:' || path || '#' || name AS id FROM f),
c AS (SELECT dst AS id, count(*) FILTER (method <> 'reference_index' AND resolution = 'resolved') AS r, count(*) FILTER (method <> 'reference_index' AND resolution = 'ambiguous') AS a, count(*) FILTER (method = 'reference_index') AS o FROM e GROUP BY 1),
q AS (SELECT id, kind AS factor, 2.0 AS points, '1× (L' || line || ')' AS detail FROM i WHERE kind IS NOT NULL
UNION ALL SELECT id, 'fan_in', round(log2(1 + r + a / 2) * 10) / 10, r || ' resolved, ' || a || ' ambiguous callers' FROM c WHERE r + a > 0
UNION ALL SELECT id, 'external_references', 2.0, 'named from ' || o || ' file(s) outside the deep scope' FROM c WHERE o > 0),
z AS (SELECT id, i.path, name, coalesce(round(sum(points), 1), 0) AS score, coalesce(string_agg(factor || ' ' || detail, '; ' ORDER BY points DESC, factor DESC), '') AS factors FROM i LEFT JOIN q USING (id) GROUP BY ALL),
v AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank, count(*) FILTER (score > 0) OVER () AS n FROM z)"""
SCORES = _SCORES + " SELECT id, path, name, score, CASE WHEN score = 0 THEN 'low' WHEN rank < ceil(n * 0.1) THEN 'high' WHEN rank < ceil(n * 0.35) THEN 'medium' ELSE 'low' END AS level, nullif(factors, '') AS factors FROM v"


def source_file_scores(spark, sf_dir):
    """How critical each file is, by its functions and by what stands outside of them."""
    symbols, found, scores = _scored(spark, sf_dir)
    return signals.score_files(_files(spark, sf_dir).where("path LIKE 'lib/%'"), scores, symbols, found)


FILE_SCORES = (
    _SCORES
    + """, y AS (SELECT path, sum(score) AS f FROM v GROUP BY 1), w AS (SELECT p.path, round(coalesce(f, 0) + CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END, 1) AS score FROM p LEFT JOIN y USING (path) WHERE k % 4 < 3),
u AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) - 1 AS rank, count(*) FILTER (score > 0) OVER () AS n FROM w)
SELECT path, score, CASE WHEN score = 0 THEN 'low' WHEN rank < ceil(n * 0.1) THEN 'high' WHEN rank < ceil(n * 0.35) THEN 'medium' ELSE 'low' END AS level FROM u"""
)


def change_classes(spark, sf_dir):
    """Changes of the parts' sources: comments, messages, code, prose and other languages."""
    k = F.col("p_partkey")
    word = k.cast("string")
    old = F.concat(F.lit("int f() { // part "), word, F.lit('\n#if A\n  printf("%d of", n); g("a");\n#endif\n}\n'))
    new = (
        F.when(k % 6 == 0, F.regexp_replace(old, "// part", "/* the part */ //"))
        .when(k % 6 == 1, F.replace(old, F.lit("%d of"), F.concat(word, F.lit(" and"))))
        .when(k % 6 == 2, F.replace(old, F.lit('"a"'), F.lit('"b"')))
        .when(k % 6 == 3, F.replace(old, F.lit("#if A"), F.lit("#if B")))
        .when(k % 6 == 4, F.replace(old, F.lit("  printf"), F.lit("\n\tprintf")))
    )
    end = F.when(k % 10 == 0, ".md").when(k % 10 == 1, ".py").otherwise(".cpp")
    rows = spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.concat(F.lit("f"), word, end).alias("path"), old.alias("old_text"), new.alias("new_text"))
    return changes.change_classes(rows).select("path", "change_class")


CHANGES = """SELECT 'f' || p_partkey || CASE p_partkey % 10 WHEN 0 THEN '.md' WHEN 1 THEN '.py' ELSE '.cpp' END AS path, CASE WHEN p_partkey % 10 = 0 THEN 'docs' WHEN p_partkey % 10 = 1 THEN 'code'
WHEN p_partkey % 6 IN (0, 4) THEN 'comment_whitespace' WHEN p_partkey % 6 = 1 THEN 'log_string' ELSE 'code' END AS change_class FROM part"""


CATALOGUE = {
    "source_edges": (source_edges, EDGES),
    "source_external_calls": (source_external_calls, EXTERNAL),
    "source_edge_counts": (source_edge_counts, EDGE_COUNTS),
    "source_signals": (source_signals, SIGNALS),
    "source_scores": (source_scores, SCORES),
    "source_file_scores": (source_file_scores, FILE_SCORES),
    "change_classes": (change_classes, CHANGES),
}
