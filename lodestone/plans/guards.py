"""Queries of guarded places, histories of lines, renames and the floor of a verdict, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from lodestone.operators import guards, history_rules, renames
from lodestone.plans.common import table
from lodestone.sources import line_history


def guarded_ranges(spark, sf_dir):
    """Documents as sources whose lines with a comma are code: functions of eleven lines, some lines as evidence."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    code = F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.when(x.contains(","), x).otherwise("")), "\n")
    lines = guards.line_classes(docs.withColumn("code", code))
    own = lines.select("path", "line", F.length("text").alias("n"), F.floor((F.col("line") - 1) / 12).alias("j")).where("line % 12 > 0")
    functions = own.groupBy("path", "j").agg(F.min("line").alias("fn_start"), F.max("line").alias("fn_end"))
    guard_id = (F.col("path") * 100_000 + F.col("j")).alias("guard_id")
    evidence = own.where("n % 4 = 0").select(guard_id, F.col("line").alias("nth"), F.col("line").alias("start"), (F.col("line") + F.col("n") % 3).cast("int").alias("end"), F.when(F.col("n") % 3 == 0, 3).otherwise(1).alias("weight"), (F.col("n") % 8 == 0).alias("is_comment"))
    return guards.guarded_ranges(lines, functions.select(guard_id, "path", "fn_start", "fn_end"), evidence)


GUARDED = r"""WITH l AS (SELECT path, line, text, len(text) AS n, (line - 1) // 12 AS j, contains(text, ',') AS code,
  NOT contains(text, ',') AND regexp_replace(text, '^\s+', '') <> '' AND NOT starts_with(regexp_replace(text, '^\s+', ''), '#') AS comment
  FROM (SELECT doc_id AS path, unnest(string_split(coalesce(text, ''), chr(10))) AS text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS line FROM documents)),
f AS (SELECT path, j, min(line) AS fs, max(line) AS fe FROM l WHERE line % 12 > 0 GROUP BY 1, 2),
e AS (SELECT path, j, fs, fe, line, n, code FROM l JOIN f USING (path, j) WHERE line % 12 > 0 AND n % 4 = 0),
c0 AS (SELECT e.path, e.j, e.fs, e.fe, e.line, e.n, e.code,
  CASE WHEN e.code THEN e.line ELSE 1 + coalesce(max(l.line) FILTER (l.line < e.line AND NOT l.comment), e.fs - 1) END AS a,
  CASE WHEN e.code THEN e.line ELSE coalesce(min(l.line) FILTER (l.line > e.line AND NOT l.comment), e.fe + 1) - 1 END AS b
  FROM e JOIN l ON l.path = e.path AND l.line BETWEEN e.fs AND e.fe WHERE e.n % 8 = 0 GROUP BY e.path, e.j, e.fs, e.fe, e.line, e.n, e.code),
c AS (SELECT c0.*, coalesce((list_sort(list(l.line) FILTER (l.code AND l.line > c0.b)))[CASE WHEN c0.code THEN 2 ELSE 3 END], c0.fe) AS k
  FROM c0 JOIN l ON l.path = c0.path AND l.line BETWEEN c0.fs AND c0.fe GROUP BY c0.path, c0.j, c0.fs, c0.fe, c0.line, c0.n, c0.code, c0.a, c0.b),
u AS (SELECT path, j, fs, fe, line AS a, line + n % 3 AS k FROM e UNION ALL SELECT path, j, fs, fe, a, k FROM c),
r AS (SELECT path, j, fs, fe, greatest(min(a), fs) AS s, max(k) AS k FROM u GROUP BY path, j, fs, fe),
m AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY path, j ORDER BY n % 3 <> 0, line) = 1),
t AS (SELECT m.path, m.j, l.line, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(l.text, '^.*?(//+|/\*+)', ''), '\*+/.*$', ''), '^\s*\*+', ''), '^\s+|\s+$', '', 'g')) AS x
  FROM m JOIN l ON l.path = m.path AND l.line BETWEEN m.a AND m.b),
p AS (SELECT path, j, trim(regexp_replace(coalesce(string_agg(x, ' ' ORDER BY line) FILTER (x <> ''), ''), '\s+', ' ', 'g')) AS x FROM t GROUP BY 1, 2)
SELECT r.path * 100000 + r.j AS guard_id, r.path, s AS start, least(r.k, r.fe, s + 13) AS "end", m.a AS comment_line, CASE WHEN len(x) > 400 THEN rtrim(left(x, 399)) || '…' ELSE x END AS comment
FROM r LEFT JOIN m USING (path, j) LEFT JOIN p USING (path, j)"""


def _history(spark, sf_dir):
    """Orders as the histories of their customers, the newest first."""
    k = F.col("o_orderkey")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    newest = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), (F.row_number().over(newest) - 1).alias("pos"), F.concat(F.lit("c"), k.cast("string")).alias("sha"), F.col("o_orderdate").alias("authored_at"), F.col("o_orderpriority").alias("author_name"),
        pick(5, "imu: add a work-around", "driver: tidy", "Fix glitches of the chip", "docs", "éerrata").alias("subject"),
        pick(3, "Plain text. It guards against Silicon errata, rev 2. More.", "", "This reverts commit abc.\n\n  because it broke\nmore").alias("body"),
        (k % 4 == 0).alias("bugfix"), (k % 6 == 1).alias("rationale"), (k % 7 == 0).alias("revert"), F.when(k % 14 == 0, F.concat(F.lit("c"), F.floor(k / 10).cast("string"))).alias("revert_of"),
    )


_HISTORY = r"""WITH h AS (SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS pos, 'c' || o_orderkey AS sha, o_orderdate AS authored_at, o_orderpriority AS author_name,
['imu: add a work-around', 'driver: tidy', 'Fix glitches of the chip', 'docs', 'éerrata'][o_orderkey % 5 + 1] AS subject, o_orderkey % 3 AS b, o_orderkey % 4 = 0 AS bugfix, o_orderkey % 6 = 1 AS rationale, o_orderkey % 7 = 0 AS revert,
CASE WHEN o_orderkey % 14 = 0 THEN 'c' || (o_orderkey // 10) END AS revert_of,
CASE WHEN o_orderkey % 7 = 0 THEN 3 WHEN o_orderkey % 5 IN (0, 2, 4) THEN 2 WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS strength FROM orders)"""


def guard_origins(spark, sf_dir):
    """Why the lines of each customer's orders exist, and what a guard of them would be called."""
    found = guards.origins(_history(spark, sf_dir), "id")
    none = F.lit(None).cast("string")
    return found.withColumn("title", guards.title(F.col("subject"), F.col("stated"), none, none, F.lit("f"))).drop("subject")


ORIGINS = _HISTORY + r""", o AS (SELECT * FROM h WHERE NOT revert AND (strength > 0 OR bugfix OR rationale)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY strength = 0, strength DESC, CASE WHEN strength > 0 THEN authored_at END, CASE WHEN strength > 0 THEN pos ELSE -pos END) = 1),
t AS (SELECT *, regexp_replace(subject, '^[\w./-]+:\s*', '') AS bare FROM o)
SELECT id, sha, author_name, authored_at, [NULL, 'body', 'subject'][strength + 1] AS stated, CASE strength WHEN 1 THEN 'It guards against Silicon errata, rev 2.' ELSE subject END AS said, upper(left(bare, 1)) || substr(bare, 2) AS title FROM t"""


def guard_reverts(spark, sf_dir):
    """The newest revert among each customer's orders and what it undid."""
    history = _history(spark, sf_dir)
    commits = history.select("sha", "subject", "author_name", "authored_at")
    return guards.reverted_before(history, commits, "id")


REVERTS = (
    _HISTORY
    + """, r AS (SELECT * FROM h WHERE revert AND revert_of IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) = 1),
i AS (SELECT r.id, x.sha, x.subject, x.authored_at FROM r JOIN h x ON x.id = r.id AND starts_with(x.sha, r.revert_of) QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY x.pos) = 1),
c AS (SELECT r.*, coalesce(i.sha, x.sha) AS change_sha, coalesce(i.subject, x.subject) AS change_subject, coalesce(i.authored_at, x.authored_at) AS changed FROM r LEFT JOIN i USING (id) LEFT JOIN h x ON x.sha = r.revert_of)
SELECT id, sha AS revert_sha, change_sha, change_subject, floor((epoch(authored_at)::BIGINT - epoch(changed)::BIGINT) / 86400 + 0.5)::BIGINT AS days,
CASE b WHEN 0 THEN 'Plain text. It guards against Silicon errata, rev 2. More.' WHEN 2 THEN 'because it broke' END AS reason FROM c WHERE change_sha IS NOT NULL"""
)


def key_commits(spark, sf_dir):
    """The commit that says most about each customer's orders."""
    return history_rules.key_commits(_history(spark, sf_dir), "id")


KEY_COMMITS = (
    _HISTORY
    + """ SELECT id, sha, subject, revert, bugfix, rationale, strength IN (1, 2) AS explicit FROM h WHERE strength > 0 OR bugfix OR rationale
QUALIFY row_number() OVER (PARTITION BY id ORDER BY strength = 0, strength DESC, CASE WHEN strength > 0 THEN authored_at END, pos) = 1"""
)


def guard_cards(spark, sf_dir):
    """The dearest twenty parts of each brand as cards, those that share a type or, from any copy on, a size standing as one."""
    part = table(spark, sf_dir, "part")
    dearest = part.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))).where("r <= 20")
    keys = F.array(F.concat(F.lit("type:"), "p_type", F.lit(" "), (F.col("p_partkey") % 7).cast("string")), F.concat(F.lit("size:"), (F.col("p_size") % 25).cast("string")))
    cards = dearest.select("p_brand", F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5).alias("path"), F.col("p_retailprice").alias("rank"), keys.alias("keys"))
    return guards.group_cards(cards, "p_brand").withColumn("copies", F.array_join(F.transform("copies", lambda x: x.cast("string")), ","))


CARDS = """WITH RECURSIVE q AS (SELECT p_brand, p_partkey AS id, p_partkey % 5 AS path, ['type:' || p_type || ' ' || p_partkey % 7, 'size:' || p_size % 25] AS keys,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part QUALIFY r <= 20),
s(p_brand, r, ids, paths, keys, copies) AS (
  SELECT DISTINCT p_brand, 0::BIGINT, []::BIGINT[], []::BIGINT[], []::VARCHAR[][], []::BIGINT[][] FROM part
  UNION ALL
  SELECT p_brand, r, CASE WHEN twin IS NULL AND room THEN list_append(ids, id) ELSE ids END, CASE WHEN twin IS NULL AND room THEN list_append(paths, path) ELSE paths END,
    CASE WHEN twin IS NOT NULL THEN list_transform(keys, lambda k, i: CASE WHEN i = twin THEN list_distinct(list_concat(k, own)) ELSE k END) WHEN room THEN list_append(keys, own) ELSE keys END,
    CASE WHEN twin IS NOT NULL THEN list_transform(copies, lambda c, i: CASE WHEN i = twin THEN list_append(c, id) ELSE c END) WHEN room THEN list_append(copies, []::BIGINT[]) ELSE copies END
  FROM (SELECT s.p_brand, q.r, s.ids, s.paths, s.keys, s.copies, q.id, q.path, q.keys AS own, list_position(list_transform(s.keys, lambda k: list_has_any(k, q.keys)), true) AS twin,
    len(s.ids) < 8 AND len(list_filter(s.paths, lambda p: p = q.path)) < 3 AS room FROM s JOIN q ON q.p_brand = s.p_brand AND q.r = s.r + 1)),
e AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY r DESC) = 1)
SELECT p_brand, unnest(range(len(ids)))::INTEGER AS card_no, unnest(ids) AS id, unnest(list_transform(copies, lambda c: array_to_string(c, ','))) AS copies FROM e"""


def guard_report(spark, sf_dir):
    """The dearest twenty parts of each brand as places, with comments, origins, reverts and floors by their numbers: the cards."""
    k, size = F.col("p_partkey"), F.col("p_size")
    part = table(spark, sf_dir, "part")
    own = part.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey"))).where("r <= 20").withColumn("guard_id", k)
    candidates = own.select("guard_id", "p_brand", F.concat(F.lit("d/f"), (k % 5).cast("string"), F.lit(".c")).alias("path"), F.concat(F.lit("f"), k.cast("string")).alias("function"), (size / 10.0).alias("score"))
    comment = F.when(k % 3 == 0, F.concat(F.lit("One. A quirk of type "), (size % 20).cast("string"), F.lit(", mind it! More.")))
    ranges = own.select("guard_id", F.lit("").alias("path"), k.cast("int").alias("start"), (k + 3).cast("int").alias("end"), comment.alias("comment"))
    subject = F.concat(F.lit("drv/x: work-around "), (size % 9).cast("string"))
    origins = own.where("p_partkey % 2 = 0").select("guard_id", F.concat(F.lit("o"), (size % 11).cast("string")).alias("sha"), subject.alias("subject"), F.when(k % 4 == 0, "subject").alias("stated"))
    reverts = own.where("p_partkey % 7 = 0").select("guard_id", F.concat(F.lit("c"), (size % 6).cast("string")).alias("change_sha"), F.lit("lib: drop it").alias("change_subject"))
    floors = own.select("guard_id", F.get(F.array(*map(F.lit, history_rules.VERDICTS)), (k % 9 % 4).cast("int")).alias("floor"))
    found = guards.report(candidates, ranges, origins, reverts, floors, "p_brand")
    return found.withColumn("copies", F.array_join("copies", ",")).withColumn("rank", F.round("rank", 6))


REPORT = r"""WITH RECURSIVE b AS (SELECT p_brand, p_partkey AS k, p_size AS z, 'd/f' || p_partkey % 5 || '.c' AS path, p_partkey % 9 % 4 AS v, CASE WHEN p_partkey % 3 = 0 THEN 'A quirk of type ' || p_size % 20 || ', mind it' END AS head,
  CASE WHEN p_partkey % 3 = 0 THEN 'text:one a quirk of type ' || p_size % 20 || ' mind it more' END AS said, CASE WHEN p_partkey % 2 = 0 THEN 'Work-around ' || p_size % 9 END AS bare, CASE WHEN p_partkey % 7 = 0 THEN 'revert:c' || p_size % 6 END AS undone
  FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 20),
t AS (SELECT *, CASE WHEN k % 4 = 0 THEN bare WHEN head IS NOT NULL THEN head WHEN bare IS NOT NULL THEN bare WHEN undone IS NOT NULL THEN 'Reverted before: drop it' ELSE 'f' || k || ': code with a workaround history' END AS title,
  round(v * 10 + CASE WHEN undone IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN k % 4 = 0 THEN 4 WHEN bare IS NOT NULL THEN 1 ELSE 0 END + z / 10, 6) AS rank, path || ':' || k AS id FROM b WHERE v >= 2),
q AS (SELECT *, list_filter([undone, CASE WHEN k % 4 = 0 THEN 'origin:o' || z % 11 END, said, 'text:' || trim(regexp_replace(lower(title), '[^a-z0-9_]+', ' ', 'g'))], lambda x: x IS NOT NULL) AS own, row_number() OVER (PARTITION BY p_brand ORDER BY rank DESC, id) AS r FROM t),
s(p_brand, r, ids, paths, keys, copies) AS (
  SELECT DISTINCT p_brand, 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[][], []::VARCHAR[][] FROM q
  UNION ALL
  SELECT p_brand, r, CASE WHEN twin IS NULL AND room THEN list_append(ids, id) ELSE ids END, CASE WHEN twin IS NULL AND room THEN list_append(paths, path) ELSE paths END,
    CASE WHEN twin IS NOT NULL THEN list_transform(keys, lambda k, i: CASE WHEN i = twin THEN list_distinct(list_concat(k, own)) ELSE k END) WHEN room THEN list_append(keys, own) ELSE keys END,
    CASE WHEN twin IS NOT NULL THEN list_transform(copies, lambda c, i: CASE WHEN i = twin THEN list_append(c, id) ELSE c END) WHEN room THEN list_append(copies, []::VARCHAR[]) ELSE copies END
  FROM (SELECT s.p_brand, q.r, s.ids, s.paths, s.keys, s.copies, q.id, q.path, q.own, list_position(list_transform(s.keys, lambda k: list_has_any(k, q.own)), true) AS twin,
    len(s.ids) < 8 AND len(list_filter(s.paths, lambda p: p = q.path)) < 3 AS room FROM s JOIN q ON q.p_brand = s.p_brand AND q.r = s.r + 1)),
e AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY r DESC) = 1),
g AS (SELECT p_brand, unnest(range(len(ids)))::INTEGER AS card_no, unnest(ids) AS id, unnest(list_transform(copies, lambda c: array_to_string(c, ','))) AS copies FROM e)
SELECT g.p_brand, card_no, k AS guard_id, id, title, ['SAFE', 'RISKY', 'DANGEROUS', 'STOP'][v + 1] AS verdict, rank, path, k::INTEGER AS start, (k + 3)::INTEGER AS "end", copies FROM g JOIN t USING (p_brand, id)"""


def _lines(spark, sf_dir):
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    return table(spark, sf_dir, "lineitem").withColumn("nth", nth).withColumn("case_id", F.col("l_orderkey"))


def floor_reasons(spark, sf_dir):
    """Orders as changes: every rule that holds for each, with the floor of its verdict."""
    k = F.col("o_orderkey")
    pick = lambda c, *values: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    cases = table(spark, sf_dir, "orders").select(k.alias("case_id"), (k % 11 == 0).alias("behaviour_free"), pick(k, "complete", "partial", "insufficient").alias("completeness"), (k % 2).alias("related_tests"))
    lines, where = _lines(spark, sf_dir), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("where")
    flag = F.col("l_returnflag")
    sha, subject = F.concat(F.lit("0000000000"), F.col("l_suppkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    history = lines.where("l_linestatus = 'F'").select("case_id", "nth", where, sha.alias("sha"), subject.alias("subject"), (flag == "R").alias("revert"), (F.col("l_partkey") % 2 == 0).alias("bugfix"), (F.col("l_partkey") % 3 == 0).alias("rationale"), ((flag == "A") & (F.col("l_suppkey") % 4 == 0)).alias("explicit"))
    comments = lines.where("l_linenumber = 3 AND l_partkey % 5 = 0").select("case_id", "nth", where, subject.alias("comment"))
    signals = lines.select("case_id", "nth", where, pick(F.col("l_suppkey"), "isr", "bus_io", "timing", "hw_access").alias("kind"))
    touched = lines.where("l_linenumber < 6").select("case_id", "nth", subject.alias("name"), pick(F.col("l_partkey"), "low", "medium", "high").alias("level"))
    reasons = history_rules.floor_reasons(cases, history, comments, signals, touched)
    return history_rules.with_floors(reasons).select("case_id", "place.step", F.when(F.col("place.step").between(1, 4), F.col("place.nth")).otherwise(0).alias("nth"), "rule", "verdict", "detail", "floor")


FLOOR = """WITH l AS (SELECT l_orderkey AS case_id, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, l_returnflag AS f, l_linestatus AS st, 'p:' || l_partkey AS w,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nth FROM lineitem),
o AS (SELECT o_orderkey AS case_id, o_orderkey % 11 = 0 AS free, ['complete', 'partial', 'insufficient'][o_orderkey % 3 + 1] AS c, o_orderkey % 2 AS tests FROM orders),
a AS (SELECT l.*, c, tests FROM l JOIN o USING (case_id) WHERE NOT free),
k AS (SELECT case_id, ['isr', 'bus_io', 'timing', 'hw_access'][s % 4 + 1] AS kind, nth, w FROM a WHERE s % 4 <> 1),
kk AS (SELECT case_id, kind, min(nth) AS first, count(*) AS n, array_to_string(list(w ORDER BY nth)[1:3], ', ') AS few FROM k GROUP BY 1, 2),
t AS (SELECT case_id, array_to_string(list('s' || s || ' (' || ['low', 'medium', 'high'][p % 3 + 1] || ')' ORDER BY nth)[1:4], ', ') AS few FROM a WHERE n < 6 AND p % 3 > 0 GROUP BY 1),
h AS (SELECT case_id, nth, w, f = 'R' AS rev, f = 'A' AND s % 4 = 0 AS ex, p % 2 = 0 AS bug, p % 3 = 0 AS rat, '0000000000 "s' || s || '"' AS said FROM a WHERE st = 'F'),
r AS (SELECT case_id, 0 AS step, 0 AS nth, 'change_class' AS rule, 1 AS v, 'Only comments, whitespace, log/message strings or docs change: no behaviour change.' AS detail FROM o WHERE free
UNION ALL SELECT case_id, 1, nth, CASE WHEN rev THEN 'reverted_before' ELSE 'explicit_workaround' END, 4, CASE WHEN rev THEN w || ': its history includes a revert (' || said || ')' ELSE w || ': shaped by ' || said END FROM h WHERE rev OR ex
UNION ALL SELECT case_id, 2, nth, 'workaround_comment', 4, w || ': under the comment "s' || s || '"' FROM a WHERE n = 3 AND p % 5 = 0
UNION ALL SELECT case_id, 3, nth, 'bugfix_history', 3, w || ': shaped by ' || CASE WHEN bug THEN 'bug-fix' ELSE 'HW/timing' END || ' commit ' || said FROM h WHERE NOT rev AND NOT ex AND (bug OR rat)
UNION ALL SELECT case_id, 4, first, 'contract_signal', 3, kind || ' on ' || few || CASE WHEN n > 3 THEN ' (+' || (n - 3) || ')' ELSE '' END FROM kk
UNION ALL SELECT DISTINCT case_id, 5, 0, 'incomplete_analysis', 2, 'analysis completeness is ' || c FROM a WHERE n < 6 AND c <> 'complete'
UNION ALL SELECT case_id, 6, 0, 'critical_symbol', 2, few FROM t
UNION ALL SELECT case_id, 7, 0, 'no_related_tests', 2, 'no test references the touched code' FROM o WHERE NOT free AND tests = 0),
e AS (FROM r UNION ALL SELECT case_id, 8, 0, 'no_rule', 1, 'complete analysis, no critical signals, related tests found' FROM o WHERE case_id NOT IN (SELECT case_id FROM r))
SELECT case_id, step, nth, rule, ['SAFE', 'RISKY', 'DANGEROUS', 'STOP'][v] AS verdict, detail, ['SAFE', 'RISKY', 'DANGEROUS', 'STOP'][max(v) OVER (PARTITION BY case_id)] AS floor FROM e"""


def completeness_reasons(spark, sf_dir):
    """Orders as changes: how completely each is analysed, and every reason."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open"))
    k, n = F.col("o_orderkey"), F.col("n")
    names = F.transform(F.sequence(F.lit(1), (k % 5).cast("int")), lambda i: F.concat(F.lit("d/f"), i.cast("string"), F.lit(".py")))
    cases = table(spark, sf_dir, "orders").join(lines, k == F.col("k")).select(
        k.alias("case_id"), F.when(k % 13 == 0, n).otherwise(0).alias("bad_parse"), F.when(k % 17 == 0, 1).otherwise(0).alias("history_failures"), F.when(k % 5 > 0, names).otherwise(F.array().cast("array<string>")).alias("unanalysed"),
        F.when(n > 5, n - 5).otherwise(0).alias("outside_functions"), F.col("returned").alias("ambiguous"), F.when(k % 3 == 0, F.col("open")).otherwise(0).alias("unresolved"), F.when(n == 2, 2).otherwise(0).alias("boundary"),
        F.when(k % 4 == 0, "src/drv").otherwise("").alias("scope"), (k % 2).alias("variants"), n.alias("touched"), (k % 6 > 0).alias("scan_covers"),
    )
    return history_rules.completeness(cases).select("case_id", "level", F.array_join(F.transform("reasons", lambda r: F.concat(r["level"], F.lit(": "), r["text"])), "; ").alias("reasons"))


COMPLETENESS = """WITH l AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1),
x AS (SELECT k AS case_id, k % 13 = 0 OR k % 17 = 0 AS bad, list_filter([
CASE WHEN k % 13 = 0 THEN 'insufficient: ' || n || ' changed file(s) failed to parse cleanly' END, CASE WHEN k % 17 = 0 THEN 'insufficient: line history unavailable for 1 hunk(s)' END,
CASE WHEN k % 5 > 0 THEN 'partial: ' || k % 5 || ' changed non-C/C++ file(s) not analysed (' || array_to_string(['f1.py', 'f2.py', 'f3.py'][1:k % 5], ', ') || ')' END,
CASE WHEN n > 5 THEN 'partial: ' || (n - 5) || ' change(s) outside any function (declarations, globals, macros): dependents found by name only' END,
CASE WHEN r > 0 THEN 'partial: ' || r || ' ambiguous dependency edge(s) reached (overloads / same-named methods)' END,
CASE WHEN k % 3 = 0 AND o > 0 THEN 'partial: ' || o || ' unresolved call(s) (function pointers / callbacks) in the touched code' END,
CASE WHEN n = 2 THEN 'partial: 2 reference(s) from outside ' || CASE WHEN k % 4 = 0 THEN 'src/drv' ELSE 'the scope' END || ', matched by name' END,
CASE WHEN k % 2 > 0 THEN 'partial: #else/#elif platform variants in 1 changed file(s) not analysed' END,
CASE WHEN k % 6 = 0 THEN 'partial: no scan of this repo covers the change: git risk signals limited to the changed lines' END], lambda t: t IS NOT NULL) AS why FROM orders JOIN l ON k = o_orderkey)
SELECT case_id, CASE WHEN bad THEN 'insufficient' WHEN len(why) > 0 THEN 'partial' ELSE 'complete' END AS level, array_to_string(why, '; ') AS reasons FROM x"""


def _range_logs(spark, sf_dir):
    """Each document as the log of a range: three of its lines an entry, every other one added, the rest removed."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    entries = F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 3).cast("int"))

    def record(k: Column) -> Column:
        diff = F.transform(F.slice(F.col("l"), k * 3 + 1, F.lit(3)), lambda x, i: F.concat(F.when((i + k) % 2 == 0, "+").otherwise("-"), x))
        head = F.concat_ws("\x1f", F.concat(F.lit("e"), k.cast("string")), F.lit("Ada"), F.lit("a@b"), (F.col("doc_id") + k).cast("string"), F.when(k % 3 == 0, "Fix the glitch\n\nbody of it ").otherwise(" Revert it"))
        return F.concat(F.lit("\x1e"), head, F.lit("\x1d\n--- a/f\n+++ b/f\n"), F.array_join(diff, "\n"))

    docs = table(spark, sf_dir, "documents").select("doc_id", lines.alias("l"))
    return docs.select(F.col("doc_id").alias("id"), F.array_join(F.transform(entries, record), "").alias("text"), F.slice("l", F.greatest(F.size("l") - 4, F.lit(1)), F.lit(5)).alias("now"))


def line_history_entries(spark, sf_dir):
    """The entries of ranges' histories: lines of each side, flags, and whether the log ended early."""
    found = line_history.line_history(_range_logs(spark, sf_dir).select("id", "text"), 8)
    side = lambda c: F.array_join(F.col(c), "|").alias(c)
    return found.select("id", "pos", "sha", "author_name", "author_email", F.unix_timestamp("authored_at").alias("seconds"), "subject", "body", "bugfix", "rationale", "revert", "truncated", side("added"), side("removed"))


_LOGS = """WITH d AS (SELECT doc_id AS id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT id, l, unnest(range((len(l) - 1) // 3 + 1)) AS pos FROM d),
s AS (SELECT id, len(l) AS n, pos, l[pos * 3 + 1:pos * 3 + 3] AS x FROM e),
h AS (SELECT *, list_filter(x, lambda y, i: (i - 1 + pos) % 2 = 0 AND NOT starts_with(y, '++')) AS added, list_filter(x, lambda y, i: (i - 1 + pos) % 2 = 1 AND NOT starts_with(y, '--')) AS removed FROM s)"""
ENTRIES = (
    _LOGS
    + """ SELECT id, pos::INTEGER AS pos, 'e' || pos AS sha, 'Ada' AS author_name, 'a@b' AS author_email, id + pos AS seconds, CASE WHEN pos % 3 = 0 THEN 'Fix the glitch' ELSE 'Revert it' END AS subject,
CASE WHEN pos % 3 = 0 THEN 'body of it' ELSE '' END AS body, pos % 3 = 0 AS bugfix, pos % 3 = 0 AS rationale, pos % 3 > 0 AS revert, (n - 1) // 3 + 1 >= 8 AS truncated, array_to_string(added, '|') AS added, array_to_string(removed, '|') AS removed FROM h"""
)


def line_introduced_by(spark, sf_dir):
    """The oldest entry of each range's history that added one of its last five lines as it reads now."""
    logs = _range_logs(spark, sf_dir)
    return line_history.introduced_by(line_history.line_history(logs.select("id", "text")), logs.select("id", F.explode("now").alias("line")))


INTRODUCED = (
    _LOGS
    + r""", w AS (SELECT DISTINCT id, regexp_replace(unnest(l[greatest(len(l) - 4, 1):]), '\s+', '', 'g') AS b FROM d), a AS (SELECT id, pos, regexp_replace(unnest(added), '\s+', '', 'g') AS b FROM h)
SELECT id, 'e' || max(pos) AS sha FROM a JOIN w USING (id, b) WHERE b <> '' GROUP BY id"""
)


def renamed_histories(spark, sf_dir):
    """Order lines as changes of files, some renames: the changes of each file of today, under all its names."""
    lines = _lines(spark, sf_dir)
    name = lambda c: F.concat(F.lit("p"), (c % 400).cast("string"))
    moved = (F.col("l_returnflag") == "R") & (F.col("nth") < 3)
    changes = lines.select(F.col("l_orderkey").alias("commit"), F.col("nth").cast("int").alias("change"), F.when(moved, "R").when(F.col("l_returnflag") == "A", "C").otherwise("M").alias("status"), name(F.col("l_partkey")).alias("path"), F.when(F.col("l_returnflag") != "N", name(F.col("l_partkey") * 7 + F.col("l_suppkey"))).alias("old_path"))
    files = table(spark, sf_dir, "part").where("p_partkey % 400 < 60").select(name(F.col("p_partkey")).alias("path")).distinct()
    met = renames.follow_renames(changes, files)
    return met.groupBy("file").agg(F.count("*").alias("changes"), F.count_distinct("commit").alias("commits"), F.sum(F.col("commit") * 10 + F.col("change")).alias("sum"))


RENAMED = """WITH RECURSIVE l AS (SELECT l_orderkey AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n, l_partkey % 400 AS path, (l_partkey * 7 + l_suppkey) % 400 AS old, l_returnflag AS f FROM lineitem),
t AS (SELECT c * 100 + n AS pos, * FROM l), s AS (SELECT DISTINCT p_partkey % 400 AS path FROM part WHERE p_partkey % 400 < 60), r AS (SELECT pos, path, old FROM t WHERE f = 'R' AND n < 3),
g(pos) AS (SELECT pos FROM r WHERE path IN (FROM s) UNION SELECT r.pos FROM r JOIN (SELECT old, min(r.pos) AS pos FROM g JOIN r USING (pos) GROUP BY 1) k ON r.path = k.old AND k.pos < r.pos),
d AS (SELECT r.* FROM r JOIN g USING (pos)),
p AS (SELECT d.pos, d.path, d.old, x.pos AS up FROM d ASOF LEFT JOIN (SELECT pos, old AS name FROM d) x ON d.path = x.name AND d.pos > x.pos),
u(pos, old, top, up) AS (SELECT pos, old, path, up FROM p UNION ALL SELECT u.pos, u.old, p.path, p.up FROM u JOIN p ON p.pos = u.up),
a AS (SELECT pos, old, top FROM u WHERE up IS NULL),
m AS (SELECT t.c, t.n, coalesce(x.top, s.path) AS file FROM t ASOF LEFT JOIN (SELECT pos, old AS name, top FROM a) x ON t.path = x.name AND t.pos > x.pos LEFT JOIN s ON s.path = t.path)
SELECT 'p' || file AS file, count(*) AS changes, count(DISTINCT c) AS commits, sum(c * 10 + n)::BIGINT AS sum FROM m WHERE file IS NOT NULL GROUP BY file"""


CATALOGUE = {
    "guarded_ranges": (guarded_ranges, GUARDED),
    "guard_origins": (guard_origins, ORIGINS),
    "guard_reverts": (guard_reverts, REVERTS),
    "guard_cards": (guard_cards, CARDS),
    "guard_report": (guard_report, REPORT),
    "key_commits": (key_commits, KEY_COMMITS),
    "floor_reasons": (floor_reasons, FLOOR),
    "completeness_reasons": (completeness_reasons, COMPLETENESS),
    "line_history_entries": (line_history_entries, ENTRIES),
    "line_introduced_by": (line_introduced_by, INTRODUCED),
    "renamed_histories": (renamed_histories, RENAMED),
}
