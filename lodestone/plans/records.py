"""Queries of stored records: control tables, reviews' joins, ownership and raw diffs, loose JSON, object streams, snapshots and the pack."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import control, pack, review
from lodestone.operators.lineage import shared_folder
from lodestone.plans.common import table
from lodestone.sources import loose_json, object_stream, repository, store


def _runs(spark, sf_dir):
    """Orders as runs of snapshots, one snapshot a customer."""
    k = F.col("o_orderkey")
    state = F.when(k % 4 == 0, "done").when(k % 4 == 1, "failed").when(k % 4 == 2, "queued").otherwise("running")
    return table(spark, sf_dir, "orders").select(k.alias("run_id"), F.col("o_custkey").alias("snapshot_id"), state.alias("state"), F.col("o_orderdate").alias("at"))


def control_scan_once(spark, sf_dir):
    """The run that each customer's request may use."""
    requests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("snapshot_id"))
    return control.scan_once(requests, _runs(spark, sf_dir).withColumn("at", F.struct("at", "run_id")))


SCAN_ONCE = """WITH r AS (SELECT * FROM orders WHERE o_orderkey % 4 <> 1 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4 = 0 DESC, o_orderdate DESC, o_orderkey DESC) = 1)
SELECT c_custkey AS snapshot_id, o_orderkey AS run_id FROM customer LEFT JOIN r ON o_custkey = c_custkey"""


def control_interrupted(spark, sf_dir):
    """The states of runs once the service has stopped."""
    return control.mark_interrupted(_runs(spark, sf_dir)).groupBy("snapshot_id", "state").agg(F.count("*").alias("runs"))


INTERRUPTED = "SELECT o_custkey AS snapshot_id, CASE o_orderkey % 4 WHEN 0 THEN 'done' ELSE 'failed' END AS state, count(*) AS runs FROM orders GROUP BY 1, 2"


def control_tokens(spark, sf_dir):
    """Tokens of each order's calls, those answered from the cache left out."""
    return control.token_totals(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_quantity").cast("long").alias("tokens"), (F.col("l_returnflag") == "R").alias("cached")))


TOKENS = "SELECT l_orderkey AS run_id, coalesce(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity::BIGINT END), 0)::BIGINT AS tokens FROM lineitem GROUP BY 1"


def control_insert(spark, sf_dir):
    """An inventory of the parts of even number, to which the parts of all lines are added once."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.lit("old").alias("note"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.lit("new").alias("note"))
    return control.insert_absent(part.where("k % 2 = 0"), lines, ["k"])


INSERT = "SELECT p_partkey AS k, 'old' AS note FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT DISTINCT l_partkey, 'new' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0)"


def control_upsert(spark, sf_dir):
    """The last order of each customer, from a table of half of them and later ones."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), "o_orderkey")
    return control.upsert(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1"), ["o_custkey"], "at").select("o_custkey", "o_orderkey")


UPSERT = "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


def control_delete(spark, sf_dir):
    """Parts that no order has left once the orders of all but a few customers go."""
    references = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).distinct()
    gone = table(spark, sf_dir, "orders").where("o_custkey % 40 <> 1").select(F.col("o_orderkey").alias("l_orderkey"))
    return control.delete_with_references(references, table(spark, sf_dir, "part").select("p_partkey"), gone, ("l_orderkey", "p_partkey"))


DELETE = """WITH r AS (SELECT DISTINCT l_partkey, o_custkey % 40 <> 1 AS gone FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM r) AND p_partkey NOT IN (SELECT l_partkey FROM r WHERE NOT gone)"""


def citation_links(spark, sf_dir):
    """The address and the label of a citation for each part."""
    k, size = F.col("p_partkey"), F.col("p_size")
    start, end = F.when(size % 3 > 0, size), size + size % 2
    path, sha = F.concat(F.lit("d/f"), k.cast("string")), F.sha1(k.cast("string"))
    kind = F.when(k % 2 == 0, "commit").otherwise("code")
    return table(spark, sf_dir, "part").select("p_partkey", control.permalink(F.lit("o/r"), sha, path, start, end).alias("link"), control.citation_label(kind, path, start, end, sha).alias("label"))


LINKS = """WITH p AS (SELECT p_partkey, p_size AS s, 'd/f' || p_partkey AS path, sha1(p_partkey::VARCHAR) AS sha FROM part)
SELECT p_partkey, 'https://github.com/o/r/blob/' || sha || '/' || path || CASE WHEN s % 3 > 0 THEN '#L' || s || CASE WHEN s % 2 = 1 THEN '-L' || (s + 1) ELSE '' END ELSE '' END AS link,
CASE WHEN p_partkey % 2 = 0 THEN substr(sha, 1, 8) ELSE path || CASE WHEN s % 3 > 0 THEN ':' || s || CASE WHEN s % 2 = 1 THEN '-' || (s + 1) ELSE '' END ELSE '' END END AS label FROM p"""


def _change(spark, sf_dir):
    """Parts as functions of files by number, and order lines as hunks of the files."""
    k = F.col("p_partkey")
    functions = table(spark, sf_dir, "part").select(k.alias("id"), (k % 40).alias("path"), (k * 3).alias("start"), (k * 3 + F.col("p_size")).alias("end"), F.when(F.col("p_size") > 40, "medium").otherwise("low").alias("level"), F.concat(F.lit("f"), (k % 9).cast("string")).alias("name"))
    hunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hunk_id"), (F.col("o_custkey") % 40).alias("path"), (F.col("o_custkey") * 3).alias("old_start"), (F.col("o_orderkey") % 4).alias("old_count"))
    key = F.col("c_custkey")
    kind = F.when(key % 3 == 0, "workaround_comment").otherwise("timing")
    marks = table(spark, sf_dir, "customer").select((key % 40).alias("path"), (key * 3).alias("start"), (key * 3 + 1).alias("end"), kind.alias("kind"), F.when(key % 3 == 0, "comment").when(key % 3 == 1, "static").otherwise("git").alias("source"), F.lit("s").alias("snippet"), F.lit(1).alias("weight"))
    return functions, hunks, marks


_CHANGE = """WITH f AS (SELECT p_partkey AS id, p_partkey % 40 AS path, p_partkey * 3 AS s, p_partkey * 3 + p_size AS e, p_size > 40 AS high, 'f' || p_partkey % 9 AS name FROM part),
h AS (SELECT o_orderkey AS hunk_id, o_custkey % 40 AS path, o_custkey * 3 AS a, o_custkey * 3 + greatest(o_orderkey % 4, 1) - 1 AS b FROM orders),
m AS (SELECT c_custkey % 40 AS path, c_custkey * 3 AS s, c_custkey * 3 + 1 AS e, CASE c_custkey % 3 WHEN 0 THEN 'workaround_comment' ELSE 'timing' END AS kind, ['comment', 'static', 'git'][c_custkey % 3 + 1] AS source FROM customer)"""


def hunk_functions(spark, sf_dir):
    """The innermost functions of the lines that each hunk changes."""
    functions, hunks, _ = _change(spark, sf_dir)
    return review.hunk_functions(hunks, functions)


HUNK_FUNCTIONS = (
    _CHANGE
    + """, l AS (SELECT hunk_id, path, unnest(range(a, b + 1)) AS line FROM h), i AS (SELECT hunk_id, line, id FROM l JOIN f ON f.path = l.path AND line BETWEEN s AND e
QUALIFY row_number() OVER (PARTITION BY hunk_id, line ORDER BY e - s, s DESC, id) = 1) SELECT DISTINCT hunk_id, id AS function_id FROM i"""
)


def hunk_signals(spark, sf_dir):
    """The signals that each hunk touches."""
    _, hunks, marks = _change(spark, sf_dir)
    return review.hunk_signals(hunks, marks)


HUNK_SIGNALS = (
    _CHANGE
    + """ SELECT hunk_id, m.path, s AS start, e AS "end", kind, source, 's' AS snippet, 1 AS weight FROM h JOIN m ON m.path = h.path AND s <= b AND e >= a - CASE kind WHEN 'workaround_comment' THEN 5 ELSE 0 END WHERE source <> 'git'"""
)


def untested_functions(spark, sf_dir):
    """Critical functions, by level or a signal inside, that no test names."""
    functions, _, marks = _change(spark, sf_dir)
    tests = table(spark, sf_dir, "nation").where("n_nationkey < 4").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("name"))
    return review.untested(functions, tests, marks)


UNTESTED = _CHANGE + " SELECT DISTINCT id, name FROM f WHERE (high OR EXISTS (SELECT 1 FROM m WHERE m.path = f.path AND m.s <= f.e AND m.e >= f.s)) AND name NOT IN (SELECT 'f' || n_nationkey FROM nation WHERE n_nationkey < 4)"


def raised_verdicts(spark, sf_dir):
    """What a proposal makes of each order's verdict."""
    k = F.col("o_orderkey")
    pick = lambda c: F.get(F.array(*map(F.lit, review.VERDICTS)), (c % 4).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", review.raised(pick(k), pick(F.col("o_custkey")), k % 3).alias("verdict"))


RAISED = "SELECT o_orderkey, ['SAFE', 'RISKY', 'DANGEROUS', 'STOP'][1 + CASE WHEN o_orderkey % 3 > 0 THEN greatest(o_orderkey % 4, o_custkey % 4) ELSE o_orderkey % 4 END] AS verdict FROM orders"


def latest_reviews(spark, sf_dir):
    """The last review of each customer's change."""
    k = F.col("o_orderkey")
    return review.latest_review(table(spark, sf_dir, "orders").select(F.lit("o/r").alias("repo"), F.col("o_custkey").alias("number"), k.alias("review_id"), F.col("o_orderdate").alias("at"))).select("number", "review_id")


LATEST_REVIEWS = "SELECT o_custkey AS number, o_orderkey AS review_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


def blame_parse(spark, sf_dir):
    """Orders' lines written as ownership listings of their order and read back."""
    lines = table(spark, sf_dir, "lineitem").distinct()
    size = F.col("l_quantity").cast("int").cast("string")
    record = F.concat(F.sha1(F.col("l_partkey").cast("string")), F.lit(" "), F.col("l_suppkey").cast("string"), F.lit(" "), F.col("l_linenumber").cast("string"), F.lit(" "), size, F.lit("\nauthor A B\nsummary filename of it\nfilename a dir/f"), F.col("l_partkey").cast("string"), F.lit("\n"))
    return repository.blame_ranges(lines.groupBy(F.col("l_orderkey").alias("path")).agg(F.array_join(F.array_sort(F.collect_list(record)), "").alias("text")))


BLAME = """SELECT l_orderkey AS path, l_linenumber AS start, l_linenumber + l_quantity::INTEGER - 1 AS "end", sha1(l_partkey::VARCHAR) AS sha, 'a dir/f' || l_partkey AS orig_path, l_suppkey::INTEGER AS orig_start FROM (SELECT DISTINCT * FROM lineitem)"""


def raw_diff_parse(spark, sf_dir):
    """Orders' lines written as raw diffs of their order and read back."""
    gone, sha = F.lit(repository.NO_OBJECT), F.sha1(F.col("l_partkey").cast("string"))
    flag = F.col("l_returnflag")
    entry = F.concat(F.lit(":100644 100644 "), F.when(flag == "A", gone).otherwise(sha), F.lit(" "), F.when(flag == "R", gone).otherwise(sha), F.when(flag == "A", " A").when(flag == "R", " D").otherwise(" M"), F.lit("\0d/p "), F.col("l_partkey").cast("string"), F.lit("\0"))
    texts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("text"))
    return repository.raw_diff(texts).groupBy("id", "path", "old_blob", "new_blob").agg(F.count("*").alias("n"))


RAW_DIFF = """SELECT l_orderkey AS id, 'd/p ' || l_partkey AS path, CASE WHEN l_returnflag <> 'A' THEN sha1(l_partkey::VARCHAR) END AS old_blob, CASE WHEN l_returnflag <> 'R' THEN sha1(l_partkey::VARCHAR) END AS new_blob, count(*) AS n FROM lineitem GROUP BY ALL"""


def loose_objects(spark, sf_dir):
    """Turns of conversations as answers that hold an object: fenced, repeated, broken before, with raw line ends, cut off, or none."""
    told = F.translate(F.coalesce("text", F.lit("")), '{}"\\', "()'/")
    safe = F.regexp_replace(told, r"[\x00-\x1f]", " ")
    kind, turn = F.col("conv_id") % 6, F.col("turn").cast("string")
    whole = F.concat(F.lit('{"answer": "'), safe, F.lit('", "turn": '), turn, F.lit("}"))
    text = (
        F.when(kind == 0, F.concat(F.lit('<think>no {"a": 1} here</think>```json\n'), whole, F.lit("\n```")))
        .when(kind == 1, F.concat(told, whole, F.lit(" and "), whole))
        .when(kind == 2, F.concat(F.lit("{not so} "), whole, told))
        .when(kind == 3, F.concat(F.lit('{"answer": "a\nb\tc", "l": ["'), safe, F.lit('",\n],\n}')))
        .when(kind == 4, F.concat(F.lit('{"answer": "'), safe, F.lit('", "claims": [{"text": "cut')))
        .otherwise(told)
    )
    found = loose_json.loose_json(table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text")))
    return found.select("conv_id", "turn", "json", "repaired", F.size("objects").alias("objects"), "value")


LOOSE = r"""WITH c AS (SELECT conv_id, turn, conv_id % 6 AS k, regexp_replace(translate(coalesce(text, ''), '{}"\', '()''/'), '[\x00-\x1f]', ' ', 'g') AS t FROM conversations),
w AS (SELECT *, '{"answer": "' || t || '", "turn": ' || turn || '}' AS whole FROM c)
SELECT conv_id, turn, CASE WHEN k < 3 THEN whole WHEN k = 3 THEN '{"answer": "a\nb\tc", "l": ["' || t || '"' || chr(10) || ']' || chr(10) || '}' END AS json, CASE WHEN k < 3 THEN false WHEN k = 3 THEN true END AS repaired,
CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END::INTEGER AS objects, CASE WHEN k IN (0, 1, 2, 4) THEN t WHEN k = 3 THEN 'a' || chr(10) || 'b' || chr(9) || 'c' END AS value FROM w"""


def object_round_trip(spark, sf_dir):
    """Documents written as a framed stream of objects, some of them missing and all twice, and read back."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    lost = F.col("doc_id") % 7 == 0
    objects = table(spark, sf_dir, "documents").select(object_stream.object_id(text).alias("id"), F.lit("blob").alias("kind"), text.alias("content"), lost.alias("missing"))
    folder = f"{shared_folder(spark)}/objects-{uuid.uuid4().hex}"
    object_stream.write_objects(objects.unionByName(objects), folder)
    read = object_stream.read_objects(spark, folder)
    found = object_stream.blobs(read)
    gone = object_stream.missing(read, objects.select("id"))
    return found.select("id", F.length("text").cast("long").alias("chars"), F.sha1("text").alias("digest")).unionByName(gone.select("id", F.lit(None).cast("long").alias("chars"), F.lit(None).cast("string").alias("digest")))


OBJECTS = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha1('blob ' || strlen(coalesce(text, '')) || chr(0) || coalesce(text, '')) AS id FROM documents), g AS (SELECT id, bool_or(doc_id % 7 <> 0) AS there, min(t) AS t FROM d GROUP BY 1)
SELECT id, CASE WHEN there THEN length(t) END AS chars, CASE WHEN there THEN sha1(t) END AS digest FROM g"""


def stored_snapshots(spark, sf_dir):
    """Order lines stored as snapshots by return flag, one of them deleted, and read back; signals with the function around them."""
    lines = table(spark, sf_dir, "lineitem")
    at = store.SnapshotStore(spark, f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}")
    key = F.col("l_partkey")
    for flag in ("A", "N", "R"):
        own = lines.where(F.col("l_returnflag") == flag)
        functions = own.select((key % 50).alias("path"), key.alias("id"), F.lit("function").alias("kind"), key.alias("start"), (key + 9).alias("end"), F.repeat(F.lit("x"), (key % 600).cast("int")).alias("signature")).distinct()
        signals = own.select((F.col("l_suppkey") % 50).alias("path"), F.col("l_suppkey").alias("start")).distinct()
        at.save(f"flag {flag}", {"symbols": functions, "signals": store.with_enclosing(signals, functions)})
    at.delete("flag N")
    symbols = at.load("symbols").groupBy("snapshot").agg(F.count("*").alias("symbols"), F.sum(F.length("signature")).alias("chars"))
    signals = at.load("signals").groupBy("snapshot").agg(F.count("*").alias("signals"), F.sum("symbol_id").alias("enclosing"))
    return symbols.join(signals, "snapshot")


SNAPSHOTS = """WITH f AS (SELECT DISTINCT 'flag ' || l_returnflag AS snapshot, l_partkey AS k FROM lineitem WHERE l_returnflag <> 'N'), s AS (SELECT DISTINCT 'flag ' || l_returnflag AS snapshot, l_suppkey AS k FROM lineitem WHERE l_returnflag <> 'N'),
e AS (SELECT s.snapshot, s.k, min(f.k) AS id FROM s LEFT JOIN f ON f.snapshot = s.snapshot AND f.k % 50 = s.k % 50 AND s.k BETWEEN f.k AND f.k + 9 GROUP BY 1, 2),
a AS (SELECT snapshot, count(*) AS symbols, sum(least(k % 600, 500))::BIGINT AS chars FROM f GROUP BY 1), b AS (SELECT snapshot, count(*) AS signals, sum(id)::BIGINT AS enclosing FROM e GROUP BY 1) SELECT * FROM a JOIN b USING (snapshot)"""


def open_questions(spark, sf_dir):
    """Orders as comments whose customer's commit explains them or not, and the ends that are open."""
    k = F.col("o_orderkey")
    signals = table(spark, sf_dir, "orders").select(k.alias("nth"), (F.col("o_custkey") % 30).alias("path"), F.col("o_custkey").alias("start"), F.col("o_orderpriority").alias("snippet"), F.when(k % 2 == 0, "workaround_comment").otherwise("isr").alias("kind"))
    c = F.col("c_custkey")
    blame = table(spark, sf_dir, "customer").where("c_custkey % 4 > 0").select((c % 30).alias("path"), c.alias("start"), c.alias("end"), c.cast("string").alias("sha"))
    commits = table(spark, sf_dir, "customer").select(c.cast("string").alias("sha"), (c % 5 == 0).alias("rationale"), (c % 7 == 0).alias("revert"))
    edges = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", "unresolved").otherwise("resolved").alias("resolution"))
    return pack.unknowns(signals.withColumn("path", F.col("path").cast("string")), blame.withColumn("path", F.col("path").cast("string")), commits, edges)


QUESTIONS = """WITH s AS (SELECT o_orderkey AS nth, o_custkey AS c, o_orderpriority AS t FROM orders WHERE o_orderkey % 2 = 0 ORDER BY 1 LIMIT 40),
u AS (SELECT * FROM s WHERE c % 4 = 0 OR (c % 5 > 0 AND c % 7 > 0) ORDER BY nth LIMIT 12), n AS (SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R')
SELECT nth AS place, (c % 30)::VARCHAR AS path, c::INTEGER AS line, CASE WHEN c % 4 > 0 THEN c::VARCHAR END AS sha, 'The comment says "' || t || '", but ' || CASE WHEN c % 4 = 0 THEN 'no commit explains it' ELSE 'its commit doesn’t say why' END || '.' AS text FROM u
UNION ALL SELECT NULL, NULL, NULL, NULL, n || ' call(s) or include(s) could not be followed (function pointers, callbacks, generated headers): what they reach is unknown.' FROM n WHERE n > 0"""


def _pack(spark, sf_dir):
    """Brands as components of files by size, whose parts are functions."""
    part = table(spark, sf_dir, "part")
    path = F.concat("p_brand", F.lit("/f"), (F.col("p_size") % 4).cast("string"))
    symbols = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("A::f"), F.col("p_partkey").cast("string")).alias("name"), F.lit("function").alias("kind"), path.alias("path"), F.col("p_brand").alias("component"), F.round("p_retailprice", 1).alias("criticality"))
    files = symbols.groupBy("path").agg(F.max("criticality").alias("criticality"))
    component_files = symbols.select("component", "path").distinct()
    components = symbols.groupBy("component").agg(F.sum((F.col("criticality") * 10).cast("long")).alias("criticality")).withColumn("name", F.concat("component", F.lit(" +2")))
    return symbols, files, component_files, components


def reading_order(spark, sf_dir):
    """Where to start: the file whose parts most lines name, then the dearest files of the dearest brands."""
    symbols, files, component_files, components = _pack(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").join(symbols.select(F.col("id").alias("l_partkey"), F.col("path").alias("dst_path")), "l_partkey")
    edges = lines.select(F.when(F.col("l_linenumber") == 1, "includes").otherwise("calls").alias("kind"), F.when(F.col("l_returnflag") == "R", "ambiguous").otherwise("resolved").alias("resolution"), "dst_path")
    return pack.reading_order(components, component_files, files, symbols, edges).withColumn("functions", F.array_join("functions", ","))


_PACK = """WITH s AS (SELECT p_partkey AS id, 'f' || p_partkey AS f, p_brand AS c, p_brand || '/f' || p_size % 4 AS path, round(p_retailprice, 1) AS crit FROM part),
fl AS (SELECT path, any_value(c) AS c, max(crit) AS crit FROM s GROUP BY 1), co AS (SELECT c, sum((crit * 10)::BIGINT) AS crit FROM s GROUP BY 1)"""
READING = (
    _PACK
    + """, h AS (SELECT path, count(*) AS n FROM lineitem JOIN s ON id = l_partkey WHERE l_linenumber = 1 AND l_returnflag <> 'R' GROUP BY 1 ORDER BY n DESC, path LIMIT 1),
b AS (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY c ORDER BY crit DESC, path) = 1),
a AS (SELECT 0 AS at_, path, 'The interface everything else uses: included ' || n || ' times.' AS why FROM h UNION ALL SELECT row_number() OVER (ORDER BY co.crit DESC, c), path, 'The most critical file of ' || c || '.' FROM co JOIN b USING (c)),
o AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY path ORDER BY at_) = 1 ORDER BY at_ LIMIT 5),
t AS (SELECT path, string_agg(f, ',' ORDER BY crit DESC, id) AS functions FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY crit DESC, id) <= 2) GROUP BY 1)
SELECT row_number() OVER (ORDER BY at_) AS place, path, why, coalesce(functions, '') AS functions FROM o LEFT JOIN t USING (path)"""
)


def module_uses(spark, sf_dir):
    """Suppliers as files of modules by nation that use the headers of parts: how much each module has to do with them."""
    supplier = table(spark, sf_dir, "supplier")
    lines = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    nth = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    path = F.concat(F.lit("src/n"), F.col("s_nationkey").cast("string"), F.lit("/s"), F.col("s_suppkey").cast("string"), F.lit(".cpp"))
    uses = lines.select(pack.module_of(path, 2).alias("module"), path.alias("file"), path.alias("path"), F.col("l_linenumber").alias("line"), F.concat(F.lit("h"), F.col("l_partkey").cast("string")).alias("header"), nth.alias("nth"))
    return pack.module_links(uses).withColumn("uses", F.array_join("uses", ","))


MODULES = """WITH l AS (SELECT 'n' || s_nationkey AS m, 'src/n' || s_nationkey || '/s' || s_suppkey || '.cpp' AS path, l_linenumber AS line, 'h' || l_partkey AS h, row_number() OVER (PARTITION BY s_nationkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) SELECT 'src/' || m AS module, m AS name, count(DISTINCT path) AS files, count(*) AS "count", string_agg(path || ':' || line || ' ' || h, ',' ORDER BY r) FILTER (r <= 3) AS uses FROM l GROUP BY m"""


def pack_document(spark, sf_dir):
    """The lines of the pack of the brands, in their order."""
    symbols, _, component_files, components = _pack(spark, sf_dir)
    info = pack.component_info(components, component_files, symbols)
    place = F.row_number().over(Window.orderBy(F.desc("criticality"), "component"))
    info = info.withColumn("place", place).withColumn("level", F.when(F.col("place") < 3, "high").when(F.col("place") < 9, "medium").otherwise("low"))
    snapshot = table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit("o/r").alias("repo"), F.lit("abc").alias("commit"))
    key = F.col("p_partkey")
    cards = table(spark, sf_dir, "part").where("p_size = 1").select(key.alias("place"), F.lit("STOP").alias("verdict"), F.col("p_name").alias("title"), F.concat(F.lit("f"), key.cast("string")).alias("function"), F.concat("p_brand", F.lit("/x.c")).alias("path"), key.alias("start"), (key + 2).alias("end"))
    links = module_uses(spark, sf_dir)
    return pack.markdown(F.lit("drv"), snapshot, cards, info, reading_order(spark, sf_dir), open_questions(spark, sf_dir), links, links.limit(0))


DOCUMENT = f"""WITH qu AS ({QUESTIONS}), rd AS ({READING}), mo AS ({MODULES}), {_PACK.removeprefix("WITH ")},
cf AS (SELECT c, count(DISTINCT path) AS files FROM s GROUP BY 1), tp AS (SELECT c, string_agg('`' || f || '`', ', ' ORDER BY crit DESC, id) AS l FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY c ORDER BY crit DESC, id) <= 3) GROUP BY 1),
pl AS (SELECT *, row_number() OVER (ORDER BY co.crit DESC, c) AS n FROM co JOIN cf USING (c) JOIN tp USING (c)), cd AS (SELECT * FROM part WHERE p_size = 1)
SELECT * FROM (VALUES (0, 0, '# o/r / drv — onboarding pack'), (0, 1, 'Snapshot `abc`. Every statement is labelled Verified / Inferred / Unknown and cites code or commits at this commit.'), (0, 2, ''), (1, 0, '## System at a glance'),
(1, 2, ''), (1, 3, '**Depends on:** nothing outside the scope.'), (1, 4, ''), (2, 0, '## What not to break'), (3, 0, '## Components'), (4, 0, ''), (5, 0, '## Open questions / unknowns'), (6, 0, ''), (7, 0, '## Where to start reading')) v(section, nth, line)
UNION ALL SELECT 1, 1, '**Used by:** ' || string_agg(name || ' (' || files || ')', ', ' ORDER BY files DESC, "count" DESC, name) || '.' FROM mo
UNION ALL SELECT 2, p_partkey * 3 + k, CASE k WHEN 1 THEN '### STOP if changed: ' || p_name WHEN 2 THEN '`f' || p_partkey || '`, [x.c:' || p_partkey || '–' || (p_partkey + 2) || '](https://github.com/o/r/blob/abc/' || p_brand || '/x.c#L' || p_partkey || '-L' || (p_partkey + 2) || ')' ELSE '' END FROM cd, (VALUES (1), (2), (3)) w(k)
UNION ALL SELECT 3, n + 1, '- ' || CASE WHEN n < 3 THEN '🔴' WHEN n < 9 THEN '🟠' ELSE '⚪' END || ' **' || c || ' +2** (' || files || ' files) — ' || l FROM pl
UNION ALL SELECT 5, coalesce(place, 1099511627776) + 1, '- **UNKNOWN** ' || text FROM qu UNION ALL SELECT 7, place, place || '. `' || path || '` — ' || why FROM rd"""


CATALOGUE = {
    "control_scan_once": (control_scan_once, SCAN_ONCE),
    "control_interrupted": (control_interrupted, INTERRUPTED),
    "control_tokens": (control_tokens, TOKENS),
    "control_insert": (control_insert, INSERT),
    "control_upsert": (control_upsert, UPSERT),
    "control_delete": (control_delete, DELETE),
    "citation_links": (citation_links, LINKS),
    "hunk_functions": (hunk_functions, HUNK_FUNCTIONS),
    "hunk_signals": (hunk_signals, HUNK_SIGNALS),
    "untested_functions": (untested_functions, UNTESTED),
    "raised_verdicts": (raised_verdicts, RAISED),
    "latest_reviews": (latest_reviews, LATEST_REVIEWS),
    "blame_parse": (blame_parse, BLAME),
    "raw_diff_parse": (raw_diff_parse, RAW_DIFF),
    "loose_objects": (loose_objects, LOOSE),
    "object_round_trip": (object_round_trip, OBJECTS),
    "stored_snapshots": (stored_snapshots, SNAPSHOTS),
    "open_questions": (open_questions, QUESTIONS),
    "reading_order": (reading_order, READING),
    "module_uses": (module_uses, MODULES),
    "pack_document": (pack_document, DOCUMENT),
}
