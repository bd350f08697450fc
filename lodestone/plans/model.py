"""Queries of the source model over the star schema and the texts, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import claims, components, graph, review
from lodestone.plans.common import spread, table
from lodestone.sources import c_structure, repository


def impact_bounded(spark, sf_dir):
    """What depends on the small parts of a brand within three steps of the parts that follow one another in orders: by depth and weakest resolution."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("src"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("at"), "l_returnflag")
    following = F.lead("src").over(Window.partitionBy("l_orderkey").orderBy("at"))
    edges = lines.select("src", following.alias("dst"), F.when(F.col("l_returnflag") == "N", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).alias("resolution")).where("dst IS NOT NULL")
    starts = table(spark, sf_dir, "part").where("p_brand = 'Brand#1' AND p_size = 1").select(F.col("p_partkey").alias("node"))
    found = graph.impact(edges.withColumn("kind", F.lit("calls")).withColumn("method", F.lit("name_match")), starts, 3)
    return found.groupBy("depth", "resolution").agg(F.count("*").alias("nodes"))


def _impact_step(k: int) -> str:
    seen = " UNION ALL ".join(f"SELECT node FROM n{i}" for i in range(k))
    return f"""n{k} AS (SELECT e.src AS node, min(greatest(e.r, p.r)) AS r FROM e JOIN n{k - 1} p ON e.dst = p.node WHERE e.src NOT IN ({seen}) GROUP BY 1)"""


IMPACT = f"""WITH l AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS dst,
CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS r FROM lineitem), e AS (SELECT src, dst, min(r) AS r FROM l WHERE dst IS NOT NULL GROUP BY 1, 2),
n0 AS (SELECT p_partkey AS node, 0 AS r FROM part WHERE p_brand = 'Brand#1' AND p_size = 1), {_impact_step(1)}, {_impact_step(2)}, {_impact_step(3)}
""" + " UNION ALL ".join(f"SELECT {k} AS depth, r AS resolution, count(*) AS nodes FROM n{k} GROUP BY 2" for k in (1, 2, 3))


def claim_validate(spark, sf_dir):
    """Claims of the benchmark's items about documents: the status that the cited documents allow, and why."""
    item = F.col("item_id")
    pick = lambda c, values: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    cite = F.array(item, item * 3 + 1, F.when(item % 7 == 0, 999_999_999).otherwise(item))
    given = table(spark, sf_dir, "benchmark").select(
        item.alias("claim_id"), F.lit(0).alias("packet"), "text", pick(item, ("verified", "verified", "inferred", "sure")).alias("status"), pick(item, ("code_fact", "commit_statement", "comment_statement", "inference", "odd")).alias("basis"),
        pick(item, ("low", "high", "none")).alias("confidence"), F.transform(F.array_distinct(cite), lambda x: x.cast("string")).alias("cite"), pick(item, (None, "e", "the ... and", "no such words here")).cast("string").alias("quote"),
    )
    doc = F.col("doc_id")
    evidence = table(spark, sf_dir, "documents").select(F.lit(0).alias("packet"), doc.cast("string").alias("id"), pick(doc, ("code", "commit")).alias("kind"), "text", pick(doc, ("inferred", "unknown", None)).cast("string").alias("status"))
    return claims.validate(given, evidence).select("claim_id", "claimed", "status", "basis", "confidence", F.size("citations").alias("citations"), "reason")


CLAIMS = r"""WITH i AS (SELECT item_id, ['verified', 'verified', 'inferred', 'unknown'][item_id % 4 + 1] AS claimed, ['code_fact', 'commit_statement', 'comment_statement', 'inference', 'inference'][item_id % 5 + 1] AS basis,
['low', 'high', NULL][item_id % 3 + 1] AS confidence, list_distinct([item_id, item_id * 3 + 1, CASE WHEN item_id % 7 = 0 THEN 999999999 ELSE item_id END]) AS ids, item_id % 4 AS q FROM benchmark WHERE trim(text) <> ''),
c AS (SELECT item_id, q, unnest([item_id, item_id * 3 + 1, 999999999]) AS id, unnest([1, 2, 3]) AS nth, ids FROM i),
d AS (SELECT doc_id, doc_id % 2 AS commit, trim(regexp_replace(text, '\s+', ' ', 'g')) AS b, [2, 1, NULL][doc_id % 3 + 1] AS r FROM documents),
m AS (SELECT c.*, d.doc_id, d.commit, d.r, CASE q WHEN 1 THEN contains(b, 'e') WHEN 2 THEN contains(b, 'the') AND contains(substr(b, strpos(b, 'the') + 3), 'and') ELSE false END AS quoted
      FROM c LEFT JOIN d ON d.doc_id = c.id WHERE list_contains(ids, id) AND NOT (nth = 2 AND id = item_id)),
g AS (SELECT item_id, string_agg(CASE WHEN doc_id IS NULL THEN 'cites ' || id || ', which was not in its evidence' END, '; ' ORDER BY nth) AS missing, count(doc_id) AS valid, bool_or(coalesce(quoted, false)) AS quoted,
      count(*) FILTER (commit = 1) AS commits, count(*) FILTER (commit = 0) AS codes, count(r) FILTER (doc_id IS NOT NULL) AS ranked, max(r) AS cap FROM m GROUP BY 1),
s0 AS (SELECT i.*, g.*, CASE claimed WHEN 'verified' THEN 3 WHEN 'inferred' THEN 2 ELSE 1 END AS r0, (q > 0 AND NOT quoted) AS unquoted FROM i JOIN g USING (item_id)),
s1 AS (SELECT *, CASE WHEN unquoted THEN 0 ELSE valid END AS n, CASE WHEN unquoted AND r0 = 3 THEN 2 ELSE r0 END AS r1 FROM s0),
s2 AS (SELECT *, CASE WHEN r1 < 3 THEN NULL WHEN basis = 'inference' THEN 'basis is inference' WHEN n = 0 THEN 'no valid citation' WHEN basis = 'commit_statement' AND commits = 0 THEN 'commit_statement without a commit citation'
      WHEN basis <> 'commit_statement' AND codes = 0 THEN basis || ' without a code citation' END AS why FROM s1),
s3 AS (SELECT *, CASE WHEN why IS NOT NULL THEN 2 ELSE r1 END AS r2 FROM s2),
s4 AS (SELECT *, CASE WHEN r2 = 2 AND n = 0 THEN 1 ELSE r2 END AS r3 FROM s3),
s5 AS (SELECT *, CASE WHEN n > 0 AND ranked = valid AND cap < r3 THEN cap ELSE r3 END AS r4 FROM s4)
SELECT item_id AS claim_id, claimed, ['unknown', 'inferred', 'verified'][r4] AS status, CASE r4 WHEN 2 THEN 'inference' ELSE basis END AS basis, CASE r4 WHEN 2 THEN coalesce(confidence, 'low') END AS confidence, n AS citations,
CASE WHEN r4 <> r0 THEN concat_ws('; ', missing, CASE WHEN r1 < r0 THEN 'quoted text is not in the cited evidence' END, why, CASE WHEN r3 < r2 THEN 'inferred without a valid citation' END,
CASE WHEN r4 < r3 THEN 'cannot be more certain than the claims it is built on' END) END AS reason FROM s5"""


def first_match_priority(spark, sf_dir):
    """The document that each page's address means: of its language and number, else of its number, else of its language and the number's last two digits."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://[^/]*/([a-z]+)/([0-9]+)", 1).alias("lang"), F.regexp_extract("url", r"://[^/]*/([a-z]+)/([0-9]+)", 2).alias("number"))
    pages = pages.withColumn("number", F.try_to_number("number", F.lit("9999999999")).cast("long")).withColumn("tail", F.col("number") % 100)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("doc_id") % 100).alias("tail"))
    tiers = (["lang", "number"], ["number"], ["lang", "tail"])
    found = pages
    for k, keys in enumerate(tiers):
        index = docs.withColumn("number", F.col("doc_id")).groupBy(*keys).agg(F.struct(F.count("*").alias("n"), F.min("doc_id").alias("first")).alias(f"t{k}"))
        found = found.join(index, keys, "left")
    best = F.coalesce("t0", "t1", "t2")
    resolution = F.when(best.isNull(), "unresolved").when(best["n"] == 1, "resolved").otherwise("ambiguous")
    return found.select("page_id", resolution.alias("resolution"), best["first"].alias("target"), F.coalesce(best["n"], F.lit(0)).alias("candidates"))


PRIORITY = """WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]*/([a-z]+)/([0-9]+)', 1) AS lang, TRY_CAST(regexp_extract(url, '://[^/]*/([a-z]+)/([0-9]+)', 2) AS BIGINT) AS number FROM pages),
m AS (SELECT page_id, 1 AS tier, doc_id FROM p JOIN documents d ON d.lang = p.lang AND doc_id = number UNION ALL SELECT page_id, 2, doc_id FROM p JOIN documents ON doc_id = number
UNION ALL SELECT page_id, 3, doc_id FROM p JOIN documents d ON d.lang = p.lang AND doc_id % 100 = number % 100),
g AS (SELECT page_id, tier, count(*) AS n, min(doc_id) AS f FROM m GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY tier) = 1)
SELECT page_id, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution, f AS target, coalesce(n, 0) AS candidates FROM p LEFT JOIN g USING (page_id)"""


def reference_index(spark, sf_dir):
    """Documents that name what few pages link to, with the first of these; short names tell nothing."""
    named = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="/([A-Za-z_]{5,})"'), 1))).alias("name"))
    own = named.groupBy("name").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n")).where("n <= 8").drop("n")
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]+"), 0))).alias("name")).where(F.length("name") >= 5)
    return words.join(own, "name").select("doc_id", "name", "page_id")


REFERENCES = """WITH a AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="/([A-Za-z_]{5,})"', 1)) AS name FROM pages), o AS (SELECT name, min(page_id) AS page_id FROM a GROUP BY 1 HAVING count(*) <= 8),
w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_]+')) AS name FROM documents) SELECT doc_id, name, page_id FROM w JOIN o USING (name)"""


def issue_refs_distinct(spark, sf_dir):
    """The different numbers of two to six digits that each document names after a white space, comma, dash or number sign."""
    refs = F.regexp_extract_all("text", F.lit(r"(?:^|[\s(,#-])([0-9]{2,6})(?![A-Za-z0-9_])"), 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(refs)).alias("ref")).select("doc_id", F.col("ref").cast("int").alias("ref")).distinct()


REFS = r"""SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '(?:^|[\s(,#-])([0-9]{2,6})\b', 1))::INTEGER AS ref FROM documents"""


def common_prefix_majority(spark, sf_dir):
    """The number of leading words of names that 60 % of a brand's parts share, and that all of a type's parts of a size share."""
    names = table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size", F.split("p_name", " ").alias("words"))
    most = components.prefix_lengths(names.withColumn("group", F.col("p_brand")), ["group"], F.col("words"), 0.6)
    every = components.prefix_lengths(names.withColumn("group", F.concat_ws(" ", "p_type", F.col("p_size").cast("string"))), ["group"], F.col("words"), 1.0)
    return most.unionByName(every)


COMMON_PREFIX = """WITH p AS (SELECT p_brand AS g, string_split(p_name, ' ') AS w, 0.6 AS share FROM part UNION ALL SELECT p_type || ' ' || p_size, string_split(p_name, ' '), 1.0 FROM part),
n AS (SELECT g, share, count(*) AS n FROM p GROUP BY 1, 2), x AS (SELECT g, share, w, unnest(range(1, len(w) + 1)) AS k FROM p), c AS (SELECT g, share, k, w[1:k] AS prefix, count(*) AS c FROM x GROUP BY ALL)
SELECT n.g AS "group", coalesce(max(c.k) FILTER (c.c >= n.n * n.share), 0) AS length FROM n LEFT JOIN c ON n.g = c.g AND n.share = c.share GROUP BY n.g, n.share"""


def sentence_split(spark, sf_dir):
    """Sentences of the benchmark's items, numbered."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.sentences(F.col("text"))).alias("nth", "sentence")).select("item_id", "nth", F.length("sentence").alias("chars"))


SENTENCES = r"""WITH b AS (SELECT item_id, list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS l FROM benchmark)
SELECT item_id, k - 1 AS nth, length(l[k]) AS chars FROM (SELECT item_id, l, unnest(range(1, len(l) + 1)) AS k FROM b)"""


def override_merge(spark, sf_dir):
    """Verdict of each order: that of its last line with a return, else by its priority."""
    reviews = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "DANGEROUS").otherwise("SAFE").alias("verdict"))
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").select(F.col("l_orderkey").alias("review_id"), F.when(F.col("l_returnflag") == "R", "STOP").otherwise("RISKY").alias("verdict"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("at"))
    return review.final_verdicts(reviews, lines)


OVERRIDES = """WITH l AS (SELECT l_orderkey AS k, CASE l_returnflag WHEN 'R' THEN 'STOP' ELSE 'RISKY' END AS v FROM lineitem WHERE l_returnflag <> 'N'
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_returnflag DESC) = 1)
SELECT o_orderkey AS review_id, coalesce(v, CASE o_orderpriority WHEN '1-URGENT' THEN 'DANGEROUS' ELSE 'SAFE' END) AS verdict, v IS NOT NULL AS overridden FROM orders LEFT JOIN l ON k = o_orderkey"""


def tree_listing(spark, sf_dir):
    """Parts written as a tree listing by brand and read back: path and id of the files among them."""
    part = table(spark, sf_dir, "part")
    mode = F.when(F.col("p_size") % 10 == 0, "120000 blob").when(F.col("p_size") % 10 == 1, "160000 commit").otherwise("100644 blob")
    entry = F.concat(mode, F.lit(" "), F.sha1(F.col("p_partkey").cast("string")), F.lit("\t"), F.concat_ws("/", "p_type", "p_name", F.col("p_partkey").cast("string")))
    listings = part.groupBy("p_brand", F.pmod(F.xxhash64("p_partkey"), F.lit(64))).agg(F.concat(F.array_join(F.collect_list(entry), "\0"), F.lit("\0")).alias("text"))
    return repository.tree_entries(listings)


TREE = "SELECT p_type || '/' || p_name || '/' || p_partkey AS path, sha1(p_partkey::VARCHAR) AS blob_sha FROM part WHERE p_size % 10 > 1"


def log_parse(spark, sf_dir):
    """Orders written as log records with their lines as changes and read back: commit, file, status and message."""
    lines = table(spark, sf_dir, "lineitem")
    change = F.concat(F.lit(":100644 100644 "), F.sha1(F.col("l_partkey").cast("string")), F.lit(" " + repository.NO_OBJECT + " "), F.when(F.col("l_returnflag") == "R", "D").otherwise("M"), F.lit("\t"), F.concat(F.lit("p/"), F.col("l_partkey").cast("string")))
    changes = lines.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(change)), "\n").alias("changes"))
    orders = table(spark, sf_dir, "orders").join(changes, F.col("o_orderkey") == F.col("l_orderkey"))
    fields = F.concat_ws(repository.FIELD, F.col("o_orderkey").cast("string"), F.lit("A B"), F.lit("a@b"), F.lit("86400"), F.concat(F.lit(" \n"), "o_orderpriority", F.lit("\n")))
    logs = orders.select(F.concat(F.lit(repository.RECORD), fields, F.lit(repository.GROUP + "\n"), "changes", F.lit("\n")).alias("text"))
    entries = repository.log_entries(logs).select("sha", "message", F.explode("changes").alias("c"))
    return entries.groupBy("sha", "message", F.col("c.path").alias("file"), F.col("c.status").alias("status"), F.col("c.new_blob").isNull().alias("gone")).agg(F.count("*").alias("n"))


LOG = """SELECT l_orderkey::VARCHAR AS sha, o_orderpriority AS message, 'p/' || l_partkey AS file, CASE l_returnflag WHEN 'R' THEN 'D' ELSE 'M' END AS status, true AS gone, count(*) AS n
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL"""


def diff_parse(spark, sf_dir):
    """Parts written as unified diffs and read back: paths, starts and counts of each hunk."""
    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    count = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit(","), size))
    new = F.when(F.col("p_size") % 5 == 0, "/dev/null").otherwise(F.concat(F.lit("b/"), "p_type"))
    text = F.concat(F.lit("diff --git a/x b/x\n--- a/"), "p_type", F.lit("\n+++ "), new, F.lit("\n@@ -"), size, count, F.lit(" +7,0 @@ f()\n-one\n@@ -90 +91,2 @@\n+@@ no head\n"))
    return repository.diff_hunks(part.select(F.col("p_partkey").alias("id"), text.alias("text")))


DIFF = """SELECT p_partkey AS id, 1 AS file_no, p_type AS old_path, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END AS new_path, k AS hunk_no, CASE k WHEN 0 THEN p_size ELSE 90 END AS old_start,
CASE WHEN k = 1 OR p_size % 3 = 0 THEN 1 ELSE p_size END AS old_count, CASE k WHEN 0 THEN 7 ELSE 91 END AS new_start, CASE k WHEN 0 THEN 0 ELSE 2 END AS new_count FROM part, (VALUES (0), (1)) v(k)"""


def c_structure_scan(spark, sf_dir):
    """Parts written as C++ sources: the functions, classes and macros found, with their lines."""
    key = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("// part { \n#define SIZE_"), key, F.lit(" 1\n#if A\nclass P"), key, F.lit(" {\n  int get() { return "), F.lit("call(\"}\"); }\n};\n#else\nclass Q {\n#endif\n/* "), "p_name", F.lit("\n*/ void P"), key,
        F.lit("::run(int n)\n{\n"), F.repeat(F.lit("  step(n);\n"), F.col("p_size").cast("int")), F.lit("}\n"),
    )
    parsed = c_structure.structure(spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey").select(F.concat(F.lit("p/"), key, F.lit(".cpp")).alias("path"), text.alias("text")), ("path", "symbols", "calls"))
    return parsed.select("path", F.size("calls").alias("calls"), F.explode("symbols").alias("s")).select("path", "calls", "s.name", "s.kind", "s.start", "s.end")


STRUCTURE = """SELECT 'p/' || p_partkey || '.cpp' AS path, p_size + 1 AS calls, CASE k WHEN 0 THEN 'SIZE_' || p_partkey WHEN 1 THEN 'P' || p_partkey WHEN 2 THEN 'P' || p_partkey || '::get' ELSE 'P' || p_partkey || '::run' END AS name,
CASE k WHEN 0 THEN 'macro' WHEN 1 THEN 'class' ELSE 'function' END AS kind, CASE k WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 11 END AS start,
CASE k WHEN 0 THEN 2 WHEN 1 THEN 6 WHEN 2 THEN 5 ELSE 13 + p_size END AS "end" FROM part, (VALUES (0), (1), (2), (3)) v(k)"""


def louvain_components(spark, sf_dir):
    """Communities of each brand's parts by the orders that hold them: how many and how large."""
    path = lambda key: F.concat_ws("/", F.lit("b"), "p_brand", F.col(key).cast("string"))
    part = table(spark, sf_dir, "part").select(path("p_partkey").alias("path"))
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("l_partkey"), "p_brand").agg(F.count("*").alias("times"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(brands.hint("merge"), "l_partkey")
    lines = spread(lines.withColumn("h", F.xxhash64("l_orderkey", "p_brand")), "h")
    # Few orders hold two parts of a brand: the others go before lists are made.
    several = lines.groupBy("h").agg(F.min("l_partkey").alias("lo"), F.max("l_partkey").alias("hi")).where("lo < hi").select("h")
    sets = lines.join(several.hint("shuffle_hash"), "h", "left_semi").groupBy("h", "l_orderkey", "p_brand").agg(F.collect_set(F.struct("l_partkey", "times")).alias("parts"))
    sets = sets.select("p_brand", F.array_sort("parts").alias("parts")).where("size(parts) > 1")
    # An order holds a few lines, so its pairs are few.
    pairs = sets.select("p_brand", F.posexplode("parts").alias("at", "x"), "parts").select("p_brand", "x", F.explode(F.expr("slice(parts, at + 2, size(parts))")).alias("y"))
    pairs = pairs.groupBy("p_brand", F.col("x.l_partkey").alias("x"), F.col("y.l_partkey").alias("y")).agg(F.sum(F.expr("x.times * y.times")).alias("weight")).select(path("x").alias("a"), path("y").alias("b"), "weight")
    found = components.communities(part, pairs)
    return found.groupBy("directory", "community").agg(F.count("*").alias("files")).groupBy("directory").agg(F.count("*").alias("communities"), F.max("files").alias("largest"))


CATALOGUE = {
    "impact_bounded": (impact_bounded, IMPACT),
    "claim_validate": (claim_validate, CLAIMS),
    "first_match_priority": (first_match_priority, PRIORITY),
    "reference_index": (reference_index, REFERENCES),
    "issue_refs_distinct": (issue_refs_distinct, REFS),
    "common_prefix_majority": (common_prefix_majority, COMMON_PREFIX),
    "sentence_split": (sentence_split, SENTENCES),
    "override_merge": (override_merge, OVERRIDES),
    "tree_listing": (tree_listing, TREE),
    "log_parse": (log_parse, LOG),
    "diff_parse": (diff_parse, DIFF),
    "c_structure_scan": (c_structure_scan, STRUCTURE),
    "louvain_components": (louvain_components, None),
}
