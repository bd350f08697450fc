"""Text queries over documents, pages, conversations and the benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import ranking, signals
from lodestone.plans.common import table


def inventory_language_histogram(spark, sf_dir):
    """Documents and their share by language."""
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("files"))
    total = counts.agg(F.sum("files").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("lang", "files", (F.col("files") / F.col("total")).alias("share"))  # one row


HISTOGRAM = "SELECT lang, count(*) AS files, count(*) / (SELECT count(*) FROM documents)::DOUBLE AS share FROM documents GROUP BY 1"

_URL_PATH = r"^[^:]*://[^/?#]*/?([^?#]*)"
_PATH_SQL = "regexp_extract(url, '^[^:]*://[^/?#]*/?([^?#]*)', 1)"


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", _URL_PATH, 1).alias("path"))


def scope_filter_deep_reference(spark, sf_dir):
    """Whether each page lies in the scope ``en``."""
    return _paths(spark, sf_dir).select("page_id", T.in_scope(F.col("path"), "en").alias("deep"))


SCOPE = f"SELECT page_id, path = 'en' OR starts_with(path, 'en/') AS deep FROM (SELECT page_id, {_PATH_SQL} AS path FROM pages)"


def language_of_path(spark, sf_dir):
    """Language of each page's path by name and extension."""
    return _paths(spark, sf_dir).select("page_id", T.language(F.regexp_replace("path", r"\.html$", ".md")).alias("language"))


LANGUAGE = f"""WITH p AS (SELECT page_id, regexp_extract(regexp_replace({_PATH_SQL}, '\\.html$', '.md'), '([^/]*)$', 1) AS name FROM pages)
SELECT page_id, CASE regexp_extract(name, '^.+\\.([^.]+)$', 1) WHEN 'md' THEN 'markdown' WHEN 'txt' THEN 'text' WHEN 'c' THEN 'c' ELSE 'other' END AS language FROM p"""


def path_parts(spark, sf_dir):
    """Base name, directory and stem of each page's path."""
    return _paths(spark, sf_dir).select("page_id", T.basename(F.col("path")).alias("base"), T.dirname(F.col("path")).alias("dir"), T.stem(F.col("path")).alias("stem"))


PARTS = f"""WITH p AS (SELECT page_id, {_PATH_SQL} AS path FROM pages)
SELECT page_id, regexp_extract(path, '([^/]*)$', 1) AS base, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir,
regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', '') AS stem FROM p"""


def normalize_path(spark, sf_dir):
    """Folds dot segments put before each page's path."""
    return _paths(spark, sf_dir).select("page_id", T.normalize_path(F.concat(F.lit("a/./b/../"), "path")).alias("path"))


NORMALIZE = f"""SELECT page_id, array_to_string(list_filter(string_split('a/' || {_PATH_SQL}, '/'), lambda s: s <> '' AND s <> '.'), '/') AS path FROM pages"""


def line_explode_numbered(spark, sf_dir):
    """The first 40 lines of each document, numbered from 1."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.slice(F.split("text", "\n", -1), 1, 40)).alias("at", "line"))
    return lines.select("doc_id", (F.col("at") + 1).alias("line_no"), F.length("line").alias("n_chars"))


LINES = """SELECT doc_id, k AS line_no, length(l[k]) AS n_chars FROM (SELECT doc_id, l, unnest(range(1, least(len(l), 40) + 1)) AS k
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""

# The rules of the signal queries (kind, weight, pattern); of the rules of a kind the first that fits a line counts.
SIGNAL_RULES = (
    ("license", 2, r"(?i)licen[cs]ed? under"), ("license", 1, r"(?i)licen[cs]e"), ("contact", 1, r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"), ("phone", 1, r"[0-9]{3}[- ][0-9]{3,4}"),
    ("number", 2, r"[0-9]{6,}"), ("number", 1, r"[0-9]{4,}"), ("quote", 1, r"\"[^\"]+\""),
)


def signal_lines(spark, sf_dir):
    """One row per line and kind of signal that one of its patterns finds, with the weight of the first one."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    hits = lines.select("doc_id", (F.col("at") + 1).alias("line_no"), signals.rule_hits(F.col("line"), SIGNAL_RULES).alias("hits"))
    return hits.select("doc_id", "line_no", F.explode(signals.first_of_kind(F.col("hits"))).alias("s")).select("doc_id", "line_no", "s.kind", "s.weight")


_SIGNALS = """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, l FROM d),
x AS (SELECT doc_id, line_no, l[line_no] AS line FROM n), r AS (""" + " UNION ALL ".join(f"SELECT doc_id, line_no, '{k}' AS kind, {w} AS weight, {i} AS nth FROM x WHERE regexp_matches(line, '{p}')" for i, (k, w, p) in enumerate(SIGNAL_RULES)) + """),
s AS (SELECT doc_id, line_no, kind, arg_min(weight, nth) AS weight FROM r GROUP BY ALL)"""
SIGNALS = _SIGNALS + " SELECT doc_id, line_no, kind, weight FROM s"


def signal_histogram(spark, sf_dir):
    """Signals by kind."""
    return signal_lines(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.sum("weight").alias("points"))


SIGNAL_HISTOGRAM = _SIGNALS + " SELECT kind, count(*) AS n, sum(weight)::BIGINT AS points FROM s GROUP BY 1"


def message_classify(spark, sf_dir):
    """Conversation turns as commit messages: subject, flags and number of references."""
    flags = T.message_flags(F.col("text"))
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(
        "conv_id", "turn", T.subject(F.col("text")).alias("subject"), flags["bugfix"].alias("bugfix"), flags["rationale"].alias("rationale"), flags["revert"].alias("revert"), F.size(flags["refs"]).alias("refs")
    )


CLASSIFY = f"""WITH m AS (SELECT conv_id, turn, text, regexp_replace(regexp_replace(string_split(text, chr(10))[1], '^\\s+', ''), '\\s+$', '') AS subject FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, subject, regexp_matches(text, '(?i){T.BUGFIX}') AS bugfix, regexp_matches(text, '(?i){T.RATIONALE}') AS rationale,
regexp_extract(text, '(?i)This reverts commit ([0-9a-f]{{7,40}})', 1) <> '' OR regexp_matches(subject, '(?i){T.REVERT}') AS revert,
len(list_distinct(regexp_extract_all(text, '(?:^|[\\s(,])#(\\d{{1,6}})\\b', 1))) AS refs FROM m"""


def token_frequency(spark, sf_dir):
    """Per document the 20 most frequent tokens of three or more letters, digits or underscores."""
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9_]{3,}"), 0)).alias("token"))
    return ranking.top_per_key(tokens.groupBy("doc_id", "token").agg(F.count("*").alias("n")), ["doc_id"], [F.desc("n"), F.asc("token")], 20)


TOKENS = """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{3,}')) AS token FROM documents), c AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL)
SELECT doc_id, token, n FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) <= 20"""


def near_copy_norm_key(spark, sf_dir):
    """Documents whose normalised text occurs more than once: the least id and the count by key."""
    key = F.sha2(T.norm_key(F.col("text")), 256)
    return table(spark, sf_dir, "documents").groupBy(key.alias("key")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1")


NORM_KEY = "SELECT sha256(trim(regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g'))) AS key, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1"


MOST_PROBES = 10_000  # hashes that are sent to all texts


def quote_in_evidence(spark, sf_dir):
    """Benchmark items quoted in documents, whatever the white space and case; and in how many.

    The words of a quote but its first and last stand between spaces, so they
    are whole words of any text that holds it. Quotes of five or more words meet
    documents by a hash of the second to fourth, those of three or four by the
    second; the whole quote is then checked. The few of one or two words are one
    row that each document is searched for.
    """
    triple = lambda words, i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    own = F.split("quote", " ")
    items = table(spark, sf_dir, "benchmark").select("item_id", T.squash(F.col("text")).alias("quote")).where("quote <> ''")
    probe = F.when(F.size(own) >= 5, triple(own, F.lit(1))).when(F.size(own) >= 3, F.xxhash64(F.get(own, 1)))
    items = items.withColumn("probe", probe)
    docs = table(spark, sf_dir, "documents").select("doc_id", T.squash(F.col("text")).alias("body"))
    words = docs.withColumn("words", F.split("body", " "))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0))), lambda i: triple(F.col("words"), i))
    hashes = words.select("doc_id", F.concat(runs, F.transform("words", lambda w: F.xxhash64(w))).alias("hashes"))
    asked = items.where("probe IS NOT NULL").select("probe").distinct()
    if asked.count() <= MOST_PROBES:  # few enough to go along with every text, which then yields what is asked for only
        hashes = hashes.join(F.broadcast(asked.agg(F.collect_set("probe").alias("asked")))).select("doc_id", F.array_intersect("hashes", "asked").alias("hashes"))
    starts = hashes.select("doc_id", F.explode(F.array_distinct("hashes")).alias("probe"))
    # Only hashes move; the texts join what is left of them.
    met = starts.join(items.where("probe IS NOT NULL").select("item_id", "quote", "probe"), "probe").drop("probe").join(docs, "doc_id").where(F.expr("contains(body, quote)"))
    short = items.where("probe IS NULL").agg(F.collect_list(F.struct("item_id", "quote")).alias("short"))
    inside = docs.join(F.broadcast(short)).select("doc_id", F.explode(F.filter("short", lambda q: F.contains(F.col("body"), q["quote"]))).alias("q")).select("doc_id", "q.item_id")  # one row
    return met.select("doc_id", "item_id").unionByName(inside).groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"))


QUOTE = """WITH i AS (SELECT item_id, trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))) AS q FROM benchmark), d AS (SELECT doc_id, trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))) AS b FROM documents)
SELECT item_id, count(DISTINCT doc_id) AS documents FROM i JOIN d ON contains(b, q) WHERE q <> '' GROUP BY 1"""


def keyword_search(spark, sf_dir):
    """The 12 documents that match a query best: 1 + 0.2 (occurrences - 1) per word."""
    score = T.occurrence_score(F.lower("text"), ["license", "the", "version"])
    return table(spark, sf_dir, "documents").select("doc_id", F.round(score, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(12)


_OCC = " + ".join(f"(CASE WHEN contains(t, '{w}') THEN 1 + ((length(t) - length(replace(t, '{w}', ''))) / {len(w)} - 1) * 0.2::DOUBLE ELSE 0 END)" for w in ("license", "the", "version"))
SEARCH = f"SELECT doc_id, round({_OCC}, 6) AS score FROM (SELECT doc_id, lower(text) AS t FROM documents) WHERE {_OCC} > 0 ORDER BY score DESC, doc_id LIMIT 12"


def include_edges(spark, sf_dir):
    """Links of pages: target and how often."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("target")).groupBy("page_id", "target").agg(F.count("*").alias("weight"))


INCLUDES = """SELECT page_id, target, count(*) AS weight FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) GROUP BY ALL"""


def last_n_turns(spark, sf_dir):
    """The last eight turns of user and assistant of each conversation, clipped to 4000 characters."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return ranking.top_per_key(turns, ["conv_id"], [F.desc("turn"), F.desc("text")], 8).select("conv_id", "turn", "role", F.substring("text", 1, 4000).alias("text"))


TURNS = """SELECT conv_id, turn, role, substr(text, 1, 4000) AS text FROM conversations WHERE role IN ('user', 'assistant')
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) <= 8"""


def json_props(spark, sf_dir):
    """A number out of the events' JSON."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


JSON = "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events"


def distinct_snapshot_id(spark, sf_dir):
    """Identities: the first 32 digits of a hash of joined keys."""
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.concat_ws("|", "doc_id", "lang", "source"), 256), 1, 32).alias("snapshot_id"))


SNAPSHOT = "SELECT doc_id, substr(sha256(concat_ws('|', doc_id, lang, source)), 1, 32) AS snapshot_id FROM documents"

CATALOGUE = {
    "inventory_language_histogram": (inventory_language_histogram, HISTOGRAM),
    "scope_filter_deep_reference": (scope_filter_deep_reference, SCOPE),
    "language_of_path": (language_of_path, LANGUAGE),
    "path_parts": (path_parts, PARTS),
    "normalize_path": (normalize_path, NORMALIZE),
    "line_explode_numbered": (line_explode_numbered, LINES),
    "signal_lines": (signal_lines, SIGNALS),
    "signal_histogram": (signal_histogram, SIGNAL_HISTOGRAM),
    "message_classify": (message_classify, CLASSIFY),
    "token_frequency": (token_frequency, TOKENS),
    "near_copy_norm_key": (near_copy_norm_key, NORM_KEY),
    "quote_in_evidence": (quote_in_evidence, QUOTE),
    "keyword_search": (keyword_search, SEARCH),
    "include_edges": (include_edges, INCLUDES),
    "last_n_turns": (last_n_turns, TURNS),
    "json_props": (json_props, JSON),
    "distinct_snapshot_id": (distinct_snapshot_id, SNAPSHOT),
}
