"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, importance, line_crf, mixing, ngram_join, packing, rules, sort_means, token_counts, toxicity, url_filters, vector_dedup, warc
from lodestone.llm.common import table

# The rules of the URL query (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = rules.apply(docs.select("doc_id", "text"), rules.learn_from(docs, labels))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op6_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"), n=5, threshold=(4, 5))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rule_table(spark, URL_RULES))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=(5, 100), least_words=20, buckets=10_000, seed=42)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed=3)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), share=(3, 2), most=2).select("doc_id", "size", "source_size", "target", "taken")


# The 160 bits of a SHA-1, five at a time: bits 5i to 5i+4 lie within two hexadecimal digits.
OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS d FROM p),
k AS (SELECT d, max(page_id) AS kept FROM s GROUP BY d),
b AS (SELECT d, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((
        (strpos('0123456789abcdef', substr(d, 1 + 5 * i // 4, 1)) - 1) * 16
        + greatest(strpos('0123456789abcdef', substr(d || '0', 2 + 5 * i // 4, 1)) - 1, 0)) >> (3 - 5 * i % 4)) & 31), 1), '' ORDER BY i) AS payload_digest
      FROM (SELECT DISTINCT d FROM s), (SELECT unnest(range(32))::BIGINT AS i) GROUP BY d)
SELECT s.page_id, s.payload_bytes, b.payload_digest,
       CASE WHEN k.kept IS NULL OR s.page_id IS NULL OR s.page_id = k.kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN s.page_id <> k.kept THEN k.kept END AS refers_to
FROM s JOIN k USING (d) JOIN b USING (d)
"""

OP9_SQL = """
WITH r(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                 ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT row_number() OVER () AS n, page_id,
             CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT n, page_id,
             translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path,
       arg_max(r.h || r.p, length(r.h || r.p)) AS rule, coalesce(arg_max(r.verdict, length(r.h || r.p)), 'allow') AS verdict
FROM s LEFT JOIN r ON (s.host = r.h OR s.host LIKE '%.' || r.h) AND s.path LIKE r.p || '%'
GROUP BY n, page_id, host, path
"""

# All pairs of documents that share a 5-gram are compared; the classes are closed step by step.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 5 * c.k >= 4 * (x.n + y.n - c.k)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT d.doc_id, coalesce(n.n, 0) AS n_grams, coalesce(k.k, 0) AS n_links, m.c AS class_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS k FROM l GROUP BY a) k USING (doc_id)
JOIN (SELECT doc_id, min(reached) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

OP10_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
f AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND list_inner_product(v, v) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r(vec_id, reached) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reached)
SELECT e.vec_id, coalesce(k.k, 0) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept
FROM e LEFT JOIN (SELECT a AS vec_id, count(*) AS k FROM l GROUP BY a) k USING (vec_id)
JOIN (SELECT vec_id, min(reached) AS c FROM r GROUP BY vec_id) m USING (vec_id)
"""

# CRC-32 byte by byte, with its table from the polynomial. Grams are counted once each, however often they occur.
OP11_SQL = r"""
WITH tab AS (SELECT list(list_reduce(list_prepend(v, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY v) AS t
             FROM (SELECT unnest(range(256)) AS v)),
raw AS (SELECT 0 AS side, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM raw),
g AS (SELECT side, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
        list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram FROM w),
n AS (SELECT side, row, gram, count(*) AS n FROM g GROUP BY ALL),
h AS (SELECT gram, hex(gram) AS x FROM (SELECT DISTINCT gram FROM n)),
b AS (SELECT gram, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2),
        lambda i: strpos('123456789ABCDEF', x[2 * i + 1]) * 16 + strpos('123456789ABCDEF', x[2 * i + 2]))),
        lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8))) % 10000 AS bucket FROM h, tab),
m AS (SELECT side, row, bucket, sum(n)::BIGINT AS n FROM n JOIN b USING (gram) GROUP BY ALL),
c AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::DOUBLE AS t FROM m GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM c),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM c, a),
d AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM m JOIN gain USING (bucket) WHERE side = 0 GROUP BY row),
x AS (SELECT row, doc_id, len(w) AS n_words, '0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS h FROM w WHERE side = 0),
r AS (SELECT x.row, x.doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((h::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x LEFT JOIN d USING (row)),
o AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS pos, count(*) OVER () AS all_long FROM r WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN pos <= 5 * all_long // 100 THEN pos END AS rank FROM r LEFT JOIN o USING (row)
"""


def _op12_sql(rounds: int = 10) -> str:
    """Assigning and moving, once a round. Sums are of whole numbers, so their quotients are rounded down exactly."""
    apart = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT v.row, arg_min(c.k, struct_pack(d := {apart}, k := c.k)) AS k, min({apart}) AS d FROM v, c{r} c GROUP BY v.row)")
        if r < rounds:
            steps.append(
                f"s{r} AS (SELECT k, i, sum(x) AS s, count(*)::HUGEINT AS n FROM (SELECT k, unnest(range(1, 65)) AS i, unnest(x) AS x FROM a{r} JOIN v USING (row)) GROUP BY k, i), "
                f"m{r} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY k), "
                f"c{r + 1} AS (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (k))"
            )
    return (
        "WITH e AS (SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS e FROM embeddings), "
        "v AS MATERIALIZED (SELECT row, vec_id, list_transform(e, lambda y: floor(1024 * y)::BIGINT) AS x FROM e "
        "WHERE len(e) = 64 AND len(list_filter(e, lambda y: y IS NULL OR NOT isfinite(y))) = 0), "
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS k, x FROM v ORDER BY sha256('3:' || vec_id), x LIMIT 8), "
        + ", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)
        + f" SELECT v.vec_id, a.k::INTEGER AS cluster, a.d::BIGINT AS distance, sum(a.d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, "
        f"sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (row) JOIN c{rounds} c ON c.k = a.k"
    )


OP12_SQL = _op12_sql()
