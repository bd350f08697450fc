"""Importance resampling, clustering and mixing against brute force and edge cases."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import catalogue, common, importance, mixing, sort_means

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_importance", "op12_sort_means"])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    found, want = catalogue.QUERIES[name](spark, SF), duck.sql(catalogue.ORACLES[name])
    at = [want.columns.index(c) for c in found.columns]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, found.collect())) == sorted(key(r[i] for i in at) for r in want.fetchall())


# --- importance resampling


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(text):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(gram):
    return zlib.crc32(gram.encode()) % 10_000


TEXTS = [None, "", "?!", "One", "one TWO", "a b a b a b a b a b", "Straße ÀÉ naïve 中文 x1\x7fy2", "w " * 30, "the cat sat " * 12, "the cat sat " * 12]


def test_crc_of_joined_texts():
    dice = random.Random(1)
    parts = [(dice.randbytes(dice.randrange(9)), dice.randbytes(n)) for n in (0, 1, 2, 7, 63, 64, 1000, 70_001)]
    crc = lambda k: np.array([zlib.crc32(p[k]) for p in parts], np.uint32)
    found = importance.joined_crc(crc(0), crc(1), np.array([len(p[1]) for p in parts]))
    assert found.tolist() == [zlib.crc32(a + b) for a, b in parts]


@pytest.mark.parametrize("stretch", [1 << 22, 5])
def test_buckets_of_texts_cut_anywhere(monkeypatch, stretch):
    monkeypatch.setattr(importance, "STRETCH", stretch)
    texts = [(t or "").encode() for t in TEXTS]
    found, n_words = [collections.Counter() for _ in texts], [0] * len(texts)
    for pieces in importance._stretches(texts):
        owner, buckets, words_of = importance._buckets_of(pieces, 10_000)
        for k, b in zip(owner.tolist(), buckets.tolist(), strict=True):
            found[pieces[k][0]][b] += 1
        for (i, _, carried), n in zip(pieces, words_of.tolist(), strict=True):
            n_words[i] += n - carried
    assert found == [collections.Counter(map(bucket, grams(t))) for t in TEXTS]
    assert n_words == [len(words(t)) for t in TEXTS]


def test_resampling_by_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS * 5)] + [(None, "w " * 25, "x"), (7, "w " * 30, "x"), (99, "long " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    target = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None), (3, "w")], "item_id long, text string")
    found = importance.resample(docs, target, share=(30, 100)).collect()
    s, t = (collections.Counter(bucket(g) for x in texts for g in grams(x)) for texts in ([r[1] for r in rows], ["the cat sat on the mat", "w"]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    want = []
    for i, text, _ in rows:
        g = grams(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in g)
        want.append((i, len(words(text)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fits = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    key = lambda r: tuple(map(str, r))
    assert sorted(key(tuple(r)[:5]) for r in found) == sorted(map(key, want))
    assert [tuple(r)[:5] for r in sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])] == fits[: 30 * len(fits) // 100]
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.resample(docs, target.limit(0)).count() == len(rows)


def test_numbered(spark):
    rows = [(i % 3, i) for i in range(50)]
    found = common.numbered(spark.createDataFrame(rows, "a long, b long").repartition(7), ["-a", "b"], "at").collect()
    assert [(r["a"], r["b"]) for r in sorted(found, key=lambda r: r["at"])] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r["at"] for r in found) == list(range(50))


# --- clustering


def lloyd(vectors, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 1e200 else int(x) * 1024 for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [c for _, c in first]
    squared = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for r in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda j: (squared(v, centroids[j]), j)) for _, v in kept]
        if r < rounds:
            for j in set(own):
                members = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
                centroids[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    distances = [squared(v, centroids[j]) for (_, v), j in zip(kept, own, strict=True)]
    cost = collections.Counter()
    for j, d in zip(own, distances, strict=True):
        cost[j] += d
    fits = lambda x: x if x < 1 << 63 else None
    digest = lambda j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
    return [(i, j, fits(d), fits(cost[j]), fits(sum(distances)), digest(j)) for (i, _), j, d in zip(kept, own, distances, strict=True)]


@pytest.mark.parametrize("case", ["random", "ties", "few", "huge", "mixed"])
def test_clusters_by_brute_force(spark, case, monkeypatch):
    monkeypatch.setattr(sort_means, "BLOCK", 16)
    dice = random.Random(case)
    some = lambda n, scale=1.0: [(i, [dice.uniform(-scale, scale) for _ in range(4)]) for i in range(n)]
    vectors = {
        "random": some(150),
        "ties": [(i, [float(dice.randrange(2)) for _ in range(4)]) for i in range(80)],
        "few": some(3),
        "huge": [*some(20, 1e6), (20, [1e300, -1e300, 5e-324, 0.0]), (21, [3e8, 1.0, 1.0, 1.0])],
        "mixed": [*some(20), (3, [9.0, 9.0, 9.0, 9.0]), (3, [9.0, 9.0, 9.0, 9.0]), (None, [1.0] * 4), (30, None), (31, []), (32, [1.0] * 3), (33, [1.0, None, 1.0, 1.0]), (34, [1.0, math.nan, 1.0, 1.0]), (35, [1.0, math.inf, 1.0, 1.0])],
    }[case]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("clash")).repartition(3)
    found = sort_means.cluster(frame, dims=4, rounds=5)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, lloyd(vectors, rounds=5, dims=4)))


def test_clusters_of_nothing(spark):
    empty = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert sort_means.cluster(empty).collect() == [] and sort_means.cluster(empty.limit(0)).collect() == []


def test_stopping_leaves_out_only_what_is_further(monkeypatch):
    dice = np.random.RandomState(2)
    centroids, points = dice.randint(-50, 50, (12, 3)), dice.randint(-50, 50, (400, 3))
    seen = []
    plain = sort_means._squared
    monkeypatch.setattr(sort_means, "_squared", lambda a, b: (seen.append(len(a)), plain(a, b))[1])
    apart = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    at, distance = sort_means.nearest(points, apart.argmin(axis=1), centroids)
    assert at.tolist() == apart.argmin(axis=1).tolist() and distance.tolist() == apart.min(axis=1).tolist()
    assert sum(seen) < 12 * 400 * 0.8
    assert sort_means.nearest(points, np.zeros(400, int), centroids)[0].tolist() == at.tolist()


# --- mixing


def shares(sizes, share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    whole, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = whole - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in order}
        above = {s for s in free if target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutations(spark, n):
    ids = spark.range(n).withColumns({"n": F.lit(n).cast("long"), "five": F.lit(5), "six": F.lit(6)})
    rows = mixing.permuted(mixing.permuted(ids, "id", "n", "five", "to"), "id", "n", "six", "other").collect()
    assert sorted(r["to"] for r in rows) == sorted(r["other"] for r in rows) == list(range(n))
    if n == 1000:
        assert sum(r["to"] == r["other"] for r in rows) < 20 and sum(abs(r["to"] - r["id"]) < 50 for r in rows) < 200


def document(i, n):
    return " ".join(f"d{i}w{k}" for k in range(n))


def test_the_mix_follows_its_targets(spark):
    dice = random.Random(8)
    rows = [(i, f"s{min(int(dice.expovariate(0.5)), 9)}", dice.randrange(0, 400)) for i in range(600)] + [(1000, "s0", 30_000), (None, None, 900), (1001, None, 0)]
    docs = spark.createDataFrame([(i, s, document(i, n) if n else None, "x") for i, s, n in rows] + [(5, "copy", document(5, 90), "x")] * 40, "doc_id long, source string, text string, size string")
    found = mixing.mixed(docs, per_shard=500).collect()
    assert len(found) == len(rows) + 40
    sizes = collections.Counter()
    for r in found:
        sizes[r["source"]] += r["size"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert sorted((str(r["doc_id"]), r["size"]) for r in found) == sorted([(str(i), n) for i, _, n in rows] + [("5", 90)] * 40)
    want, taken = shares(dict(sizes)), collections.Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(0.05 * target, 64 * 8), s
    again = mixing.mixed(docs.repartition(5), per_shard=500).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_slots_and_pieces(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", document(i, 10 + i), None) for i in range(60)], "doc_id long, source string, text string, other string")
    sources = mixing.targets(mixing.sizes(docs))
    placed = mixing.placed(mixing.sizes(docs), sources)
    rows = mixing.mix(placed, sources, block=16, per_shard=50).collect()
    ends = collections.defaultdict(int)
    for r in sorted(placed.collect(), key=lambda r: (r["sid"], r["start"])):
        assert r["start"] == ends[r["sid"]]  # without gaps
        ends[r["sid"]] += r["size"]
    blocks, used = collections.defaultdict(int), collections.defaultdict(set)
    for r in rows:
        assert r["start"] + r["from"] >= r["block"] * 16 and r["start"] + r["from"] + r["length"] <= (r["block"] + 1) * 16
        blocks[r["shard"], r["place"]] += r["length"]
        used[r["sid"], r["block"]].add((r["shard"], r["place"]))
    last = {s: -(-n // 16) - 1 for s, n in ends.items()}
    assert all(len(u) <= 2 for u in used.values())
    assert all(n == 16 for n in blocks.values() if n != 16) or {n for n in blocks.values()} <= {16, *(ends[s] - 16 * b for s, b in last.items())}
    per_shard = collections.Counter(shard for shard, _ in blocks)
    assert max(per_shard.values()) - min(per_shard.values()) <= 3


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mixed(none).collect() == []
    silent = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert sorted(tuple(r) for r in mixing.mixed(silent).select("doc_id", "size", "target", "taken").collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
