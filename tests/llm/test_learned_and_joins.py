"""Classifiers on held-out labels, joins against brute force, and the pipeline."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import graph, line_crf, ngram_join, packing, queries, toxicity, vector_dedup
from lodestone.llm.common import WORD

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    dice = np.random.RandomState(1)
    lengths, move = np.array([3, 0, 1, 5, 2]), dice.randn(2, 2)
    unary = dice.randn(lengths.sum())
    good, expected = line_crf.forward_backward(unary, lengths, move)
    at, want, pairs = 0, [], np.zeros((2, 2))
    for n in lengths:
        if n == 0:
            continue
        total, mass, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            p = math.exp(sum(u for u, v in zip(unary[at : at + n], y, strict=True) if v) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += p
            mass += p * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                moves[a, b] += p
        want += (mass / total).tolist()
        pairs += moves / total
        at += n
    assert np.allclose(good, want) and np.allclose(expected, pairs)


def test_line_measures():
    texts = ["a b b\nA|! 1.\n\na b b\na b b\n a", "", "x", "a b b"]
    m, lines_of = line_crf.measure(texts)
    assert lines_of.tolist() == [6, 1, 1, 1]
    k = {n: i for i, n in enumerate(line_crf.MEASURES)}
    assert m[:, k["words"]].tolist() == [3, 2, 0, 3, 3, 1, 0, 1, 3]
    assert m[0, k["distinct"]] == pytest.approx(2 / 3) and m[1, k["bars"]] == 0.5
    assert m[:, k["repeated"]].tolist() == [1, 0, 0, 1, 1, 0, 0, 0, 0]
    assert m[:, k["as_before"]].tolist() == [0, 0, 0, 0, 1, 0, 0, 0, 0]


# The tables hold some 300 toxic training documents in four languages.
@pytest.mark.parametrize(
    ("query", "label", "sf_dir", "least"),
    [(queries.op6_line_crf, "quality", "sf0.1", (0.95, 0.95)), (queries.op2_toxicity, "toxic", "sf0.1", (0.95, 0.8))],
)
def test_held_out_accuracy(spark, query, label, sf_dir, least):
    found = query(spark, f"/root/testdata/{sf_dir}").join(spark.read.parquet(f"/root/testdata/{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    for y in (0, 1):
        own = [r for r in found if r[label] == y]
        assert sum(r["predicted"] == y for r in own) >= least[y] * len(own), y
    assert all(0 <= r["score"] <= 1 for r in found)


def test_window_scores_by_brute_force_and_against_the_words_of_the_dictionary(spark):
    import zstandard

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_on(docs, labels)
    rows = docs.join(labels, "doc_id").where("crc32(cast(doc_id AS string)) % 4 = 2 AND toxic IS NOT NULL").select("text", "toxic").collect()
    sizes = []
    for content in (model.ordinary, model.toxic):
        known = zstandard.ZstdCompressionDict(content + toxicity.ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(lambda w, c=c: len(c.compress(toxicity.ANCHOR + w + toxicity.TAIL)))
    for r in rows[:40]:
        found = []
        for w in {f" {w} ".encode() for w in WORD.findall(r["text"] or "")}:
            saved, apart = len(w) - 2 - sizes[1](w) + sizes[1](b""), sizes[0](w) - sizes[1](w)
            found.append(model.evidence[min(len(w) - 2, toxicity.LONGEST), min(max(saved, 0), toxicity.MOST_SAVED), min(max(apart, -toxicity.APART), toxicity.APART) + toxicity.APART])
        strongest = sorted((max(x, 0) for x in found), reverse=True)[: len(toxicity.STRONGEST)]
        total = sum(x * y for x, y in zip(strongest, toxicity.STRONGEST, strict=False))
        assert model.score(r["text"] or "") == pytest.approx(1 / (1 + math.exp(-model.slope * total - model.shift)))
    words = set(WORD.findall(model.toxic.decode("utf-8", "ignore").replace("\0", " ")))
    share = lambda hit, y: sum(bool(hit(r["text"] or "")) == bool(y) for r in rows if r["toxic"] == y) / sum(r["toxic"] == y for r in rows)
    by_distance = [share(lambda t: model.score(t) >= 0.3, y) for y in (0, 1)]
    by_words = [share(lambda t: words & set(WORD.findall(t)), y) for y in (0, 1)]
    assert sum(by_distance) > sum(by_words) + 0.1 and by_distance[0] >= 0.95 and by_distance[1] >= 0.8


def test_toxicity_learns_what_few_toxic_texts_share():
    dice = random.Random(4)
    text = lambda extra: " ".join(["".join(dice.choices("abcdefghij", k=5)) for _ in range(8)] + extra)
    toxic, ordinary = [text(["zumpolk"] if i % 100 == 0 else ["wexterq"]) for i in range(2000)], [text([]) for _ in range(2000)]
    grams = toxicity.distinctive(toxic, ordinary)
    assert toxicity.passages("the zumpolk and wexterq here", grams) == [b" zumpolk ", b" wexterq "]


def test_classifier_edges(spark):
    rows = [(1, None, 0.0), (2, "", 0.0), (2, "", 0.0), (None, "a b", 0.0), (3, " \n ", 0.0), (4, "word " * 50_000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    for run in (line_crf.classify, toxicity.classify):
        assert run(docs, labels).count() == len(rows)
        assert run(docs.limit(0), labels).count() == 0
    scored = line_crf.score(docs, line_crf.fit(["good text here. It goes on."] * 5 + ["x | y | z"] * 5, [1] * 5 + [0] * 5))
    assert scored.columns == ["doc_id", "text", "score"] and scored.count() == len(rows)


def brute_classes(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


def gram_set(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def check_join(rows, texts):
    sets = {i: gram_set(t) for i, t in texts.items()}
    ids = sorted(sets)
    holders = collections.defaultdict(list)
    for i in ids:
        for g in sets[i]:
            holders[g].append(i)
    common = collections.Counter((a, b) for found in holders.values() for k, a in enumerate(found) for b in found[k + 1 :])
    linked = [(a, b) for (a, b), k in common.items() if 5 * k >= 4 * (len(sets[a]) + len(sets[b]) - k)]
    degree, root = collections.Counter(x for pair in linked for x in pair), brute_classes(ids, linked)
    for r in rows:
        i = r["doc_id"]
        assert (r["n_grams"], r["n_links"], r["class_id"], r["kept"]) == (len(sets[i]), degree[i], root[i], root[i] == i), i
    assert len(rows) == len(ids)


def test_join_on_near_copies(spark):
    dice = random.Random(5)
    texts, n = {}, 0
    for base in ([f"a{i}" for i in range(120)], [f"b{i}" for i in range(60)]):
        for _ in range(40):
            words = list(base)
            for _ in range(dice.randint(0, 4)):
                words[dice.randrange(len(words))] = f"new{dice.randrange(50)}"
            texts[n] = " ".join(words)
            n += 1
    texts |= {500: None, 501: "", 502: " \n", 503: "one two", 504: "one two", 505: "one  two", 506: "x " * 40_000, 507: "x " * 30_000}
    docs = spark.createDataFrame([(i, t, "clash") for i, t in texts.items()], "doc_id long, text string, node string").repartition(5)
    check_join(ngram_join.jaccard_join(docs).collect(), texts)


def test_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 7)
    test_join_on_near_copies(spark)


@pytest.mark.parametrize(("block", "n"), [(2048, 5000), (64, 600)])
def test_forest_in_a_shared_prefix(spark, monkeypatch, block, n):
    # A passage gives very many unlike nodes the labels of a few like ones, whose ids lie far apart.
    monkeypatch.setattr(ngram_join, "BLOCK_LABELS", block, raising=False)
    dice = np.random.RandomState(8)
    labels, bits = dice.bytes(ngram_join.TREES * ngram_join.DEPTH * 2), dice.randint(0, 256, (n, ngram_join.BITS // 8)).astype(np.uint8)
    like = [n // 10, n // 2, n - 7]
    for i in like:
        bits[i] = bits[like[0]]
        bits[i, 0] ^= i % 4
    rows = [(i, 1, 100 + (0 if i in like else i % 40), labels, bits[i].tobytes()) for i in range(n)]
    nodes = spark.createDataFrame(rows, "node long, copies long, grams long, labels binary, bits binary").repartition(5)
    got = {r["node"]: r["root"] for r in graph.components(ngram_join._forest(nodes, 4, 30, (4, 5))).collect()}
    assert got == dict.fromkeys(like, like[0])


def test_trie_walk_connects_what_any_pair_would():
    dice = np.random.RandomState(4)
    for _ in range(60):
        n = int(dice.randint(2, 40))
        labels = np.zeros((n, 2 + 2 * ngram_join.DEPTH), np.uint8)
        labels[:, -4:] = dice.randint(0, 2, (n, 4))
        labels = labels[np.lexsort(labels.T[::-1])]
        rows = np.column_stack([np.arange(n), dice.randint(100, 125, n), np.zeros(n), dice.randint(0, 1 << 8, n)]).astype(np.uint64)
        pairs = [
            (a, b) for a in range(n) for b in range(a)
            if 4 * max(rows[a, 1], rows[b, 1]) <= 5 * min(rows[a, 1], rows[b, 1]) and (int(rows[a, 3]) ^ int(rows[b, 3])).bit_count() <= 2
        ]
        assert brute_classes(range(n), list(ngram_join._trie_edges(rows, labels, 4, 2, (4, 5)))) == brute_classes(range(n), pairs)


def test_word_hashes_tell_words_apart():
    dice = random.Random(9)
    words = ["".join(dice.choices("ab\0éx", k=dice.randint(1, 20))) for _ in range(4000)]
    found = ngram_join.word_hashes("\t" + " \n".join(words) + "\r")
    assert len(found) == len(words) and len(set(zip(words, found.tolist(), strict=True))) == len(set(words)) == len(set(found.tolist()))


def test_recall_just_over_the_threshold(spark):
    dice, texts, linked = random.Random(12), {}, 0
    for i in range(1500):
        words = [f"w{i}x{k}" for k in range(94)]
        texts[2 * i], texts[2 * i + 1] = " ".join(words + [f"a{i}b{k}" for k in range(10)]), " ".join(words + [f"c{i}d{k}" for k in range(dice.randint(9, 12))])
        a, b = gram_set(texts[2 * i]), gram_set(texts[2 * i + 1])
        linked += 5 * len(a & b) >= 4 * len(a | b)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    found = ngram_join.jaccard_join(docs).where("n_links > 0").count()
    assert linked > 1000 and found >= 0.99 * 2 * linked and found <= 2 * linked


def test_join_on_a_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_join(ngram_join.jaccard_join(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})


def test_join_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    rows = sorted(tuple(r) for r in ngram_join.jaccard_join(docs).collect() if r["doc_id"] is not None)
    assert rows == [(1, 2, 1, 1, True), (1, 2, 1, 1, True), (2, 0, 0, 2, True)]
    assert ngram_join.jaccard_join(docs.limit(0)).count() == 0


def test_join_of_one_id_with_two_texts(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (1, "something else that is not like the rest at all"), (2, " ".join(words[:-1]))]
    got = sorted(tuple(r) for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 6, 1, 1, True), (1, 56, 1, 1, True), (2, 55, 1, 1, False)]


def test_long_lines_and_texts(monkeypatch):
    dice = random.Random(6)
    text = "\n".join(" ".join(dice.choices(["one", "Two.", "3", "|", "é!"], k=dice.randint(0, 12))) for _ in range(400))
    whole = line_crf.measure([text, "", text[:500]])
    monkeypatch.setattr(line_crf, "CHUNK_CHARS", 100)
    parts = line_crf.measure([text, "", text[:500]])
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    m, lines_of = line_crf.measure(["ab " * 100, "x" * 250])
    assert lines_of.tolist() == [1, 1] and m[:, 0].tolist() == [100, 1]


def test_pipeline_edges(spark, tmp_path):
    good = [" ".join(f"word{(i * j) % 89}" for j in range(1, 60)) + "." for i in range(1, 40)]
    bad = ["| a | b | " * 30 for _ in range(20)]
    texts = [*good, *bad, None, "", " ", good[0], good[0] + " more", "x " * 30_000]
    rows = [(i, t, 1, 2, "a", "b", "c", "d", "e") for i, t in enumerate(texts)] + [(0, good[0], 1, 2, "a", "b", "c", "d", "e")] * 2 + [(None, good[1] + " again and again we go on", 1, 2, "a", "b", "c", "d", "e")]
    names = "doc_id long, text string, score int, n_words int, M string, kept_id string, `a.b` string, _s string, row string"
    docs = spark.createDataFrame(rows, names)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for kind, labels in (("both", [(i, int(i < 39), 0) for i in range(59)]), ("one", [(i, 1, 0) for i in range(59)])):
        folder = tmp_path / kind
        folder.mkdir()
        (folder / "documents.parquet").symlink_to(tmp_path / "documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        kept = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:3]:
            assert stage(spark, kept.limit(0), str(folder)).count() == 0
            kept = stage(spark, kept, str(folder))
            assert kept.columns == docs.columns, name
            found = kept.collect()
            assert all((r["score"], r["n_words"], r["M"], r["kept_id"], r["a.b"], r["_s"]) == (1, 2, "a", "b", "c", "d") for r in found)
            kept = spark.createDataFrame(found, docs.schema)
        ids = [r["doc_id"] for r in found]
        assert ids.count(0) == 1 and ids.count(None) == 1 and set(range(39)) <= set(ids) and not set(ids) & {62, 63}, kind
        pieces = corpus_pipeline.run(spark, str(folder)).collect()
        assert sorted((r["doc_id"] or -1) for r in pieces if r["piece"] == 0) == sorted((i or -1) for i in ids)


def test_recall_model():
    assert ngram_join.recall(ngram_join.prefix_depth(0.8, 0.9999), 0.8) >= 0.9999
    assert ngram_join.prefix_depth(0.8, 0.5) == ngram_join.DEPTH


def test_components(spark):
    dice = random.Random(2)
    pairs = [(dice.randrange(300), dice.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(100)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = brute_classes({x for p in pairs for x in p}, pairs)
    assert got == {i: r for i, r in want.items() if any(a != b and i in (a, b) for a, b in pairs)}


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    monkeypatch.setattr(vector_dedup, "LEAF", 4)
    monkeypatch.setattr(vector_dedup, "MEETING", 5)
    dice = np.random.RandomState(3)
    rows = []
    for c in range(12):
        centre = dice.randn(8)
        for _ in range(15):
            rows.append((len(rows), (centre + dice.randn(8) * 0.12).tolist(), c % 3, "clash"))
    rows += [(500, rows[0][1], 0, ""), (501, rows[0][1], 0, ""), (502, rows[0][1], None, ""), (503, [0.0] * 8, 0, ""), (504, None, 0, ""), (505, [None] + [1.0] * 7, 0, ""), (506, [math.nan] * 8, 0, ""), (507, [math.inf] + [1.0] * 7, 0, ""), (508, [], 0, ""), (509, [1.0, 2.0], 0, ""), (510, [2.0, 4.0], 0, "")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long, node string").repartition(6)
    fine = {i: np.array(v) for i, v, label, _ in rows if v and label is not None and None not in v and np.isfinite(v).all() and any(v)}
    labels = {r[0]: r[2] for r in rows}
    linked = [
        (a, b)
        for a in fine
        for b in fine
        if a < b and labels[a] == labels[b] and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] / math.sqrt((fine[a] @ fine[a]) * (fine[b] @ fine[b])) >= 0.98
    ]
    assert len(linked) > 50
    degree, root = collections.Counter(x for p in linked for x in p), brute_classes([r[0] for r in rows], linked)
    got = vector_dedup.near_duplicates(vectors).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (degree[i], root[i], root[i] == i), i
    assert vector_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns and 0 < kept.count() < before.count(), name
        if name == "near_duplicates":
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            sets = {i: gram_set(t) for i, t in texts.items()}
            left = {r["doc_id"] for r in kept.collect()}
            assert not any(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a in left for b in left if a < b)
    ids = {r["doc_id"] for r in kept.collect()}
    assert {r["doc_id"] for r in packing.pack(kept, corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")).collect()} == ids
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == ids
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [labels[r["doc_id"]] for r in corpus_pipeline.quality_classifier(spark, docs, SF).collect() if r["doc_id"] in labels]
    assert judged.count(0) <= 0.1 * list(labels.values()).count(0)
    assert judged.count(1) >= 0.98 * list(labels.values()).count(1)


def test_a_line_of_any_length_is_one_line(monkeypatch):
    dice = random.Random(6)
    line = " ".join(dice.choice(["alpha", "beta|", "x" * 90, "9.", "é!"]) for _ in range(300))
    texts = [f"one\n{line}\n{line}\ntwo\n{line} ", line, "x" * 500, line + "\n" + "y" * 700]
    whole = line_crf.measure(texts)
    monkeypatch.setattr(line_crf, "CHUNK_CHARS", 64)
    monkeypatch.setattr(line_crf, "_powers", {})
    parts = line_crf.measure(texts)
    assert np.array_equal(whole[0], parts[0]) and whole[1].tolist() == parts[1].tolist() == [5, 1, 1, 2]


def test_scores_do_not_depend_on_neighbours():
    dice = random.Random(7)
    text = lambda: "\n".join(" ".join("".join(dice.choices("abc|!. A9", k=6)) for _ in range(dice.randrange(9))) for _ in range(dice.randrange(1, 30)))
    texts = [text() for _ in range(300)]
    model = line_crf.fit(texts[:60], [i % 2 for i in range(60)])
    together, alone = model.scores(texts), np.concatenate([model.scores([t]) for t in texts])
    assert together.tolist() == alone.tolist()


def test_a_chain_is_a_whole_document(monkeypatch):
    texts, labels = ["good text here. It goes on.\n" * 3] * 6 + ["x | y | z\n" * 3] * 6, [1] * 6 + [0] * 6
    plain = line_crf.fit(texts, labels)
    monkeypatch.setattr(line_crf, "LONGEST_CHAIN", 10)
    longer = line_crf.fit([*texts, "x | y\n" * 500], [*labels, 1])  # passed over
    assert longer.weights.tolist() == plain.weights.tolist()
    only = line_crf.fit(["good text.\n" * 50, "x | y\n" * 50], [1, 0])  # none is short
    assert only.learned


def test_a_long_text_does_not_end_the_sample(spark):
    from lodestone.llm.common import labelled_sample

    docs = spark.createDataFrame([(i, "x" * (5000 if i in (0, 1) else 10)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    free = labelled_sample(docs, labels, "quality", 40).count()
    rows = labelled_sample(docs, labels, "quality", 40, class_bytes=4000).collect()
    assert len(rows) == free - sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in (0, 1))
    assert sum(len(r["text"]) for r in labelled_sample(docs, labels, "quality", 40, class_bytes=5100).collect() if r["y"] == 0) <= 5100


def links_of(spark, rows):
    found = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")).collect()
    return sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found)


def test_vectors_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 1), (1, [1.0, 0.0, 0.0], 2), (9, [0.0, 2.0, 0.0], 2)]
    assert links_of(spark, rows) == [(1, 0, 1, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (9, 0, 9, True)]


def test_vectors_at_the_ends_of_their_range(spark):
    rows = [(1, [1e160, 1e160], 0), (2, [1e160, 1.01e160], 0), (3, [5e-324, 0.0], 0), (4, [1e-170, 0.0], 0), (5, [0.0, 0.0], 0), (6, [math.inf, 1.0], 0), (7, [1.7e308, 1.7e308], 0)]
    assert links_of(spark, rows) == [(1, 2, 1, True), (2, 2, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 0, 6, True), (7, 2, 1, False)]


@pytest.mark.parametrize("value", [0, 1])
def test_labels_of_one_class_teach_nothing(spark, value):
    from lodestone.llm import rules

    docs = spark.createDataFrame([(i, f"plain words number {i} " * 10, "x") for i in range(60)] + [(None, "word " * 40, "y"), (99, "word " * 100_000, "z")], "doc_id long, text string, SCORE string")
    labels = spark.createDataFrame([(i, value, value) for i in range(60)], "doc_id long, quality int, toxic int")
    assert rules.learn_from(docs, labels) == []
    assert rules.apply(docs, []).where("kept = base_failed").count() == 0
    for run in (line_crf.classify, toxicity.classify):
        found = run(docs, labels).collect()
        assert len(found) == 62 and all(0 <= r["score"] <= 1 for r in found)
        assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]


def test_the_list_of_rules_in_spark_and_by_hand(spark):
    from lodestone.llm import rules

    dice = random.Random(12)
    texts = [" ".join("".join(dice.choices("abcde|!#A", k=dice.randrange(1, 9))) for _ in range(dice.randrange(20, 60))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    measured = [r.asDict() for r in rules.base_statistics(docs).select("row.doc_id", "n_words", "n_repeat_words", "m.*").collect()]
    names = [m for m in rules.MEASURES if m in measured[0]]
    middle = {m: sorted(r[m] for r in measured)[60] for m in names}
    learned = [tuple(rules.Test(m, dice.random() < 0.5, float(middle[m])) for m in dice.sample(names, k)) for k in (3, 2, 3, 1)]
    want = {r["doc_id"]: not (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not any(all(t.holds(r) for t in rule) for rule in learned) for r in measured}
    found = {r["doc_id"]: r["kept"] for r in rules.apply(docs, learned).collect()}
    assert found == want and 5 < sum(want.values()) < 115
