"""Rules, tokenizers, archives and URLs against brute force and edge cases."""

import base64
import collections
import hashlib
import io
import re
import zlib
from array import array

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from lodestone.llm import bpe, packing, pretokens, rules, token_counts, url_filters, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "In. " * 300,
    "a b c d e f g h a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2,
    "line\nline\n\nother | $5 <b> é\n line\nline",
    "a<|endoftext|>b <|endoftext|><|endoftext|>",
    "it's 12345  \n\n\t 中文 🙂 don't\x1cstop\x85now\u00a0x",
    "ΑΣ ΑΣ. İstanbul e\u0301 ﬁ ẞ",
    LONG,
    LONG,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", "x") for i, t in enumerate(TEXTS)] + [(None, "null id here", "clash", "x"), (3, "one", "clash", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, ids string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def base_row(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_statistics(docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = {r["doc_id"]: tuple(r[n] for n in names) for r in rules.apply(docs, []).collect()}
    for i, t in enumerate(TEXTS):
        assert found[i] == base_row(t), i
    for r in rules.apply(docs, []).collect():
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed)


def test_rules_carry_any_columns(spark):
    docs = spark.createDataFrame([(1, TEXTS[4], 1, 2, 3, 4, 5, 6)], "doc_id long, text string, _words int, _s int, M int, `a.b` int, row int, N_WORDS int")
    rule = (rules.Test("words", False, 100.0),)
    out = rules.apply(docs, [rule])
    assert out.columns == ["doc_id", "text", "_words", "_s", "M", "a.b", "row", *rules.ADDED]
    row = out.first()
    assert (row["_words"], row["_s"], row["M"], row["a.b"], row["row"], row["n_words"], row["kept"]) == (1, 2, 3, 4, 5, 300, False)
    assert rules.keep(docs, []).columns == docs.columns and rules.keep(docs, [rule]).count() == 0


def test_sample_is_bounded(spark):
    from lodestone.llm.common import labelled_sample

    docs = spark.createDataFrame([(i, "x" * 10) for i in range(40)] * 2 + [(3, "w")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, "quality", 9).collect()
    assert len(rows) == len({r["doc_id"] for r in rows}) == 18 and {r["text"] for r in rows if r["doc_id"] == 3} <= {"w"}
    assert len(labelled_sample(docs, labels, "quality", 9, class_bytes=45).collect()) == 8 + any(r["doc_id"] == 3 for r in rows)


def test_rules_on_a_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learned = rules.learn_from(docs, labels)
    assert 1 <= len(learned) <= 12
    rows = rules.apply(docs, learned).join(labels, "doc_id").where("crc32(cast(doc_id AS string)) % 4 = 2").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.8 * len(bad)


def test_decision_list():
    row = lambda y, **x: {"y": y, "doc_id": 0} | dict.fromkeys(rules.MEASURES, 1.0) | x
    rows = [row(0, bars_per_word=0.5 + i / 100) for i in range(30)] + [row(0, upper_share=0.9) for _ in range(30)] + [row(1, upper_share=i / 100) for i in range(30)]
    for r in rows[30:]:
        r["bars_per_word"] = 0.0
    learned = rules.learn(rows)
    caught = [any(all(t.holds(r) for t in rule) for rule in learned) for r in rows]
    assert caught == [not r["y"] for r in rows]
    assert rules.learn([]) == [] and rules.learn(rows[:5]) == []


def test_rules_empty(empty):
    assert rules.apply(empty, []).count() == 0


def test_bpe_matches_the_library(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = bpe.encode_decode(docs, path, keep_ids=True).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r["doc_id"] is None:
            continue
        ids = library.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == text
        assert r["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(empty, path).count() == 0
    assert bpe.decode([447, 50300, 50256], path) == library.decode([447, 50300, 50256], skip_special_tokens=False)


def test_prefixes_equal_merges():
    import random

    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    encoder, dice = bpe.PrefixEncoder(vocabulary), random.Random(7)
    pool = list(vocabulary.tokens.values())[:2000]
    for _ in range(4000):
        piece = bytes(dice.choice(b"aehnt ") for _ in range(dice.randint(1, 16))) if dice.random() < 0.5 else b"".join(dice.choice(pool) for _ in range(dice.randint(1, 4)))
        assert encoder.encode(piece) == vocabulary.merge(piece) == plain_merges(vocabulary, piece)


def plain_merges(vocabulary, piece):
    ids = [vocabulary.ids[bytes([x])] for x in piece]
    while len(ids) > 1:
        found = min((*vocabulary.merges.get(p, (1 << 60, 0)), i) for i, p in enumerate(zip(ids, ids[1:], strict=False)))
        if found[0] == 1 << 60:
            break
        ids[found[2] : found[2] + 2] = [found[1]]
    return ids


def test_long_unbroken_runs(spark):
    import random
    import time

    path, dice = public_tokenizers.path("byte_bpe_50k.json"), random.Random(4)
    library = Tokenizer.from_file(path)
    texts = ["".join(dice.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "a" * 300_000, "é" * 50_000, "0" * 70_000, " " * 80_000, "=" * 80_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, path).collect()}
    ids = {r["doc_id"]: r["ids_sha256"] for r in bpe.encode_decode(docs, path).collect()}
    assert time.time() - began < 60
    for i, t in enumerate(texts):
        want = library.encode(t, add_special_tokens=False).ids
        assert counts[i] == len(want) and ids[i] == hashlib.sha256(array("I", want).tobytes()).hexdigest()


def test_token_counts(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = token_counts.count_tokens(docs, path).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r["doc_id"] is not None:
            text = TEXTS[r["doc_id"]] or ""
            n = len(library.encode(text, add_special_tokens=False).ids)
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)
    assert token_counts.count_tokens(empty, path).count() == 0


def check_packing(rows, texts, capacity=4096):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for slots in by_sequence.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc_id])
        want = [(k, s, len(ids[s : s + capacity]), zlib.crc32(array("I", ids[s : s + capacity]).tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
        assert got == want, doc_id
    return len(by_sequence)


def test_packing(docs, empty, spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs, path).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert {r["doc_id"] for r in rows} == {None, *range(len(TEXTS))}
    assert packing.pack(empty, path).count() == 0
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    corpus = spark.createDataFrame([*texts.items(), (-1, None), (-2, LONG)], "doc_id long, text string").repartition(4)
    rows = packing.pack(corpus, path).collect()
    used = check_packing(rows, texts | {-1: None, -2: LONG})
    assert used <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_words_equal_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(pretokens, "CHUNK", 700)
    path = public_tokenizers.path("word_bpe_49k.json")
    library, mine = Tokenizer.from_file(path), packing.WordTokenizer(path, slots=1 << 10)
    texts = [t or "" for t in TEXTS] + [f"a{chr(i)}b 'S{chr(i)}'s1 {chr(i)}{chr(i)} x" for i in range(0x250)]
    texts += [f"it'S 'll'd don't''t 12{c}3 <|startoftext|>{c} A" for c in "\u03a3\u0130\u2126\u1e9e\ufb01\u0301\u2003"]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for _ in range(2):
        for text, ids in zip(texts, mine(texts), strict=True):
            assert array("I", ids).tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_pre_tokens_equal_the_pattern(monkeypatch):
    import random

    import numpy as np

    monkeypatch.setattr(pretokens, "CHUNK", 64)
    words: dict[bytes, int] = {}
    lookup = pretokens.Lookup(pretokens.with_leading_space, True, lambda ws: [np.array([words.setdefault(w, len(words))], np.uint32) for w in ws], slots=1 << 10)
    dice, pattern = random.Random(1), regex.compile(bpe.PRE_TOKEN)
    pool = [*"aab' '  \n\t.1  \u00e9\u4e2d\U0001f600's't reve'll\x1c\x85\u3000\u00b2\u00b7_\0", "'s", "'re", "  ", ' "', "abcdefghijklmnopqrst"]
    for _ in range(1500):
        texts = ["".join(dice.choices(pool, k=dice.randint(0, 40))) for _ in range(4)]
        raw = [t.encode() for t in texts]
        found, counts = lookup.ids(raw), lookup.counts(raw)
        by_id = {i: w.decode() for w, i in words.items()}
        for t, ids, n in zip(texts, found, counts.tolist(), strict=True):
            want = pattern.findall(t)
            assert [by_id[i] for i in array("I", ids)] == want and n == len(want), t


def best_fit_decreasing(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fit = min((x for x in left if x >= n), default=None)
        if fit is not None:
            left.remove(fit)
        left.append((fit or capacity) - n)
    return len(left)


def test_plan_is_never_far_from_best_fit():
    import random

    dice = random.Random(11)
    for capacity in (20, 100, 4096):
        for _ in range(25):
            lengths = [min(capacity, 1 + int(dice.expovariate(4 / capacity))) for _ in range(dice.randint(1, 400))]
            used = sum(times for _, times in packing.plan(dict(collections.Counter(lengths)), capacity))
            assert -(-sum(lengths) // capacity) <= used <= best_fit_decreasing(lengths, capacity) + 1


def test_exact_complements_under_counts():
    # The sum 9 of the gap: the first c of (6, 2, 1) is used up, (4, 3, 2) is left.
    counts = packing.Counts({11: 1, 6: 1, 4: 1, 3: 1, 2: 1}, 20)
    assert counts.exact(9, (11,)) == (6, 3)
    counts.take((6,), 1)
    assert sorted(counts.exact(9, (11,))) == [2, 3, 4]
    assert counts.exact(9, (11, 2)) is None and counts.exact(9, (11,)) is not None
    counts.take((2,), 1)
    assert counts.exact(9, (11,)) is None and 9 in counts.no_triple
    # Brute force: a combination is found iff one exists.
    import itertools
    import random

    dice = random.Random(2)
    for _ in range(300):
        histogram = {n: dice.randint(1, 2) for n in dice.sample(range(1, 16), dice.randint(1, 6))}
        counts = packing.Counts(histogram, 30)
        held = (dice.choice(sorted(histogram)),)
        for gap in range(1, 20):
            fits = any(sum(x) == gap and all((held + x).count(n) <= histogram[n] for n in held + x) for k in (1, 2, 3) for x in itertools.combinations_with_replacement(sorted(histogram), k))
            found = counts.exact(gap, held)
            assert (found is not None) == fits and (found is None or sum(found) == gap)


def test_plan_uses_every_piece_once():
    import random

    dice = random.Random(3)
    for capacity in (10, 64):
        for _ in range(60):
            lengths = collections.Counter(dice.randint(1, capacity) for _ in range(dice.randint(0, 80)))
            used = collections.Counter()
            for pattern, times in packing.plan(dict(lengths), capacity):
                assert times > 0 and sum(pattern) <= capacity
                for n in pattern:
                    used[n] += times
            assert used == lengths
    assert packing.plan({7: 1, 2: 1, 1: 1, 6: 1, 4: 1}, 10) == [((7, 2, 1), 1), ((6, 4), 1)]


PAGES = [
    (1, "http://a.example.com/x y\r\nWARC-Type: evil", "<p>é</p>"),
    (2, None, "<p>é</p>"),
    (5, "https://b", "<p>é</p>"),
    (3, "", None),
    (4, "u", ""),
    (None, "u", "only"),
    (6, "u", "x" * 300_000),
    (7, "u", "once\r\n\r\nWARC/1.1\r\n"),
    (7, "u", "once\r\n\r\nWARC/1.1\r\n"),
]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    rows = warc.round_trip(spark, pages).collect()
    got = collections.Counter(tuple(r) for r in rows)
    last = {}
    for i, _, h in PAGES:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    want = collections.Counter()
    for i, _, h in PAGES:
        b = (h or "").encode()
        revisit = i is not None and i != last[h or ""]
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", last[h or ""] if revisit else None] += 1
    assert got == want
    assert warc.round_trip(spark, pages.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.round_trip(spark, pages, min_bytes=10**6).collect()} == {"response"}


def test_warc_damage():
    good = warc.record(1, "u", b"abc", warc.digest(b"abc"), None)
    assert [r.http()[1] for r in warc.read_archive(io.BytesIO(good + good))] == [b"abc", b"abc"]
    for bad in (good[:-9], good[:30] + bytes([good[30] ^ 255]) + good[31:], good + b"junk", warc.record(1, "u", b"abc", warc.digest(b"abd"), None)):
        with pytest.raises(warc.Damaged):
            list(warc.read_archive(io.BytesIO(bad)))


def brute_verdict(url, table):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host = m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [(len(h + p), v, h + p) for v, h, p in table if (host == h or host.endswith("." + h)) and m[2].startswith(p)]
    best = max(fits, default=(0, "allow", None))
    return host, m[2], best[2], best[1]


def test_url_filters(spark):
    table = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    urls = ["http://" + "a." * 500 + "example.com/en/" + "p/" * 3000, None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/a?b#c", "http://example.com", "http://x.example.com/en/1", "http://notexample.com/en/", "https://a.b.net/fr/?q", "x://net/es", "x://net/es/#", "a://b://net/fr/", "http://É.com/", "http://com.?x", "http://..com/en", "http://u:p@h.com:80/é"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(0, None, "clash"), (4, urls[4], "clash"), (None, urls[6], "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = collections.Counter(tuple(r) for r in url_filters.judge(pages, url_filters.rule_table(spark, table)).collect())
    assert got == collections.Counter((i, *brute_verdict(u, table)) for i, u, _ in rows)
    assert {r["verdict"] for r in url_filters.judge(pages, url_filters.rule_table(spark, [])).collect()} == {"allow"}
    assert url_filters.judge(pages.limit(0), url_filters.rule_table(spark, table)).count() == 0
