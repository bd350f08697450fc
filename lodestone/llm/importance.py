"""Importance resampling towards a target distribution of hashed n-grams.

Texts become word ids, and the positions of a stretch of a partition are sorted
as a suffix array over them, as deep as the longest n-gram. Neighbours in that
order share a prefix of some words; a run of neighbours that share n words is
one n-gram. Its bucket is hashed once a run and scattered back to all of its
occurrences. The CRC of an n-gram follows from the CRCs and lengths of its
words, so a hash is a few look-ups for a whole array of runs.

The buckets of each document are stored; counts and weights read them from there.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import numbered, stash

STRETCH = 1 << 22  # bytes of a suffix array, a longer text is cut between words
LONGEST = 3  # words of the longest n-gram

#: Words, after A to Z are lower-cased: runs of digits, letters and all beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-zA-Z\x80-\xff]")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IN_WORD = np.array([bool(_WORD.fullmatch(bytes([b]))) for b in range(256)])
_ID_BITS = 21  # a stretch has at most half as many words as bytes

_powers: list[np.ndarray] = []


def _shifts(k: int) -> np.ndarray:
    """What 2 ** k zero bytes behind a text do to each byte of its CRC."""
    if not _powers:
        zero = zlib.crc32(b"\0")
        _powers.append(np.array([[zlib.crc32(b"\0", v << 8 * j) ^ zero for v in range(256)] for j in range(4)], np.uint32))
    while len(_powers) <= k:
        last = _powers[-1]
        _powers.append(_moved(last.ravel(), last).reshape(4, 256))
    return _powers[k]


def _moved(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def joined_crc(head: np.ndarray, tail: np.ndarray, tail_bytes: np.ndarray) -> np.ndarray:
    """The CRC-32 of texts put together, from those of their parts."""
    out, k = head.copy(), 0
    while tail_bytes.size and int(tail_bytes.max()) >> k:
        some = np.flatnonzero(tail_bytes >> k & 1)
        out[some] = _moved(out[some], _shifts(k))
        k += 1
    return out ^ tail


def _stretches(texts: list[bytes]) -> Iterator[list[tuple[int, bytes, int]]]:
    """Pieces of texts, about STRETCH bytes at a time: (number of the text, piece, words carried over).

    A piece of a long text begins with the last words of the one before, whose
    own n-grams are counted there.
    """
    run, size = [], 0
    for i, text in enumerate(texts):
        at, carried = 0, b""
        while at < len(text) or not at:
            end = at + STRETCH
            if end < len(text):
                gap = _GAP.search(text, end)
                end = gap.start() if gap else len(text)
            piece = carried + text[at:end]
            if run and size + len(piece) > STRETCH:
                yield run
                run, size = [], 0
            before = len(_WORD.findall(carried.translate(_LOWER)))
            run.append((i, piece, before))
            size += len(piece)
            if end < len(text):
                carried = b"".join(w + b" " for w in _WORD.findall(piece.translate(_LOWER))[1 - LONGEST :])
            at = max(end, 1)
    if run:
        yield run


def _sorted_runs(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of word ids, LONGEST words deep, and for each n the starts of runs that share n words.

    Ids are from 1; a suffix ends with its owner, where the id is 0.
    """
    key = np.zeros(len(ids), np.int64)
    for n in range(LONGEST):
        word = np.zeros(len(ids), np.int64)
        if n < len(ids):
            word[: len(ids) - n] = np.where(owner[n:] == owner[: len(ids) - n], ids[n:], 0)
        key = key << _ID_BITS | word
    order = np.argsort(key)
    key = key[order]
    starts = []
    for n in range(1, LONGEST + 1):
        prefix = key >> _ID_BITS * (LONGEST - n)
        starts.append(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
    return order, starts


def _buckets_of(pieces: list[tuple[int, bytes, int]], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and bucket of all n-grams of some pieces, by owner, and the number of words of each piece."""
    joined = b" ".join(p for _, p, _ in pieces).translate(_LOWER) + b" "
    data = np.frombuffer(joined, np.uint8)
    solid = _IN_WORD[data]
    starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    ends = np.flatnonzero(~solid & np.concatenate([[False], solid[:-1]]))
    bounds = np.cumsum([0, *(len(p) + 1 for _, p, _ in pieces)])
    words_of = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint16), words_of
    owner = np.repeat(np.arange(len(pieces)), words_of)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid].tobytes())]).dictionary_encode()
    ids = words.indices.to_numpy().astype(np.int64)
    known = words.dictionary.to_pylist()
    alone = np.array([zlib.crc32(w) for w in known], np.uint32)
    spaced = np.array([zlib.crc32(b" " + w) for w in known], np.uint32)
    longer = np.array([len(w) + 1 for w in known], np.int64)

    order, fresh = _sorted_runs(ids + 1, owner)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(words_of) - words_of, words_of)  # within the piece
    left = np.repeat(words_of, words_of) - place  # words to the end of the piece
    carried = np.repeat(np.array([c for _, _, c in pieces]), words_of)
    found = np.zeros((len(ids), LONGEST), np.uint16)
    real = np.zeros((len(ids), LONGEST), bool)
    crc = None
    for n in range(LONGEST):
        real[:, n] = (left > n) & (place + n >= carried)
        first = order[fresh[n]]  # where each run's n-gram stands
        if n == 0:
            crc = alone[ids[first]]
        else:
            # The run of n words that this run of n + 1 lies in has its hash already.
            outer = (np.cumsum(fresh[n - 1]) - 1)[fresh[n]]
            last = ids[np.minimum(first + n, len(ids) - 1)]
            crc = joined_crc(crc[outer], spaced[last], longer[last])
        found[order, n] = (crc % buckets).astype(np.uint16)[np.cumsum(fresh[n]) - 1]
    return np.repeat(owner, LONGEST)[real.ravel()], found.ravel()[real.ravel()], words_of


def features(docs: DataFrame, buckets: int = 10_000) -> DataFrame:
    """doc_id, n_words and the buckets of all n-grams of every row, as little-endian 16-bit numbers.

    A text that is null or without words has none.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are numbered by 16 bits")

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            n_words, held = [0] * len(texts), [[] for _ in texts]
            for pieces in _stretches(texts):
                owner, found, words_of = _buckets_of(pieces, buckets)
                cuts = np.searchsorted(owner, np.arange(len(pieces) + 1))
                for k, (i, _, before) in enumerate(pieces):
                    held[i].append(found[cuts[k] : cuts[k + 1]].astype("<u2").tobytes())
                    n_words[i] += int(words_of[k]) - before
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array([b"".join(h) for h in held], pa.binary())], ["doc_id", "n_words", "buckets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, buckets binary")


def counts(found: DataFrame, buckets: int = 10_000) -> dict[int, int]:
    """The n-grams in each bucket; tasks sum up their own, and a row a bucket comes to the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(raw, "<u2"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    rows = found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    return {r["bucket"]: r["n"] for r in rows}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = 10_000) -> np.ndarray:
    """floor(1000 ln of the target's smoothed share over the corpus's) of each bucket."""
    s_all, t_all = float(sum(corpus.values())), float(sum(target.values()))
    share = lambda b: (target.get(b, 0) + 1.0) * (s_all + buckets) / ((corpus.get(b, 0) + 1.0) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(share(b))) for b in range(buckets)], np.int64)


def _noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 times a Gumbel draw) that the id decides."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(found: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    shared = found.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches):
        for batch in batches:
            own = [np.frombuffer(raw, "<u2") for raw in batch.column(2).to_pylist()]
            weight = [int(shared.value[b].sum()) for b in own]
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(b) for b in own], pa.int64()),
                    pa.array(weight, pa.int64()),
                    pa.array([w + _noise(i, seed) for i, w in zip(ids, weight, strict=True)], pa.int64()),
                ],
                ["doc_id", "n_words", "n_features", "weight", "score"],
            )

    return found.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """Weight, score and rank of every document for a draw that resembles ``target``.

    Words are runs of digits, letters and characters beyond ASCII, with A to Z
    lower-cased; features are all runs of 1 to 3 of them, and a feature's bucket
    is its CRC-32 modulo ``buckets``. A bucket's gain compares its smoothed share
    in all of ``target`` with that in all of ``docs``; a document's weight is the
    sum over its features, and the score adds Gumbel noise that the id decides.
    Of the N documents with at least ``least_words`` words the highest
    floor(N * ``share``) scores are drawn, ties to the smaller doc_id.

    Columns: doc_id, n_words, n_features, weight, score, rank (from 1; null for
    what isn't drawn). A row of ``docs`` gives a row. Null and empty texts have
    no features and the weight 0; a null doc_id counts as an empty text in the
    noise and comes after others that tie; repeated rows count and are drawn each
    by itself; a text of any length is taken whole, in stretches. Where
    ``target`` is empty all its counts are 0. An empty table gives no rows; other
    columns are ignored.
    """
    found = stash(features(docs, buckets), "features")
    gain = gains(counts(found, buckets), counts(features(target.withColumn("doc_id", F.lit(None)), buckets), buckets), buckets)
    scored = stash(weigh(found, gain, seed).withColumn("row", F.monotonically_increasing_id()), "scores")
    long_enough = scored.where(F.col("n_words") >= least_words)
    drawn = long_enough.count() * share[0] // share[1]
    rank = F.col("place") + 1
    ranked = numbered(long_enough, ["-score", "doc_id", "row"], "place").withColumn("rank", F.when(rank <= drawn, rank))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(rest.select(*columns))
