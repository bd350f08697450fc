"""Best-fit packing of token sequences by exact-complement hashing.

Only the histogram of lengths, at most one row per length up to the capacity,
comes to the driver. There a plan is made: patterns of lengths with the number
of sequences that use each. The pieces then find their places by their length
and their rank within it, so no task or driver holds all pieces.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import pretokens
from lodestone.llm.common import map_batches, stash, text_parts


class Counts:
    """How many pieces of each length are left, and the sums that one, two and three of them make.

    Singles are looked up by their length, pairs and triples by their sums. The
    index of pairs is made at once; that of triples holds for a sum the parts
    that some pair completes, and is made for a sum when it is asked for first.
    As counts only fall, what can't be taken any more leaves both for good.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.left = {n: c for n, c in histogram.items() if c > 0}
        self.lengths = sorted(self.left)
        sizes = np.array(self.lengths, np.int64)
        larger, smaller = [], []
        for k, n in enumerate(self.lengths):  # the smaller ones that fit beside it
            fit = sizes[: min(k + 1, bisect_right(self.lengths, capacity - n))]
            larger.append(np.full(len(fit), n, np.int64))
            smaller.append(fit)
        a = np.concatenate(larger) if larger else np.empty(0, np.int64)
        b = np.concatenate(smaller) if smaller else np.empty(0, np.int64)
        order = np.lexsort((-a, a + b))  # by sum, the largest part first
        self.larger, self.smaller = a[order], b[order]
        ends = np.searchsorted((a + b)[order], np.arange(capacity + 2))
        self.next, self.end = ends[:-1].tolist(), ends[1:].tolist()
        self.triple_parts: dict[int, list[int]] = {}  # of a sum, the largest first

    @property
    def no_triple(self) -> set[int]:
        """The sums asked for that no triple makes any more."""
        return {total for total, alive in self.triple_parts.items() if not alive}

    def take(self, pattern: tuple[int, ...], times: int) -> None:
        for n in pattern:
            self.left[n] -= times
            if not self.left[n]:
                del self.left[n]
                self.lengths.pop(bisect_right(self.lengths, n) - 1)

    def times(self, pattern: tuple[int, ...]) -> int:
        """How often the lengths of a pattern can be taken together."""
        return min((self.left.get(n, 0) // pattern.count(n) for n in set(pattern)), default=0)

    def largest(self, most: int) -> int | None:
        at = bisect_right(self.lengths, most)
        return self.lengths[at - 1] if at else None

    def pairs(self, total: int) -> Iterator[tuple[int, int]]:
        """Pairs of a sum that the counts allow by themselves, the largest part first."""
        left, at, end = self.left, self.next[total], self.end[total]
        first = True
        while at < end:
            a, b = int(self.larger[at]), int(self.smaller[at])
            at += 1
            if a in left and b in left and (a != b or left[a] > 1):
                first = False
                yield a, b
            elif first:
                self.next[total] = at

    def triples(self, total: int) -> Iterator[tuple[int, int, int]]:
        """Triples of a sum that the counts allow by themselves, the largest first part first; it is a third at least."""
        parts = self.triple_parts.get(total)
        if parts is None:
            parts = [a for a in reversed(self.lengths[: bisect_right(self.lengths, total - 2)]) if 3 * a >= total]
        alive = []
        self.triple_parts[total] = alive
        for k, a in enumerate(parts):
            some = False
            for b, c in self.pairs(total - a) if a in self.left else ():
                if self.times((a, b, c)):
                    if not some:
                        some = True
                        alive.append(a)
                        self.triple_parts[total] = alive + parts[k + 1 :]  # in case nobody asks for more
                    yield a, b, c
        self.triple_parts[total] = alive

    def exact(self, gap: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        """One, two or three lengths that sum up to a gap and are left besides those held."""
        if self.times((*held, gap)):
            return (gap,)
        for pair in self.pairs(gap):
            if self.times((*held, *pair)):
                return pair
        for triple in self.triples(gap):
            if self.times((*held, *triple)):
                return triple
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences use each.

    Every piece is used once. The largest length left opens a sequence; its gap
    is filled exactly by one, two or three lengths if they are left. What fits
    no exact combination is filled best-fit: the largest length that fits goes
    in, and the gap that stays is again filled exactly if it can be. A step
    takes all sequences that the counts allow at once, so the number of steps
    follows the number of lengths, not of pieces.
    """
    counts, out = Counts(histogram, capacity), []
    while counts.lengths:
        pattern: tuple[int, ...] = (counts.lengths[-1],)
        gap = capacity - pattern[0]
        while gap:
            found = counts.exact(gap, pattern)
            if found is not None:
                pattern += found
                break
            largest = counts.largest(gap)
            while largest is not None and not counts.times((*pattern, largest)):
                largest = counts.largest(largest - 1)
            if largest is None:
                break
            pattern = (*pattern, largest)
            gap -= largest
        times = counts.times(pattern)
        counts.take(pattern, times)
        out.append((pattern, times))
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """(length, first rank, pieces a sequence, first sequence, offset) of every run of equal lengths of a plan.

    Ordered by length and rank. A run's pieces follow one another, so there are
    at most as many rows as patterns times different lengths of a pattern.
    """
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for n in dict.fromkeys(pattern):
            each = pattern.count(n)
            out.append((n, used.get(n, 0), each, sequence, offset))
            used[n] = used.get(n, 0) + times * each
            offset += n * each
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


_tokenizers: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Ids by the tokenizers library, each pre-token encoded once.

    The vocabulary drops white space and its pre-tokens never reach across it,
    so the ids of a text are those of its pre-tokens in order. Where a text is
    in composed form and of blocks whose characters have kept their classes and
    lower case since they were introduced, the pre-tokens are found here; what
    isn't known yet is encoded by one call, and the tokens that end a pre-token
    show where each ends. Other texts, and those with special strings, go to the
    library whole.
    """

    #: Latin, Cyrillic, punctuation, currency signs, kana, common ideographs. Left out: the dotted
    #: capital i, whose lower case is two characters.
    plain = re.compile("[\0-\u012f\u0131-\u024f\u0410-\u044f\u2010-\u2027\u2030-\u205e\u20a0-\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]*")

    def __init__(self, path: str, slots: int = pretokens.SLOTS):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        #: The same model for pre-tokens that are normalised and apart already.
        self.apart = Tokenizer.from_file(path)
        self.apart.no_padding()
        self.apart.no_truncation()
        self.apart.normalizer = normalizers.Sequence([])
        self.apart.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.lookup = pretokens.Lookup(pretokens.without_space, False, self._encode, slots)

    @staticmethod
    def _ids(library, text: str) -> np.ndarray:
        return np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode(self, strings: list[bytes]) -> list[np.ndarray]:
        found = self._ids(self.apart, b" ".join(strings).decode())
        return np.split(found, np.flatnonzero(self.ends[found])[:-1] + 1)

    def normal(self, text: str) -> bytes | None:
        """A text as the library normalises it, but for white space; none if that is left to the library."""
        if "<" in text and any(s in text for s in self.special):
            return None
        if not text.isascii() and not (self.plain.fullmatch(text) and unicodedata.is_normalized("NFC", text)):
            return None
        return text.lower().encode()

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        normal = [self.normal(t) for t in texts]
        found = iter(self.lookup.ids([x for x in normal if x is not None]))
        return [self._ids(self.library, t).tobytes() if x is None else next(found) for t, x in zip(texts, normal, strict=True)]


def tokenized_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every text.

    ``task`` and ``at`` number the pieces of each length within each task.
    """
    names = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "task": pa.int64(), "at": pa.int64()}

    def run(batches):
        encode = _tokenizers.get(path) or _tokenizers.setdefault(path, WordTokenizer(path))
        end, task, seen = end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in text_parts(batches, 1):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                packed = memoryview(ids + end)
                total = len(packed) // 4
                for piece, start in enumerate(range(0, total, capacity)):
                    part = packed[4 * start : 4 * (start + capacity)]
                    length = len(part) // 4
                    rows.append((doc_id, piece, start, length, zlib.crc32(part), task, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, names.values(), strict=True)], list(names))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, at long"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def assign(pieces: DataFrame, capacity: int) -> DataFrame:
    """Gives pieces with a ``length`` up to ``capacity`` their sequence_id and offset.

    Pieces of one length are alike to the plan. They are numbered by the tasks
    that made them (columns ``task`` and ``at``), and the tasks of a length
    follow one another, so no task ranks a length that many pieces have. What is
    broadcast is the plan: its rows follow the number of lengths, which the
    capacity bounds, not the pieces.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = places(plan(histogram, capacity))
    sizes = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # A length has a row for each task here, whatever the number of pieces.
    starts = sizes.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(starts, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("at")).alias("rank"))
    keys = slots[:, 0] << 40 | slots[:, 1] if len(slots) else slots[:, 0]
    shared = spark.sparkContext.broadcast((keys, slots))

    def run(batches):
        keys, slots = shared.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            _, lo, each, first, offset = slots[np.searchsorted(keys, length << 40 | rank, side="right") - 1].T
            nth, inside = np.divmod(rank - lo, each)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first + nth), pa.array(offset + inside * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return map_batches(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Packs whole documents into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. Documents longer than the capacity are cut into full pieces and a
    rest. A null or empty text is the end token alone, a null doc_id stays null.
    Repeated rows are packed each on their own, an empty table gives no rows,
    other columns are ignored.
    """
    pieces = stash(tokenized_pieces(docs, path, capacity, end_id), "pieces")
    return assign(pieces, capacity)
