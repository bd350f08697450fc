"""Byte-level BPE: the vocabulary, exact encoding by dynamic programming, decoding.

The encoder never runs the merge loop. It uses the fact that every prefix of a
pre-token has exactly one last token: token ``t`` is the last token of a prefix
iff it is a suffix of the prefix and it is compatible with the last token of
what precedes it. Compatible means that the two tokens, put side by side, would
have been left apart by the merges. Suffix matches come from an automaton over
the vocabulary, compatibility from undoing the merges along the border.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import pretokens
from lodestone.llm.common import Bounded

# Fixed value: the published pre-token pattern of the byte-level BPE family.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_char() -> dict[str, int]:
    """The printable stand-in characters of byte-level vocabularies, by rule.

    Printable Latin-1 bytes stand for themselves; the others get the code
    points from 256 on, in the order of their values.
    """
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Nothing(dict):
    """A dict in which any other key stands for no bytes."""

    def __missing__(self, key):
        return b""


class Vocabulary:
    """Tokens, merges and special strings of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_of_char()
        as_bytes = lambda s: bytes(chars[c] for c in s)
        self.tokens: dict[int, bytes] = {i: as_bytes(s) for s, i in model["vocab"].items()}
        self.ids: dict[bytes, int] = {b: i for i, b in self.tokens.items()}
        self.strings = Nothing(self.tokens)
        self.strings.update({t["id"]: t["content"].encode("utf-8") for t in spec["added_tokens"]})
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: rank of a merge and what it makes, by its pair of ids
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        #: the pair that makes a token
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            l_id, r_id = self.ids[as_bytes(left)], self.ids[as_bytes(right)]
            made = self.ids[as_bytes(left) + as_bytes(right)]
            self.merges[l_id, r_id] = (rank, made)
            self.parts.setdefault(made, (l_id, r_id))
        self.pattern = regex.compile(PRE_TOKEN)

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """The stretches of ordinary text and the special strings between them."""
        if not any(s in text for s in self.special):
            return [(text, None)]
        splitter = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        out, at = [], 0
        for m in splitter.finditer(text):
            out += [(text[at : m.start()], None), ("", self.special[m[0]])]
            at = m.end()
        return [*out, (text[at:], None)]

    def merge(self, piece: bytes) -> list[int]:
        """The merges of a pre-token: lowest rank first, leftmost among equals.

        Pairs wait in a heap and parts are linked to their neighbours, so a long
        unbroken run costs its length times a logarithm.
        """
        ids = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(self.merges[pair][0], i, *pair) for i in range(n - 1) if (pair := (ids[i], ids[i + 1])) in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:  # one of the two has changed since
                continue
            ids[i], ids[j] = self.merges[left, right][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (pair := (ids[a], ids[b])) in self.merges:
                    heapq.heappush(heap, (self.merges[pair][0], a, *pair))
        return [x for x in ids if x >= 0]


class PrefixEncoder:
    """Encodes pre-tokens by the last token of each of their prefixes."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for i, b in vocabulary.tokens.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.rank = {made: rank for rank, made in vocabulary.merges.values()}
        self.fits = Bounded(lambda pair: self._fits(*pair), 1_000_000)
        self.alone = Bounded(self._alone, 200_000)

    def _apart(self, left: int, right: int) -> bool:
        """True if the merges that made two adjacent tokens never crossed their border.

        They are undone from the last one back. Of two equal tokens the left one
        was made first, so the right one is undone first. In each state before
        the last, a merge across the border would have happened if it ranks
        before the merge that changed the border next, or equal to it when that
        was on the right, as the leftmost of equals goes first.
        """
        merges, parts, rank = self.v.merges, self.v.parts, self.rank
        while True:
            l_rank, r_rank = rank.get(left, -1), rank.get(right, -1)
            if l_rank < 0 and r_rank < 0:
                return True
            if l_rank > r_rank:
                bound, left = l_rank, parts[left][1]
            else:
                bound, right = r_rank + 1, parts[right][0]
            across = merges.get((left, right))
            if across is not None and across[0] < bound:
                return False

    def _fits(self, left: int, right: int) -> bool:
        """True if two adjacent tokens stay as they are."""
        return (left, right) not in self.v.merges and self._apart(left, right)

    def _alone(self, token: int) -> bool:
        """True if the bytes of a token encode as that token."""
        parts = self.v.parts.get(token)
        return parts is None or (self.alone[parts[0]] and self.alone[parts[1]] and self._apart(*parts))

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        n = len(piece)
        if n == 0:
            return []
        last: list[tuple[int, int] | None] = [None] * n  # the last token of each prefix and its length
        fits, alone = self.fits, self.alone
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            if last[end] is not None:
                continue
            start = end - size
            if start < 0:
                if alone[token]:
                    last[end] = (token, size)
            elif (before := last[start]) is not None and fits[before[0], token]:
                last[end] = (token, size)
        out, at = [], n - 1
        while at >= 0:
            token, size = last[at]
            out.append(token)
            at -= size
        return out[::-1]


_encoders: dict[str, tuple[Vocabulary, pretokens.Lookup]] = {}


def _loaded(path: str) -> tuple[Vocabulary, pretokens.Lookup]:
    """One vocabulary and table of pre-tokens for each worker process."""
    if path not in _encoders:
        vocabulary = Vocabulary(path)
        encoder = PrefixEncoder(vocabulary)
        encode = lambda pieces: [np.array(encoder.encode(p), np.uint32) for p in pieces]
        _encoders[path] = vocabulary, pretokens.Lookup(pretokens.with_leading_space, True, encode)
    return _encoders[path]


def encode_packed(texts: list[str], path: str) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit integers."""
    vocabulary, lookup = _loaded(path)
    segments = [vocabulary.segments(t) for t in texts]
    found = iter(lookup.ids([part.encode() for own in segments for part, special in own if special is None]))
    return [b"".join([next(found) if special is None else special.to_bytes(4, "little") for _, special in own]) for own in segments]


def decode(ids, path: str) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD.

    Ids outside the vocabulary stand for nothing, as in the tokenizers library.
    """
    return b"".join(map(_loaded(path)[0].strings.__getitem__, ids)).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes each whole text; one row per document.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256, and with
    ``keep_ids`` also the ids and the decoded text. A null text counts as
    empty: no token, the hash of nothing. Ids that are null or repeated are
    kept as they are, a text of any length is encoded whole, an empty table
    gives no rows and other columns are ignored.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep_ids

    def run(batches):
        for batch in batches:
            packed = encode_packed([t or "" for t in batch.column(1).to_pylist()], path)
            ids = [array("I", p) for p in packed]
            texts = [decode(i, path) for i in ids]
            columns = [
                batch.column(0).cast(pa.int64()),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array([i.tolist() for i in ids], pa.list_(pa.int64())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
