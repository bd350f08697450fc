"""Pre-tokens of whole texts, found and looked up an array at a time.

Texts are taken as UTF-8 bytes. The class of every byte's character (letter,
number, white space, other) gives the borders of the pre-tokens, so no regular
expression runs over a text. A pre-token of up to 15 bytes is two integers that
hold its bytes and its length: an exact key, which an open-addressed table
finds for all pre-tokens of a chunk at once. Only pre-tokens that the table
lacks reach the tokenizer's own code, each once for as long as it is held.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import regex

SPACE, LETTER, NUMBER, OTHER, END = range(5)
SEPARATOR = 0xFF  # no byte of any UTF-8 text
CHUNK = 1 << 20  # bytes that are taken together
SHORT = 15  # bytes of the longest pre-token that is a key of the table
SLOTS = 1 << 21
HELD_IDS = 1 << 24  # ids held before all is forgotten
LONG_BYTES = 1 << 22  # bytes of the longer pre-tokens that are remembered

_classes: list[np.ndarray] = []


def code_point_classes() -> np.ndarray:
    """The class of every code point, by the Unicode properties L, N and White_Space."""
    if not _classes:
        every = "".join(map(chr, range(0x110000)))
        out = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                out[m.start() : m.end()] = kind
        _classes.append(out)
    return _classes[0]


def byte_classes(b: np.ndarray) -> np.ndarray:
    """The class of the character of each byte; the bytes end with four separators."""
    known = code_point_classes()
    first = np.full(256, OTHER, np.uint8)
    first[:128] = known[:128]
    first[SEPARATOR] = END
    out = first[b]
    lead = np.flatnonzero((b >= 0xC0) & (b < 0xF8))
    if len(lead):
        x = b[lead].astype(np.int64)
        low = lambda k: b[lead + k].astype(np.int64) & 0x3F
        code = np.where(x < 0xE0, (x & 0x1F) << 6 | low(1), (x & 0x0F) << 12 | low(1) << 6 | low(2))
        four = x >= 0xF0
        if four.any():
            code = np.where(four, (x & 0x07) << 18 | low(1) << 12 | low(2) << 6 | low(3), code)
        kind = known[code]
        out[lead] = out[lead + 1] = kind
        for k, least in ((2, 0xE0), (3, 0xF0)):
            more = x >= least
            out[lead[more] + k] = kind[more]
    return out


def _contractions(b: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> None:
    """Joins 's, 't, 'm, 'd, 're, 've and 'll where their quote begins a pre-token."""
    quote = np.flatnonzero((b == 0x27) & begins)
    if not len(quote):
        return
    one, two = b[quote + 1], b[quote + 2]
    single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    double = ((two == 0x65) & ((one == 0x72) | (one == 0x76))) | ((one == 0x6C) & (two == 0x6C))
    for size, at in ((1, quote[single]), (2, quote[double])):
        begins[at + 1] = False
        begins[at + 1 + size] |= kind[at + 1 + size] == LETTER


def with_leading_space(b: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin that carry one space before them; other white space stands alone."""
    begins = np.ones(len(b), bool)
    begins[1:] = kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[1:] != END) & (kind[:-1] == SPACE)) + 1
    last = after - 1
    for _ in range(3):  # the first byte of the last white space
        last = last - ((b[last] & 0xC0) == 0x80)
    begins[last] = True
    begins[after[b[last] == 0x20]] = False
    _contractions(b, kind, begins)
    return begins


def without_space(b: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin if white space is dropped and every digit stands alone."""
    begins = np.ones(len(b), bool)
    begins[1:] = kind[1:] != kind[:-1]
    begins |= (kind == NUMBER) & ((b & 0xC0) != 0x80)
    _contractions(b, kind, begins)
    return begins


_CUT = re.compile(rb"[A-Za-z0-9](?=[ \n])")


def parts(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, cut only before a white space that follows a letter or digit.

    A pre-token begins there whatever stands before. Where there is no such
    place the part goes on to the next one.
    """
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size - 1)
        if found is None:
            break
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


#: Keeps the first bytes of sixteen.
SHORT_MASKS = np.zeros((SHORT + 1, 2), np.uint64)
for _n in range(SHORT + 1):
    SHORT_MASKS[_n] = np.frombuffer(b"\xff" * _n + b"\0" * (16 - _n), np.uint64)


class Lookup:
    """Ids of the pre-tokens of texts.

    ``encode`` gives the ids of a list of different pre-tokens (as bytes), each
    as an array of unsigned 32-bit integers. ``begins`` is one of the two rules
    above. What is held is bounded: the table, the ids and the longer
    pre-tokens, by their bytes. All is forgotten between two chunks when a
    bound is met, but for ``known``, pre-tokens that the table holds from the
    beginning.
    """

    def __init__(self, begins: Callable, keep_space: bool, encode: Callable[[list[bytes]], list[np.ndarray]], slots: int = SLOTS, known: list[bytes] = ()):
        self.begins, self.keep_space, self.encode, self.known = begins, keep_space, encode, list(known)
        self.shift, self.mask = np.uint64(64 - (slots.bit_length() - 1)), slots - 1
        self.forget()

    def forget(self) -> None:
        self.low, self.high = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.uint64)
        self.first, self.size = np.zeros(self.mask + 1, np.int32), np.zeros(self.mask + 1, np.int32)
        self.flat, self.used, self.n = np.zeros(1 << 16, np.uint32), 0, 0
        self.long: dict[bytes, tuple[int, int]] = {}
        self.long_bytes = 0
        if short := [w for w in self.known if 0 < len(w) <= SHORT]:
            keys = np.frombuffer(b"".join(w.ljust(15, b"\0") + bytes([len(w)]) for w in short), np.uint64).reshape(-1, 2)
            self._learn(np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1]))
        if longer := [w for w in self.known if len(w) > SHORT]:
            ends = np.cumsum([len(w) for w in longer])
            self._learn_long(b"".join(longer), np.concatenate([[0], ends[:-1]]), ends)

    def _append(self, ids: np.ndarray) -> tuple[int, int]:
        start, end = self.used, self.used + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[start:end] = ids
        self.used = end
        return start, len(ids)

    def _home(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (h >> self.shift).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, and which keys have none (their slot is then the free one)."""
        at = self._home(low, high)
        pending = np.flatnonzero((self.low[at] != low) | (self.high[at] != high))
        lacking = []
        while len(pending):
            taken = self.high[at[pending]] != 0  # a key's length is in its high part
            lacking.append(pending[~taken])
            pending = pending[taken]
            at[pending] = (at[pending] + 1) & self.mask
            slot = at[pending]
            pending = pending[(self.low[slot] != low[pending]) | (self.high[slot] != high[pending])]
        return at, np.concatenate(lacking) if lacking else pending

    def _learn(self, low: np.ndarray, high: np.ndarray) -> None:
        """Encodes the different keys and enters them."""
        keys = np.unique(np.column_stack([low, high]).view("V16").ravel()).view(np.uint64).reshape(-1, 2)
        raw = keys.tobytes()
        ids = self.encode([raw[16 * k : 16 * k + raw[16 * k + 15]] for k in range(len(keys))])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        start, _ = self._append(np.concatenate(ids))
        starts = start + np.cumsum(sizes) - sizes
        left = np.arange(len(keys))
        while len(left):  # of the keys that want one free slot the last one gets it
            at, lacking = self._find(keys[left, 0], keys[left, 1])
            left = left[lacking]
            at = at[lacking]
            self.low[at], self.high[at] = keys[left, 0], keys[left, 1]
            self.first[at], self.size[at] = starts[left], sizes[left]
        self.n += len(keys)

    def _learn_long(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
        found, lacking = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], {}
        here: dict[bytes, tuple[int, int]] = {}
        for w in found:
            if w not in self.long:
                lacking[w] = None
        for w, ids in zip(lacking, self.encode(list(lacking)) if lacking else (), strict=True):
            here[w] = self._append(ids)
            if self.long_bytes + len(w) <= LONG_BYTES:
                self.long[w] = here[w]
                self.long_bytes += len(w)
        at = [self.long.get(w) or here[w] for w in found]
        return [x[0] for x in at], [x[1] for x in at]

    def _chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each pre-token of some texts its place among the ids and their number, and the end of each text's pre-tokens."""
        if 2 * self.n > self.mask or self.used > HELD_IDS or self.long_bytes > LONG_BYTES // 2:
            self.forget()
        data = bytes([SEPARATOR]).join(texts) + bytes([SEPARATOR]) * 20
        b = np.frombuffer(data, np.uint8)
        kind = byte_classes(b)
        borders = np.flatnonzero(self.begins(b, kind))
        starts, ends = borders[:-1], borders[1:]
        first = kind[starts]
        keep = first != END if self.keep_space else (first != END) & (first != SPACE)
        starts, ends = starts[keep], ends[keep]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        text_ends = np.searchsorted(starts, np.cumsum(lengths + 1) - 1, side="left")
        size = ends - starts
        keys = np.lib.stride_tricks.sliding_window_view(b, 16)[starts].view(np.uint64)
        is_long = size > SHORT
        keys &= SHORT_MASKS[np.minimum(size, SHORT)]
        keys[:, 1] |= np.minimum(size, SHORT).astype(np.uint64) << np.uint64(56)
        long_at = np.flatnonzero(is_long)
        low, high = (keys[:, k] if not len(long_at) else keys[~is_long, k] for k in (0, 1))
        low, high = np.ascontiguousarray(low), np.ascontiguousarray(high)
        at, lacking = self._find(low, high)
        if len(lacking):
            self._learn(low[lacking], high[lacking])
            at[lacking] = self._find(low[lacking], high[lacking])[0]
        if not len(long_at):
            return self.first[at], self.size[at], text_ends
        place, count = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        place[~is_long], count[~is_long] = self.first[at], self.size[at]
        place[long_at], count[long_at] = self._learn_long(data, starts[long_at], ends[long_at])
        return place, count, text_ends

    def _chunks(self, texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
        """Texts in runs of about CHUNK bytes, with their numbers; longer texts come in parts."""
        run, numbers, size = [], [], 0
        for i, text in enumerate(texts):
            for part in parts(text, CHUNK):
                if run and size + len(part) > CHUNK:
                    yield numbers, run
                    run, numbers, size = [], [], 0
                run.append(part)
                numbers.append(i)
                size += len(part)
        if run:
            yield numbers, run

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Number of ids of each text."""
        out = np.zeros(len(texts), np.int64)
        for numbers, run in self._chunks(texts):
            _, count, ends = self._chunk(run)
            total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])[np.concatenate([[0], ends])]
            np.add.at(out, numbers, np.diff(total))
        return out

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        for numbers, run in self._chunks(texts):
            place, count, ends = self._chunk(run)
            done = np.cumsum(count, dtype=np.int64)
            at = np.repeat(place - (done - count), count) + np.arange(done[-1] if len(done) else 0)
            packed = memoryview(self.flat[at].astype("<u4").tobytes())
            limits = (4 * np.concatenate([[0], done])[np.concatenate([[0], ends])]).tolist()
            for i, a, z in zip(numbers, limits, limits[1:], strict=False):
                out[i].append(packed[a:z])
        return [b"".join(x) for x in out]
