"""Toxicity by compression distance with two trained zstandard dictionaries.

One dictionary is trained on ordinary texts, the other on toxic texts, whose
words that hold nothing but what ordinary text holds as well are left out first:
toxic texts are ordinary ones for the most part, and a dictionary of whole ones
tells them apart hardly at all (measured, see the README). Every window of a
text is compressed with each of the two. Calibration turns the length of a
window, what the toxic dictionary saves of it and the difference of the two
compressed lengths into evidence, and the windows of a document into its score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, Bounded, held_out, labelled_sample

GRAMS = (4, 5, 6, 7, 8, 10)  # bytes of the grams that find distinctive passages
LEAST = 3  # toxic texts that must hold a gram
CHANCE = 1e-3  # bound of the probability that a gram as common in both kinds would fall so
CONTRAST = 16.0  # times as often in toxic as in ordinary texts
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 8_192
LEVEL = 12  # lower levels miss the short matches that windows are made of
#: Both dictionaries end with it and every window starts with it, so that a window
#: of any length is compressed rather than stored, and lengths can be compared.
ANCHOR = b"#=start of the window=#"
#: Ends every window: the last bytes of an input are never matched.
TAIL = b"\0" * 9
#: The calibration's places: bytes of a window, bytes that the toxic dictionary saves, and the
#: difference of the compressed lengths, each up to a largest value that those beyond share.
LONGEST, MOST_SAVED, APART = 14, 19, 8
STRONGEST = np.array([1.0, 0.7, 0.5, 0.4, 0.3, 0.3])  # weights of the windows that speak most for toxic text

_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(max(GRAMS))], np.uint64)


def windows(text: str, size: int) -> list[bytes]:
    """Consecutive windows of ``size`` words, with a space at both ends."""
    words = WORD.findall(text)
    return [(" " + " ".join(words[i : i + size]) + " ").encode("utf-8") for i in range(0, len(words), size)]


def unlike(texts: list[str], most: float = 0.3) -> list[str]:
    """Texts without those that mostly repeat earlier ones: copies prove nothing anew."""
    seen: set[tuple[str, ...]] = set()
    out = []
    for t in texts:
        words = WORD.findall(t)
        runs = {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))}
        if len(runs & seen) <= most * len(runs):
            out.append(t)
        seen |= runs
    return out


def _gram_values(text: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams of a size, and which of them lie within a word and its spaces."""
    b = np.frombuffer(text, np.uint8)
    n = len(b) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    wide = b.astype(np.uint64) + np.uint64(1)
    spaces = np.concatenate([[0], np.cumsum(b == 32)])
    return sum(wide[i : i + n] * _WEIGHTS[i] for i in range(size)), spaces[size - 1 : size - 1 + n] == spaces[1 : n + 1]


def _spaced(text: str) -> bytes:
    return (" " + " ".join(WORD.findall(text)) + " ").encode("utf-8")


def distinctive(toxic: list[str], ordinary: list[str]) -> dict[int, np.ndarray]:
    """Grams, by size, that occur in toxic texts and significantly less often in ordinary ones.

    The bound is Chernoff's of the binomial tail: it asks for a number of texts
    that doesn't grow with the labels, so that what few toxic texts share, as
    those of a rare language, is learned too.
    Grams across words are left out, so that passages hold no neighbours by chance.
    """

    def shares(texts, size):
        held = []
        for t in texts:
            values, inside = _gram_values(_spaced(t), size)
            held.append(np.unique(values[inside]))
        return np.unique(np.concatenate(held or [np.empty(0, np.uint64)]), return_counts=True)

    out = {}
    for size in GRAMS:
        grams, hits = shares(toxic, size)
        known, misses = shares(ordinary, size)
        at = np.minimum(np.searchsorted(known, grams), max(len(known) - 1, 0))
        other = np.where(known[at] == grams, misses[at], 0) if len(known) else np.zeros(len(grams))
        ratio = ((hits + 0.5) / (len(toxic) + 1)) / ((other + 0.5) / (len(ordinary) + 1))
        n, expected = hits + other, len(toxic) / (len(toxic) + len(ordinary))
        # In nats, how far the toxic part of the texts with the gram is from the expected one; 0 log 0 is 0.
        apart = hits * np.log(hits / n / expected) + other * np.log(np.maximum(other, 1) / n / (1 - expected))
        out[size] = grams[(hits >= LEAST) & (apart >= -np.log(CHANCE)) & (ratio >= CONTRAST)]
    return out


def passages(text: str, grams: dict[int, np.ndarray]) -> list[bytes]:
    """The words of a text, with their spaces, that hold distinctive grams."""
    b = _spaced(text)
    covered = np.zeros(len(b) + 1, np.int64)
    for size, known in grams.items():
        values, inside = _gram_values(b, size)
        covered[np.flatnonzero(inside & np.isin(values, known)) + 1] = 1
    spaces = np.flatnonzero(np.frombuffer(b, np.uint8) == 32)
    hit = np.add.reduceat(covered, spaces) > 0 if len(spaces) else []
    return [b[spaces[k] : spaces[k + 1] + 1] for k in np.flatnonzero(hit).tolist() if k + 1 < len(spaces)]


def train_dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a zstandard dictionary of samples, always ``size`` bytes.

    Frequent samples that the training left out stand before it as far as there
    is room, and zeros before these: with a fixed size the cost of a match
    doesn't depend on how much there was to learn. Samples that make less than
    the size are taken as they are.
    """
    long_enough = [s for s in samples if len(s) >= 8]
    content = b""
    if len(long_enough) >= 10 and sum(map(len, long_enough)) >= size:
        content = zstandard.train_dictionary(size, long_enough, k=segment, d=6).as_bytes()[-size:]
    for sample, _ in sorted(Counter(p for s in samples for p in s.split(b"\n")).items(), key=lambda x: (-x[1], x[0])):
        if len(content) + len(sample) > size:
            break
        if sample not in content:
            content = sample + content
    return content.rjust(size, b"\0")


def compressed_length(content: bytes):
    """A function that gives the length of a window compressed with a dictionary."""
    known = zstandard.ZstdCompressionDict(content + ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    return lambda window: len(compress(ANCHOR + window + TAIL))


@dataclass
class Model:
    window: int
    ordinary: bytes
    toxic: bytes
    #: evidence of a window by its place
    evidence: np.ndarray = field(default_factory=lambda: np.zeros((LONGEST + 1, MOST_SAVED + 1, 2 * APART + 1)))
    slope: float = 0.0
    shift: float = 0.0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _lengths(self):
        if not hasattr(self, "_compressed"):
            by_ordinary, by_toxic = compressed_length(self.ordinary), compressed_length(self.toxic)
            self._compressed = by_ordinary, by_toxic, by_toxic(b"")
        return self._compressed

    def _first_place(self, window: bytes) -> tuple[int, int, int]:
        """Length and saved bytes of a window in the calibration, and its length compressed by the toxic dictionary."""
        _, by_toxic, nothing = self._lengths()
        two, size = by_toxic(window), len(window) - 2
        return min(size // self.window, LONGEST), min(max(size - (two - nothing), 0), MOST_SAVED), two

    def _last_place(self, window: bytes, two: int) -> int:
        return min(max(self._lengths()[0](window) - two, -APART), APART) + APART

    def cell(self, window: bytes) -> int:
        """The place of a window in the calibration."""
        size, saved, two = self._first_place(window)
        return int(np.ravel_multi_index((size, saved, self._last_place(window, two)), self.evidence.shape))

    def cells(self, text: str) -> np.ndarray:
        """For each different window its place in the calibration."""
        if not hasattr(self, "_memo"):
            self._memo = Bounded(self.cell, 300_000)
        return np.fromiter(map(self._memo.__getitem__, set(windows(text, self.window))), np.int64)

    def _evidence(self):
        """The evidence of windows; where no difference of lengths would speak for toxic text, the second isn't measured."""
        if not hasattr(self, "_known"):
            most = self.evidence.max(axis=2)

            def evidence(window: bytes) -> float:
                size, saved, two = self._first_place(window)
                return max(float(self.evidence[size, saved, self._last_place(window, two)]), 0.0) if most[size, saved] > 0 else 0.0

            self._known = Bounded(evidence, 500_000)
        return self._known

    @staticmethod
    def weigh(evidence: np.ndarray) -> float:
        """The evidence of the windows that speak most for toxic text, the strongest counting most."""
        strongest = np.sort(np.maximum(evidence, 0))[::-1][: len(STRONGEST)]
        return float(strongest @ STRONGEST[: len(strongest)])

    def score(self, text: str) -> float:
        found = np.fromiter(map(self._evidence().__getitem__, set(windows(text, self.window))), np.float64)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.weigh(found) + self.shift, -30, 30)))


def _dictionaries(toxic: list[str], ordinary: list[str], window: int) -> Model:
    toxic, ordinary = unlike(toxic), unlike(ordinary)
    grams = distinctive(toxic, ordinary)
    samples = [b"\n".join(p) for t in toxic if (p := passages(t, grams))]
    return Model(window, train_dictionary([w for t in ordinary for w in windows(t, 8)], ORDINARY_BYTES, 50), train_dictionary(samples, TOXIC_BYTES, 24))


def fit(toxic: list[str], ordinary: list[str], window: int = 1, prior: float = 0.5, folds: int = 3) -> Model:
    """A model from toxic and ordinary texts.

    Each fold is measured with dictionaries trained on the others, so that the
    calibration is of texts that the dictionaries don't know; the final ones are
    trained on all texts. The evidence of a window is the log ratio of the
    shares of toxic and ordinary texts that hold such a window. ``prior`` is the
    share of toxic texts that the scores are for. Without texts of both kinds
    every score is 0.
    """
    if not toxic or not ordinary:
        return Model(window, b"", b"", shift=-30.0)
    part = lambda xs, k, own: [x for i, x in enumerate(xs) if (i % folds == k) == own] or xs
    held: list[tuple[int, np.ndarray]] = []
    for k in range(folds):
        trial = _dictionaries(part(toxic, k, False), part(ordinary, k, False), window)
        held += [(y, trial.cells(t)) for y, texts in ((1, toxic), (0, ordinary)) for t in part(texts, k, True)]
    model = _dictionaries(toxic, ordinary, window)
    y = np.array([v for v, _ in held], np.float64)
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    counts = np.zeros((2, model.evidence.size))
    for v, cells in held:
        counts[v, np.unique(cells)] += 1
    evidence = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
    model.evidence = np.where(counts.sum(axis=0) >= 4, evidence, 0).reshape(model.evidence.shape)  # few texts tell nothing
    x = np.array([model.weigh(model.evidence.ravel()[cells]) for _, cells in held])
    weight = np.where(y == 1, prior / n[1], (1 - prior) / n[0]) * len(y)
    model.slope, model.shift = _curve(x, y, weight)
    return model


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one input by Newton steps with a small ridge."""
    beta, design = np.zeros(2), np.column_stack([x, np.ones(len(x))])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (w * (y - p)) - 0.01 * beta
        curve = (design * (w * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.clip(np.linalg.solve(curve, slope), -3, 3)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def fit_on(docs: DataFrame, labels: DataFrame, per_class: int = 2000, window: int = 1) -> Model:
    """A model from at most ``per_class`` training documents, toxic and not."""
    rows = labelled_sample(docs, labels, "toxic", per_class).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    toxic, ordinary = ([r["text"] for r in rows if r["y"] == y] for y in (1, 0))
    share = labels.where(F.col("toxic").isin(0, 1) & ~held_out("doc_id")).agg(F.avg("toxic").alias("share")).first()["share"]
    return fit(toxic, ordinary, window, min(max(share or 0.5, 0.02), 0.98))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 2000) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Scores use the text alone, all windows of it, whatever its length. Null and
    empty texts, and those without words, have no window and the lowest score.
    Repeated rows have equal scores; a null doc_id stays null and is not held
    out; an empty table gives no rows; other columns are ignored. Where the
    labels hold one class only, or none, nothing is learned and all documents
    score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_on(docs, labels, per_class))  # two dictionaries of fixed size

    def run(batches):
        for batch in batches:
            found = [float(shared.value.score(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    scored = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
