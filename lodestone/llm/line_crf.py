"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. The potentials of a line come from its own measures
and from those of the lines before and after it; a transition matrix ties
neighbours. Forward-backward gives the probability that a line is good, and the
mean of these, weighted by the lengths of the lines, is the quality of the
document, which a logistic curve then turns into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from lodestone.llm.common import WORD, held_out, labelled_sample, map_batches, quoted, text_parts

CHUNK_CHARS = 1 << 20  # characters whose lines are measured together
LONGEST_CHAIN = 4096  # lines of the longest document that the chain is learned from; scoring takes all
CELLS = 1 << 20  # of the padded chains that are scored together
BINS = 8

_SPACE, _UPPER, _DIGIT, _BAR, _MARK, _SYMBOL, _STOP, _OTHER, _LETTER = range(9)
MEASURES = ("words", "word_length", "upper", "digits", "bars", "marks", "symbols", "stops", "others", "distinct", "repeated", "as_before")
_WORDS, _CHARS = 0, len(MEASURES)  # the column of words, and of characters, which follows the measures


def _kinds() -> np.ndarray:
    """The kind of each code point below 0x300; those above are letters."""
    out = np.full(0x301, _LETTER, np.int64)
    for i in range(0x300):
        c = chr(i)
        if i == 32 or 9 <= i <= 13:
            out[i] = _SPACE
        elif c in "|":
            out[i] = _BAR
        elif c in "!":
            out[i] = _MARK
        elif c in "#*$%&<>@^~=_+{}[]\\":
            out[i] = _SYMBOL
        elif c in ".,;:?":
            out[i] = _STOP
        elif c.isdigit():
            out[i] = _DIGIT
        elif c.isupper():
            out[i] = _UPPER
        elif not c.isalpha():
            out[i] = _OTHER
    return out


_KINDS = _kinds()
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_CHARS)
        _powers["up"] = np.cumprod(np.full(size, _P, np.uint64))
        _powers["down"] = np.cumprod(np.full(size, _P_INVERSE, np.uint64))
    return _powers["up"], _powers["down"]


def _run_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each run of values, whatever its place; zeros count for nothing."""
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power_tables(len(values))
    out = np.add.reduceat(values * up[: len(values)], starts) * down[starts]
    return out ^ (out >> np.uint64(29))


def _by_characters(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each kind of character with words and different words behind them, and a hash, of every line of a string."""
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(chars == 10)
    n = len(ends)
    starts = np.concatenate([[0], ends[:-1] + 1])
    line = np.repeat(np.arange(n), np.diff(np.append(starts, len(chars))))
    kind = _KINDS[np.minimum(chars, 0x300)]
    counts = np.bincount(line * 9 + kind, minlength=9 * n).reshape(n, 9).astype(np.float64)

    solid = kind != _SPACE
    word_starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    values = chars.astype(np.uint64) + np.uint64(1)
    values[~solid] = 0
    word_line = line[word_starts]
    words = np.bincount(word_line, minlength=n).astype(np.float64)
    mixed = _run_hashes(values, word_starts) * np.uint64(0xFF51AFD7ED558CCD) + word_line.astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53)
    _, first = np.unique(mixed, return_index=True)
    distinct = np.bincount(word_line[first], minlength=n).astype(np.float64)
    return np.column_stack([counts, words, distinct]), _run_hashes(values, starts)


def _by_parts(line: str) -> tuple[np.ndarray, np.ndarray]:
    """What ``_by_characters`` finds for one line of any length, from its parts; memory follows a part and the different words."""
    counts, words, solid_before = np.zeros(9), 0, False
    total, power = 0, 1
    for at in range(0, len(line), CHUNK_CHARS):
        chars = np.frombuffer(line[at : at + CHUNK_CHARS].encode("utf-32-le"), np.uint32)
        kind = _KINDS[np.minimum(chars, 0x300)]
        counts += np.bincount(kind, minlength=9)
        solid = kind != _SPACE
        words += int((solid & ~np.concatenate([[solid_before], solid[:-1]])).sum())
        solid_before = bool(solid[-1])
        values = np.where(solid, chars.astype(np.uint64) + np.uint64(1), np.uint64(0))
        up, _ = _power_tables(len(values))
        total = (total + int((values * up[: len(values)]).sum()) * power) % (1 << 64)
        power = power * pow(int(_P), len(values), 1 << 64) % (1 << 64)
    distinct = len({hash(m[0]) for m in WORD.finditer(line)})
    counts[_SPACE] += 1  # the line's end
    content = total * int(_P_INVERSE) % (1 << 64)
    return np.array([[*counts, words, distinct]], np.float64), np.array([content ^ (content >> 29)], np.uint64)


def measure(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The measures of all lines of some texts, and the number of lines of each text.

    Characters are taken in runs of whole lines, and a line that is longer than
    a run in parts, so a very long text costs memory for its lines only.
    """
    joined = "\n".join(texts) + "\n"
    lines_of = np.array([t.count("\n") + 1 for t in texts], np.int64)
    parts, at = [], 0
    while at < len(joined):
        end = len(joined) if len(joined) - at <= 2 * CHUNK_CHARS else joined.rfind("\n", at, at + 2 * CHUNK_CHARS) + 1
        if end:
            parts.append(_by_characters(joined[at:end]))
        else:
            end = joined.index("\n", at) + 1
            parts.append(_by_parts(joined[at : end - 1]))
        at = end
    table, content = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    counts, words, distinct = table[:, :9], table[:, 9], table[:, 10]

    owner = np.repeat(np.arange(len(texts)), lines_of).astype(np.uint64)
    _, inverse, times = np.unique(content * np.uint64(0xFF51AFD7ED558CCD) + owner * np.uint64(0xC4CEB9FE1A85EC53), return_inverse=True, return_counts=True)
    repeated = (times[inverse] >= 3) & (words > 0)  # a heading that closes a text again is no fault
    as_before = np.concatenate([[False], (content[1:] == content[:-1]) & (owner[1:] == owner[:-1])]) & (words > 0)

    chars = counts[:, 1:].sum(axis=1)
    size, w = np.maximum(chars, 1), np.maximum(words, 1)
    out = np.column_stack(
        [
            words,
            chars / w,
            counts[:, _UPPER] / size,
            counts[:, _DIGIT] / size,
            counts[:, _BAR] / w,
            counts[:, _MARK] / w,
            counts[:, _SYMBOL] / w,
            counts[:, _STOP] / w,
            counts[:, _OTHER] / w,
            distinct / w,
            repeated,
            as_before,
            chars,
        ]
    )
    return out, lines_of


def _with_neighbours(bins: np.ndarray, lines_of: np.ndarray) -> np.ndarray:
    """Bins of each line, the line before and the line after, as columns of one table of weights."""
    width = bins.shape[1]
    none = np.full((1, width), BINS)  # no such line
    before, after = np.concatenate([none, bins[:-1]]), np.concatenate([bins[1:], none])
    first = np.concatenate([[0], np.cumsum(lines_of)[:-1]])[lines_of > 0]
    last = np.cumsum(lines_of)[lines_of > 0] - 1
    before[first], after[last] = BINS, BINS
    stacked = np.concatenate([bins, before, after], axis=1)
    return stacked + np.arange(3 * width) * (BINS + 1)


def _padded(values: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of chains, padded with zeros, and which cells are lines."""
    real = np.arange(lengths.max())[None, :] < lengths[:, None]
    out = np.zeros(real.shape + values.shape[1:])
    out[real] = values[np.concatenate([np.arange(s, s + k) for s, k in zip(starts, lengths, strict=True)])]
    return out, real


def _moved(p: np.ndarray, move: np.ndarray) -> np.ndarray:
    """``p @ move`` for two states, whose digits don't depend on the number of rows."""
    return np.stack([p[:, 0] * move[0, 0] + p[:, 1] * move[1, 0], p[:, 0] * move[0, 1] + p[:, 1] * move[1, 1]], axis=1)


def forward_backward(unary: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and the expected transitions, summed over all chains.

    ``unary`` holds the log odds of good of all lines, chain after chain.
    Chains of similar length are padded and taken together.
    """
    starts = np.cumsum(lengths) - lengths
    good, expected = np.zeros(len(unary)), np.zeros((2, 2))
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    move = np.exp(transition)
    while len(order):
        many = max(1, min(len(order), 512, CELLS // int(lengths[order[min(len(order), 512) - 1]])))
        take, order = order[:many], order[many:]
        n = lengths[take]
        odds, real = _padded(unary, n, starts[take])
        local = np.stack([np.ones_like(odds), np.exp(np.clip(odds, -30, 30))], axis=2)
        local /= local.sum(axis=2, keepdims=True)
        steps = odds.shape[1]
        ahead, back = np.empty_like(local), np.empty_like(local)
        ahead[:, 0] = local[:, 0]
        for t in range(1, steps):
            x = _moved(ahead[:, t - 1], move) * local[:, t]
            ahead[:, t] = np.where(real[:, t, None], x / x.sum(axis=1, keepdims=True), ahead[:, t - 1])
        back[:, -1] = 1
        for t in range(steps - 2, -1, -1):
            x = _moved(back[:, t + 1] * local[:, t + 1], move.T)
            back[:, t] = np.where(real[:, t + 1, None], x / x.sum(axis=1, keepdims=True), 1)
        p = ahead * back
        p /= p.sum(axis=2, keepdims=True)
        good[np.concatenate([np.arange(s, s + k) for s, k in zip(starts[take], n, strict=True)])] = p[:, :, 1][real]
        if steps > 1:
            both = ahead[:, :-1, :, None] * move * (local[:, 1:] * back[:, 1:])[:, :, None, :]
            both /= both.sum(axis=(2, 3), keepdims=True)
            expected += both[real[:, 1:]].sum(axis=0)
    return good, expected


@dataclass
class Model:
    cuts: np.ndarray  # of each measure, BINS - 1 increasing bounds
    weights: np.ndarray
    transition: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    @property
    def learned(self) -> bool:
        """False for the model of labels that don't hold both classes: it can't tell documents apart."""
        return bool(self.weights.any())

    def bins(self, measures: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, measures[:, k], side="left") for k, c in enumerate(self.cuts)])

    def lines(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) and the length of all lines, and the number of lines of each text."""
        measures, lines_of = measure(texts)
        unary = self.weights[_with_neighbours(self.bins(measures[:, :_CHARS]), lines_of)].sum(axis=1)
        return forward_backward(unary, lines_of, self.transition)[0], measures[:, _CHARS], lines_of

    def quality(self, texts: list[str]) -> np.ndarray:
        """Mean P(good) of each text's lines by their lengths; 0 for texts without words."""
        good, size, lines_of = self.lines(texts)
        # Each text by itself, so that its score doesn't depend on its neighbours; every text has a line.
        total = lambda x: np.add.reduceat(x, np.cumsum(lines_of) - lines_of)
        whole = total(size)
        return np.where(whole > 0, total(good * size) / np.maximum(whole, 1), 0.0)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.quality(texts) + self.shift, -30, 30)))


def chunks(texts: list[str]) -> Iterator[list[str]]:
    """Texts in runs of about CHUNK_CHARS characters; a longer text stands alone."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > CHUNK_CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def _fit_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Weighted logistic regression on one input by Newton steps with a small ridge."""
    beta = np.zeros(2)
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (w * (y - p)) - 0.01 * beta
        curve = (design * (w * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def _ascend(model: Model, x: np.ndarray, y: np.ndarray, chains: np.ndarray, steps: int) -> None:
    """Adam on the penalised log-likelihood of the lines' labels."""
    starts = np.cumsum(chains) - chains
    inner = np.ones(len(y), bool)
    inner[starts[chains > 0]] = False
    pairs = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[pairs - 1].astype(int), y[pairs].astype(int)), 1)
    params = np.concatenate([model.weights, model.transition.ravel()])
    m, v = np.zeros_like(params), np.zeros_like(params)
    k = len(model.weights)
    for step in range(1, steps + 1):
        good, expected = forward_backward(params[:k][x].sum(axis=1), chains, params[k:].reshape(2, 2))
        slope = np.concatenate([np.bincount(x.ravel(), np.repeat(y - good, x.shape[1]), minlength=k), (seen - expected).ravel()]) / len(y) - 1e-4 * params
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        params = params + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.weights, model.transition = params[:k], params[k:].reshape(2, 2)


def fit(texts: list[str], labels: list[int], rounds: int = 2, steps: int = 80) -> Model:
    """A model from labelled documents.

    Lines start with the label of their document. After each round, lines of bad
    documents that the model finds good become good, as a bad document may hold
    good lines, unless that leaves it without a bad line. Chains are whole
    documents; those of more than LONGEST_CHAIN lines are passed over where
    shorter ones of both classes are there. Without documents of both classes
    every score is 0.5.
    """
    short = [t.count("\n") < LONGEST_CHAIN for t in texts]
    if {y for y, s in zip(labels, short, strict=True) if s} == {0, 1}:
        texts, labels = [t for t, s in zip(texts, short, strict=True) if s], [y for y, s in zip(labels, short, strict=True) if s]
    y_doc = np.array(labels, np.float64)
    empty = Model(np.zeros((_CHARS, BINS - 1)), np.zeros(3 * _CHARS * (BINS + 1)), np.zeros((2, 2)), 0.0, 0.0)
    if not texts or y_doc.min() == y_doc.max():
        return empty
    parts = [measure(c) for c in chunks(texts)]
    measures, lines_of = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    values = measures[measures[:, _WORDS] > 0][:, :_CHARS]
    model = Model(np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(values) else empty.cuts, empty.weights.copy(), np.zeros((2, 2)))
    x = _with_neighbours(model.bins(measures[:, :_CHARS]), lines_of)
    owner = np.repeat(np.arange(len(texts)), lines_of)
    chains = lines_of  # whole documents
    y = y_doc[owner].copy()
    for r in range(rounds):
        _ascend(model, x, y, chains, steps)
        if r + 1 < rounds:
            good = forward_backward(model.weights[x].sum(axis=1), chains, model.transition)[0]
            better = (good > 0.5) & (y_doc[owner] == 0)
            left = np.bincount(owner, (~better & (y_doc[owner] == 0)), minlength=len(texts))
            y = np.where(better & (left[owner] > 0), 1.0, y_doc[owner])
    quality = np.concatenate([model.quality(c) for c in chunks(texts)])
    balance = np.where(y_doc == 1, 0.5 / y_doc.mean(), 0.5 / (1 - y_doc.mean()))
    model.scale, model.shift = _fit_curve(quality, y_doc, balance)
    return model


def fit_on(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> Model:
    """A model from at most ``per_class`` training documents of each quality."""
    rows = labelled_sample(docs, labels, "quality", per_class).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return fit([r["text"] for r in rows], [r["y"] for r in rows])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` with the score as ``name``; a column of that name, in any case, is replaced.

    Scores use the text alone. Null and empty texts, and those without words,
    have the quality 0 and so the lowest score. Repeated rows have equal scores;
    a text or line of any length is scored whole; an empty table gives no rows.
    """
    own = [c for c in docs.columns if c.lower() != name.lower()]
    plain = docs.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(own)))  # names may hold dots
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers
    at = own.index("text")

    def run(batches):
        for batch in text_parts(batches, at):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found = np.concatenate([shared.value.scores(c) for c in chunks(texts)]) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "score"])

    return map_batches(plain, run, StructType([*plain.schema.fields]).add("score", DoubleType())).toDF(*own, name)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, per_class: int = 1500) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    A row of ``docs`` gives a row. Null and empty texts and those without words
    have the lowest score; repeated rows have equal scores; a null doc_id stays
    null and is not held out; an empty table gives no rows; other columns are
    ignored. Without labels of both classes every score is 0.5.
    """
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit_on(docs, labels, per_class))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
