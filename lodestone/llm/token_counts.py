"""Token counts: whole tokens are counted by look-up, the rest is merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import pretokens
from lodestone.llm.bpe import Vocabulary


def whole_tokens(vocabulary: Vocabulary) -> frozenset[bytes]:
    """The vocabulary strings proven to encode alone as one token.

    The proof runs the merges on the bytes of every vocabulary string. A token
    that merges do not reach from its own bytes, or that is no valid UTF-8, is
    left out and is then merged like any other pre-token.
    """
    proven = set()
    for token, b in vocabulary.tokens.items():
        try:
            b.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if vocabulary.merge(b) == [token]:
            proven.add(b)
    return frozenset(proven)


_counters: dict[str, tuple[Vocabulary, pretokens.Lookup]] = {}


def _counter(path: str, whole: frozenset[bytes]) -> tuple[Vocabulary, pretokens.Lookup]:
    """One vocabulary and table of pre-tokens for each worker process.

    The table holds the proven whole tokens before any text is read, so that a
    pre-token which is one is matched and counted directly; what the table lacks
    is merged, and then kept in it beside them.
    """
    if path not in _counters:
        vocabulary = Vocabulary(path)
        encode = lambda pieces: [np.array([vocabulary.ids[p]] if p in whole else vocabulary.merge(p), np.uint32) for p in pieces]
        _counters[path] = vocabulary, pretokens.Lookup(pretokens.with_leading_space, True, encode, known=sorted(whole))
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """Tokens of each whole text; one row per document.

    Returns doc_id, n_bytes (of the UTF-8 text), n_tokens and over_limit
    (n_tokens > ``limit``). A null text counts as empty, an empty one has no
    tokens, and a text of any length is counted whole. Special strings inside a
    text count as one token each. Repeated rows are counted each by itself, a
    null doc_id stays null, an empty table gives no rows and other columns are
    ignored. What is broadcast is the set of whole tokens, bounded by the
    vocabulary.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(Vocabulary(path)))

    def run(batches):
        vocabulary, lookup = _counter(path, whole.value)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            segments = [vocabulary.segments(t) for t in texts]
            found = iter(lookup.counts([part.encode() for own in segments for part, special in own if special is None]).tolist())
            counts = [sum(next(found) if special is None else 1 for _, special in own) for own in segments]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([c > limit for c in counts], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
