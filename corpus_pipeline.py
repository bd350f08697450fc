"""From raw documents to packed training sequences.

Four stages, each a table that the next one reads: the quality classifier and
the quality rules drop documents, the n-gram Jaccard join leaves one document of
each group of near copies, and packing lays the rest out in sequences.

The filtering stages return the columns of their input, whatever these are
called. All stages return no rows for an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import line_crf, ngram_join, packing, rules
from lodestone.llm.common import fresh, quoted, stash, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the line model scores below 0.7.

    Null and empty texts and those without words have the lowest score. Where
    the labels don't hold both classes there is nothing to tell documents apart
    by, and all stay.
    """
    model = line_crf.fit_on(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    if not model.learned:
        return docs
    score = fresh(docs, "score")
    return line_crf.score(docs, model, score).where(F.col(score) >= 0.7).select(*map(quoted, docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base test or a learned rule rejects.

    The rules are learned on the raw table: what the stage before left holds too
    few bad documents to learn from. Null and empty texts fail the base test; a
    null doc_id changes nothing, and repeated rows are judged each by itself.
    """
    learned = rules.learn_from(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rules.keep(docs, learned)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of near copies.

    Of rows that repeat a doc_id and text one stays. A doc_id with different
    texts is one document and keeps a row for each of them, or none. Texts
    without words are no copies of each other.
    """
    judged = ngram_join.jaccard_join(docs).groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("rows"))
    name = fresh(docs, "kept_id")
    kept = stash(judged.where("kept").select(F.col("doc_id").alias(name), "rows"), "kept-ids")
    # The ids grow with the documents, so they are never broadcast.
    of = lambda ids: docs.join(ids.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")
    repeated = kept.where("rows > 1").drop("rows")
    if repeated.isEmpty():  # spares a second pass over the texts
        return of(kept.drop("rows"))
    return of(kept.where("rows = 1").drop("rows")).unionByName(of(repeated).dropDuplicates(["doc_id", "text"]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 4096 tokens; every row is packed.

    A null doc_id stays null, and rows that repeat are packed each by itself; a
    null or empty text is one piece, of the end token alone.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("pack", pack),
]

#: Learned stages and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(docs, name)
    return docs
