"""What the operators share: tables in the shared folder, folds and words."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but the space and the ASCII controls tab to carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_SQL = r"[^\x20\x09-\x0D]+"

_written: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and
    the session runs on one machine (as in tests) a local folder stands in.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or f"file://{tempfile.gettempdir()}/lodestone-shared").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clean)
    _written.append((spark, path))
    return path


def clean() -> None:
    """Removes the tables written in the shared folder so far."""
    while _written:
        spark, path = _written.pop()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session has already ended
            return


def remove(spark: SparkSession, path: str) -> None:
    """Removes a table of the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stash_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stash`` with the table's path, for those who remove it once its readers are done."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it again.

    This cuts the lineage: a lost executor costs a read, not the work above,
    and what is numbered or sampled stays as it was written.
    """
    return stash_at(df, name)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> F.Column:
    """The column of a name that may hold dots or backquotes."""
    return F.col(f"`{name.replace('`', '``')}`")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` has not, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def held_out(doc_id) -> F.Column:
    """True for the fold that no model learns from: crc32 of the id's text mod 4 is 2."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, class_bytes: int = 1 << 25) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` training documents and ``class_bytes`` of text a class.

    Documents are taken in the order of a hash of the id, outside the held-out
    fold, with a label of 0 or 1. The ids are at most ``2 * per_class``, which
    bounds what is broadcast. Repeated labels of a document count once, the
    largest wins; of several texts of one id the least counts. A text that
    doesn't fit in what is left of the bytes is passed over, and texts of more
    than a sixteenth of them come after all others.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    ids = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.col("text").isNotNull()).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    # One list a class, of at most per_class entries without texts, is gone through in order.
    size, large = F.octet_length("text"), F.octet_length("text") > class_bytes // 16
    queue = found.groupBy("y").agg(F.sort_array(F.collect_list(F.struct(large.alias("large"), F.xxhash64("doc_id").alias("h"), "doc_id", size.cast("long").alias("size")))).alias("queue"))
    start = F.struct(F.lit(class_bytes).cast("long").alias("left"), F.array().cast("array<bigint>").alias("taken"))
    take = lambda a, x: F.when(x["size"] <= a["left"], F.struct((a["left"] - x["size"]).alias("left"), F.concat(a["taken"], F.array(x["doc_id"].cast("long"))).alias("taken"))).otherwise(a)
    taken = queue.select("y", F.explode(F.aggregate("queue", start, take)["taken"]).alias("doc_id"))
    return found.join(F.broadcast(taken), ["y", "doc_id"], "left_semi").select("doc_id", "text", "y")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row, from 0, in an order that leaves no ties.

    ``order`` names columns, ``-`` before a name turns it round. Rows are dealt
    out by ranges of the order; a range knows how many rows stand before it from
    the counts of the others, one row a range.
    """
    by = [F.desc(c[1:]) if c[0] == "-" else F.asc_nulls_last(c) for c in order]
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // 500_000)
    placed = stash(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # The low 33 bits of the increasing id count the rows of a partition.
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_part", "_at", "_start")


PART_BYTES = 1 << 22  # of a column that a task takes up at once


def text_parts(batches: Iterable[pa.RecordBatch], at: int, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices with about ``size`` bytes in column ``at``; a larger value stands alone.

    A batch holds thousands of texts, and a task's strings and results are
    several times as large as these.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            before = int(ends[lo - 1]) if lo else 0
            hi = max(int(np.searchsorted(ends, before + size, "right")), lo + 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def give_back() -> None:
    """Returns freed memory to the system, where the C library and Arrow still hold it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow``, which keeps texts out of pandas.

    Spark keeps a Python worker for later tasks, so one gives back what it no
    longer uses: else an executor holds it through all stages that follow.
    """

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


class Bounded(dict):
    """A dict that makes missing values and forgets all at ``limit`` entries."""

    def __init__(self, make: Callable, limit: int = 400_000):
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value
