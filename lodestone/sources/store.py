"""Snapshots as stored tables that readers see whole or not at all.

A run writes its tables into a folder of its own, ``table/snapshot=…/run=…``,
and a marker that names the run last, under the name of the snapshot. Readers
take the runs that markers name and nothing else. The first run of a snapshot
that ends is the snapshot; later ones find its marker and give way.
"""

from __future__ import annotations

import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.intervals import innermost, overlap_join

# Fixed value: characters of a signature that are stored.
SIGNATURE = 500
_MARKERS = "_finished"


class SnapshotStore:
    """The snapshots below a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._path("/".join((self.root, *names)))

    def _list(self, *names: str) -> list[str]:
        """Names in a folder, the oldest first."""
        at = self._at(*names)
        found = self._fs.listStatus(at) if self._fs.exists(at) else []
        return [name for _, name in sorted((f.getModificationTime(), f.getPath().getName()) for f in found)]

    def finished(self) -> dict[str, str]:
        """Snapshot id -> run of every finished snapshot: the one that was marked first."""
        out: dict[str, str] = {}
        for marker in self._list(_MARKERS):
            key, _, run = marker.rpartition("@")
            out.setdefault(unquote(key), run)
        return out

    def save(self, snapshot: str, tables: dict[str, DataFrame]) -> str:
        """Stores a snapshot and returns the run that is it: this one, or one that has finished before.

        A run that stops half-way is seen by nobody and may be repeated; what it
        left behind goes once a run of its snapshot has finished. Long
        signatures of symbols are clipped.
        """
        if done := self.finished().get(snapshot):
            return done
        run, key = uuid.uuid4().hex, quote(snapshot, safe="")
        for name, df in tables.items():
            clipped = df.withColumn("signature", F.left("signature", F.lit(SIGNATURE))) if name == "symbols" and "signature" in df.columns else df
            clipped.write.parquet(f"{self.root}/{name}/snapshot={key}/run={run}")
        self._fs.create(self._at(_MARKERS, f"{key}@{run}"), False).close()
        won = self.finished()[snapshot]
        for name in self._list():
            for other in self._list(name, f"snapshot={key}") if name != _MARKERS else []:
                if other != f"run={won}":
                    self._fs.delete(self._at(name, f"snapshot={key}", other), True)
        return won

    def load(self, table: str, snapshots: list[str] | None = None) -> DataFrame:
        """A table of finished snapshots, all of them or some, with the column ``snapshot``; where none is there, an empty table of that column alone."""
        done = self.finished()
        wanted = [s for s in (done if snapshots is None else snapshots) if s in done]
        paths = [p for s in wanted if self._fs.exists(self._path(p := f"{self.root}/{table}/snapshot={quote(s, safe='')}/run={done[s]}"))]
        if not paths:
            return self.spark.createDataFrame([], "snapshot string")
        found = self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*paths)
        name = F.regexp_extract(F.input_file_name(), r"/snapshot=([^/]*)/run=", 1)
        return found.drop("run").withColumn("snapshot", F.url_decode(F.url_decode(name)))

    def delete(self, snapshot: str) -> None:
        """Takes a snapshot from its readers' sight, then removes its tables."""
        key = quote(snapshot, safe="")
        for marker in self._list(_MARKERS):
            if marker.rpartition("@")[0] == key:
                self._fs.delete(self._at(_MARKERS, marker), False)
        for name in self._list():
            if name != _MARKERS:
                self._fs.delete(self._at(name, f"snapshot={key}"), True)


def with_enclosing(signals: DataFrame, symbols: DataFrame) -> DataFrame:
    """Signals with symbol_id, the innermost function around their first line, null outside of any.

    Signals of one path and line lie in the same function, so lines are looked up once.
    """
    lines = signals.select("path", "start").distinct()
    functions = symbols.where("kind = 'function'").select("path", "id", F.col("start").alias("first"), F.col("end").alias("last"))
    met = overlap_join(lines, functions, "path", ("start", "start"), ("first", "last")).select("p.path", "start", "id", "first", "last")
    inner = innermost(met, ["path", "start"], F.col("last") - F.col("first"), [F.asc("first"), F.asc("id")])
    return signals.join(inner.select("path", "start", F.col("id").alias("symbol_id")), ["path", "start"], "left")
