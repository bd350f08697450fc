"""Histories that follow renames: changes under old names count for the file of today."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.lineage import stored


def _leading_names(renames: DataFrame, today: DataFrame) -> DataFrame:
    """(name, from): the names that lead to a file of today, and since which change.

    A name leads there from the beginning if it is such a file, and an old name
    from the newest rename on whose new name leads there by then. A round goes on
    with the names that became newer in the one before; what is written is a row
    a name, never the renames.
    """
    best = front = stored(today.select(F.col("path").alias("name"), F.struct(F.lit(-1).cast("long").alias("commit"), F.lit(-1).alias("change")).alias("from")), "names")
    while True:
        met = renames.join(front, F.col("path") == F.col("name")).where(F.col("from") < F.col("at"))
        told = met.groupBy(F.col("old_path").alias("name")).agg(F.min("at").alias("from"))
        old = best.select("name", F.col("from").alias("_had"))
        front = stored(told.join(old, "name", "left").where(F.col("_had").isNull() | (F.col("from") < F.col("_had"))).select("name", "from"), "names")
        if front.isEmpty():
            return best
        best = stored(best.unionByName(front).groupBy("name").agg(F.min("from").alias("from")), "names")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """What each change's path was called at the newer border of its block, and what each block renames.

    ``rows`` has commit, change, path and alias, the old name that a rename which
    leads to a file gives, else null. Changes are dealt out by ranges of their
    order, and a task goes through its range, the block, from the newest on. A
    row of the result has block, origin, and either commit and change, or the
    ``name`` that means ``origin`` beyond the older border.
    """
    order = ["commit", "change", "path", "alias"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*order).repartitionByRange(parts, "commit", "change").sortWithinPartitions(*order)

    def run(batches):
        block, now, given, last = TaskContext.get().partitionId(), {}, [], None
        for batch in batches:
            origins = []
            for commit, change, path, alias in zip(*(batch.column(c).to_pylist() for c in order), strict=True):
                if last != (commit, change):  # a change doesn't see the name that it gives itself
                    now.update(given)
                    given, last = [], (commit, change)
                origin = now.get(path, path)
                origins.append(origin)
                if alias is not None:
                    given.append((alias, origin))
            n = len(origins)
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int32()), batch.column(0), batch.column(1), pa.nulls(n, pa.string()), pa.array(origins, pa.string())], names)
        now.update(given)
        n = len(now)
        yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int32()), pa.nulls(n, batch_types[0]), pa.nulls(n, batch_types[1]), pa.array(list(now), pa.string()), pa.array(list(now.values()), pa.string())], names)

    names, batch_types = ["block", "commit", "change", "name", "origin"], (pa.int64(), pa.int32())
    return stored(dealt.mapInArrow(run, "block int, commit long, change int, name string, origin string"), "blocks")


def _as_of(rows: DataFrame, aliases: DataFrame, carry: str) -> DataFrame:
    """``rows`` (at, path, ...) with the ``carry`` of the last alias of their path before them, null without one.

    Only paths that have an alias at all go through the window.
    """
    named = aliases.select(F.col("old_path").alias("path"), "at", F.col(carry).alias("_carry"))
    some = named.select("path").distinct()
    asked = rows.join(some, "path", "left_semi").withColumn("_side", F.lit(1)).withColumn("_carry", F.lit(None).cast(dict(named.dtypes)["_carry"]))
    given = named.withColumn("_side", F.lit(0))
    both = asked.unionByName(given, allowMissingColumns=True)
    # A change and a rename of one place are the same change, which doesn't see its own alias.
    before = Window.partitionBy("path").orderBy("at", F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_carry", F.last("_carry", ignorenulls=True).over(before)).where("_side = 1").drop("_side")
    rest = rows.join(some, "path", "left_anti").withColumn("_carry", F.lit(None).cast(dict(named.dtypes)["_carry"]))
    return found.unionByName(rest).withColumnRenamed("_carry", carry)


def follow_renames(changes: DataFrame, files: DataFrame) -> DataFrame:
    """(commit, change, file) of every change that touches a file of today, under whatever name.

    ``changes`` has commit (its place in the log, 0 the newest), change (its
    place in the commit), status, path and old_path; ``files`` path. Read from
    the newest change to the oldest, a name means the file that bears it today
    until a rename says that the file had that name before; from there on it
    means that file, even where the name is borne by another one today. Copies
    give no name. Renames of files that are gone lead nowhere, and changes of
    names that lead nowhere have no row. Null paths lead nowhere.
    """
    today = files.select("path").where("path IS NOT NULL").distinct()
    rows = changes.where("path IS NOT NULL").select(F.col("commit").cast("long").alias("commit"), F.col("change").cast("int").alias("change"), F.struct(F.col("commit").cast("long").alias("commit"), F.col("change").cast("int").alias("change")).alias("at"), "status", "path", "old_path")
    gives = F.startswith("status", F.lit("R")) & F.col("old_path").isNotNull()
    leading = _leading_names(stored(rows.where(gives).select("at", "path", "old_path"), "renames"), today)
    # Renames whose new name leads to no file of today by then give no name.
    known = rows.join(leading, F.col("path") == F.col("name"), "left").select("commit", "change", "path", F.when(gives & (F.col("from") < F.col("at")), F.col("old_path")).alias("alias"))
    blocks = _in_blocks(known)
    # A block's name points at the last block before it that renamed its origin; chains are halved until they all end.
    at = F.struct("block", F.col("name").alias("of"))
    given = blocks.where("name IS NOT NULL").select(F.col("block").alias("at"), F.col("origin").alias("path"), F.col("name").alias("old_path"), at.alias("own"))
    points = _as_of(given, given.withColumn("to", F.col("own")), "to")
    heads = stored(points.select("own", "to", F.col("path").alias("file")), "heads")
    while not heads.where("to IS NOT NULL").isEmpty():
        onward = heads.select(F.col("own").alias("to"), F.col("to").alias("next"), F.col("file").alias("head"))
        heads = stored(heads.join(onward, "to", "left").select("own", F.col("next").alias("to"), F.coalesce("head", "file").alias("file")), "heads")
    aliases = heads.select(F.col("own.block").alias("at"), F.col("own.of").alias("old_path"), "file")
    met = blocks.where("name IS NULL").select("commit", "change", "block", "origin")
    # The names that a block's changes began with are looked up once each.
    asked = met.select(F.col("block").alias("at"), F.col("origin").alias("path")).distinct()
    named = _as_of(asked, aliases, "file").join(today.select(F.col("path").alias("own")), F.col("path") == F.col("own"), "left")
    found = stored(named.select(F.col("at").alias("block"), F.col("path").alias("origin"), F.coalesce("file", "own").alias("file")).where("file IS NOT NULL"), "origins")
    return met.join(found, ["block", "origin"]).select("commit", "change", "file")
