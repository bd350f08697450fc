"""Cutting the lineage of iterative plans, the folder that all machines share, and dealing rows out."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share.

    Where it is unset, as in tests on one machine, a local one is set; a cluster
    without one raises.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        given = context.getConf().get("spark.checkpoint.dir", None)
        if not given and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="lodestone-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the session's checkpoint folder, so that a lost executor costs a read only."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the checkpoint folder, for what grows with the input.

    It is worked out once, where a checkpoint repeats its last step, and its size
    is known to the joins that follow. ``name`` tells tables apart in that folder.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by its keys to as many tasks as shuffles have.

    A table of parts is a small file that one or two tasks read; what the queries
    write from each row, and parse again, is many times as large. Small shuffles
    are put together by their size before a step that makes them larger; these
    aren't, so a task keeps its share of the rows. Steps on the keys need no
    shuffle of their own.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def distinct_rows(df: DataFrame) -> DataFrame:
    """``df`` without repeats of whole rows, which are compared only where a hash occurs twice.

    Eight bytes of a row are shuffled; where none occurs twice, rows stay where
    they are.
    """
    hashed = df.withColumn("_hash", F.xxhash64(*df.columns))
    twice = stored(spread(hashed.select("_hash"), "_hash").groupBy("_hash").agg(F.count("*").alias("n")).where("n > 1").select("_hash"), "twice")
    if twice.isEmpty():
        return df
    once, again = (hashed.join(twice.hint("merge"), "_hash", how) for how in ("left_anti", "left_semi"))
    return once.unionByName(again.distinct()).drop("_hash")
