"""Ranking operators: capped groups, quotas, sessions, levels, suffixes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.lineage import cut


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in an order; ``rank`` names a 1-based rank column to keep."""
    at = rank or "_rank"
    out = df.withColumn(at, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(at) <= n)
    return out if rank else out.drop(at)


def quota_top(df: DataFrame, key: str, order: list[Column], per_key: int, n: int) -> DataFrame:
    """Greedy quota: at most ``per_key`` rows of a key and ``n`` in all, in one order.

    Rows that the quota of their key leaves out can't be among the first ``n``,
    so capping each key first gives the same rows as the greedy scan.
    """
    return top_per_key(df, [key], order, per_key).orderBy(*order).limit(n)


def sessions(df: DataFrame, keys: list[str], order: list[Column], start: Column, end: Column, gap, name: str = "session") -> DataFrame:
    """Numbers the groups of rows that start within ``gap`` of the end of the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    opens = F.when(start - F.lag(end).over(w) <= gap, 0).otherwise(1)
    return df.withColumn("_opens", opens).withColumn(name, F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


RANGE = 100_000  # rows that one task ranks


def global_rank(df: DataFrame, score: str, tie: str, name: str = "rank", buckets: int | None = None, rows: int | None = None) -> DataFrame:
    """0-based rank by ``score`` descending, then ``tie``, without one task for all rows.

    Rows are dealt out by ranges of the order, which ties of the score don't hold
    together as the tie is a part of it; each range is numbered by itself and
    starts where the ones before it end. A count for each range comes together.
    The number of ranges follows that of the ``rows``, which are counted if that
    isn't known, unless ``buckets`` says how many there are.
    """
    order = [F.desc(score), F.asc(tie)]
    buckets = buckets or max(1, -(-(df.count() if rows is None else rows) // RANGE))
    dealt = cut(df.repartitionByRange(buckets, *order).sortWithinPartitions(*order).withColumn("_bucket", F.spark_partition_id()))
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return dealt.withColumn("_at", within).join(F.broadcast(starts), "_bucket").withColumn(name, F.col("_start") + F.col("_at") - 1).drop("_bucket", "_at", "_start")


def levels(df: DataFrame, score: str, tie: str, high: float = 0.1, medium: float = 0.35) -> DataFrame:
    """Adds ``level``: among positive scores the first ceil(high n) are high, up to ceil(medium n) medium, the rest low."""
    scored = cut(df)  # read for the number of positive scores, for their ranges and for the rest
    positive = scored.where(F.col(score) > 0)
    n = positive.count()
    ranked = global_rank(positive, score, tie, rows=n)
    share = lambda x: F.lit(math.ceil(n * x))
    level = F.when(F.col("rank") < share(high), "high").when(F.col("rank") < share(medium), "medium").otherwise("low")
    return ranked.withColumn("level", level).drop("rank").unionByName(scored.where(~(F.coalesce(F.col(score), F.lit(0)) > 0)).withColumn("level", F.lit("low")))


def unique_suffix(df: DataFrame, name: str, order: list[Column], out: str) -> DataFrame:
    """Repeats of a name get ``~2``, ``~3`` and so on in an order."""
    at = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("_at", at).withColumn(out, F.when(F.col("_at") == 1, F.col(name)).otherwise(F.concat(name, F.lit("~"), F.col("_at").cast("string")))).drop("_at")


def latest_with_others(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by some columns, with the number of its other rows; summed up before rows move."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_last"), (F.count("*") - 1).alias("others"))
    return last.select(*(F.col(f"_last.{c}").alias(c) for c in df.columns), "others")
