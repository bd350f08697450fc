"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stash

#: Ways that the neighbours of one node are spread over tasks.
SALTS = 16


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Joins (u, v) with the least node of u, a hub's neighbours spread over tasks."""
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(spread, ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of each node to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Links the smaller neighbours of each node, and itself, to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(edges, least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node it reaches.

    ``edges`` has u and v of one type. Loops and repeats are harmless. Each round
    is a table in the shared folder. A round costs shuffles of as many rows as
    there are edges, and the number of rounds follows the logarithm of the size
    of the largest component.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    stars = stash(ordered.distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        now = stars.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now["n"] == 0 or before == now:
            break
        before = now
        large = stash(_large_star(stars).distinct(), "large-star")
        stars = stash(_small_star(large).distinct(), "small-star")
    else:
        raise RuntimeError(f"components aren't settled after {most_rounds} rounds")
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
