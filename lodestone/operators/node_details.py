"""What is told of a node of the graph, for many nodes at once.

A node is a component, a file or a symbol: ``nodes`` has node_id and path, a row
for each of its files, and start and end, which are null but for symbols. All
look-ups meet on equal paths; a node with nothing to tell has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranking import top_per_key

# How much of each sort is told.
MOST_SIGNALS = 30
MOST_COMMITS = 12
MOST_CO_CHANGES = 8
MOST_AUTHORS = 5


def node_signals(nodes: DataFrame, signals: DataFrame, most: int = MOST_SIGNALS) -> DataFrame:
    """Signals of each node (its id and all columns of ``signals``), the weightiest first: those that begin in its files, or in its lines if it has lines."""
    span = nodes.select("node_id", "path", F.col("start").alias("_first"), F.col("end").alias("_last")).distinct()
    met = signals.join(span, "path").where("_first IS NULL OR start BETWEEN _first AND _last").drop("_first", "_last")
    return top_per_key(met, ["node_id"], [F.desc("weight"), "path", "start", "kind"], most)


def node_commits(nodes: DataFrame, commits: DataFrame, files: DataFrame, most: int = MOST_COMMITS) -> DataFrame:
    """The last commits (sha, at) that touch each node's files, by ``files`` (sha, path); each once a node."""
    touching = files.join(nodes.select("node_id", "path").distinct(), "path").select("node_id", "sha").distinct()
    return top_per_key(touching.join(commits, "sha"), ["node_id"], [F.desc("at"), "sha"], most)


def node_co_changes(nodes: DataFrame, pairs: DataFrame, most: int = MOST_CO_CHANGES) -> DataFrame:
    """(node_id, path, count, strength): files that change along with each node's, by ``pairs`` (a, b, count, strength).

    A pair within a node tells its second file.
    """
    mine = nodes.select("node_id", "path").distinct()
    first = pairs.join(mine.withColumnRenamed("path", "a"), "a").select("node_id", "a", "b", F.col("b").alias("path"), "count", "strength")
    second = pairs.join(mine.withColumnRenamed("path", "b"), "b").select("node_id", "a", "b", F.col("a").alias("path"), "count", "strength")
    found = first.unionByName(second.join(first.select("node_id", "a", "b"), ["node_id", "a", "b"], "left_anti"))
    return top_per_key(found.drop("a", "b"), ["node_id"], [F.desc("count"), "path"], most)


def node_authors(nodes: DataFrame, authors: DataFrame, most: int = MOST_AUTHORS) -> DataFrame:
    """(node_id, nth, email, name, commits): authors of each node's files taken together, by ``authors`` (path, email, name, commits)."""
    met = authors.join(nodes.select("node_id", "path").distinct(), "path")
    merged = met.groupBy("node_id", "email").agg(F.min_by("name", F.struct("path", "name")).alias("name"), F.sum("commits").alias("commits"))
    nth = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("commits"), "email"))
    return merged.withColumn("nth", nth).where(F.col("nth") <= most).select("node_id", "nth", "email", "name", "commits")
