"""Graph operators: roll-up, edge counting, reverse reach by depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.lineage import cut

# The resolution lattice, best first.
RESOLUTIONS = ("resolved", "ambiguous", "unresolved")


def dedup_edges(edges: DataFrame, keys: list[str], order: Column, first: list[str]) -> DataFrame:
    """One edge per key: how often it occurs, and other columns as of its first occurrence."""
    kept = F.min_by(F.struct(*first), order).alias("_first")
    return edges.groupBy(*keys).agg(F.count("*").alias("weight"), kept).select(*keys, "weight", *(F.col(f"_first.{c}").alias(f"first_{c}") for c in first))


def fan_in_points(resolved: Column, ambiguous: Column) -> Column:
    """round(log2(1 + resolved + ambiguous / 2), 1)."""
    return F.round(F.log2(1 + resolved + ambiguous / 2) * 10) / 10


def roll_up(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges between groups: (src, dst, resolution rank, weight) through node -> group, loops dropped.

    ``groups`` has node and group. The weight is summed, the resolution is the best.
    """
    a, b = groups.select(F.col("node").alias("src"), F.col("group").alias("src_group")), groups.select(F.col("node").alias("dst"), F.col("group").alias("dst_group"))
    return (
        edges.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where("src_group <> dst_group").groupBy("src_group", "dst_group").agg(F.sum("weight").alias("weight"), F.min("resolution").alias("resolution"))
    )


def reach(edges: DataFrame, starts: DataFrame, most_depth: int | None = None) -> DataFrame:
    """(node, depth): all nodes that depend on the starts, with the least number of steps.

    ``edges`` has src (depends on) and dst. With a column ``start`` beside node
    every start has a reach of its own. Breadth first: each step joins the new
    nodes only and drops those seen before, until a step finds none. What is
    seen is written to the checkpoint folder, so that plans stay short. With
    ``most_depth`` it raises where that many steps don't reach all.
    """
    keys = [c for c in ("start", "node") if c in starts.columns]
    links = edges.select("src", "dst").distinct()
    seen = cut(starts.select(*keys).distinct().withColumn("depth", F.lit(0)))
    front, depth = seen, 0
    while True:
        depth += 1
        found = links.join(front.drop("depth").withColumnRenamed("node", "dst").hint("merge"), "dst").withColumnRenamed("src", "node").select(*keys).distinct()
        front = cut(found.join(seen.hint("merge"), keys, "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        if most_depth is not None and depth > most_depth:
            raise RuntimeError(f"the reach isn't whole after {most_depth} steps")
        seen = cut(seen.unionByName(front)) if depth % 8 == 0 else seen.unionByName(front)


def start_set(ids: DataFrame, symbols: DataFrame, component_files: DataFrame) -> DataFrame:
    """(node): a component stands for its files and their symbols, a file for itself and its symbols.

    ``ids`` has node; ``component_files`` id and path.
    """
    files = ids.join(component_files, ids["node"] == component_files["id"]).select(F.concat(F.lit("file:"), "path").alias("node")).unionByName(ids.where(F.startswith("node", F.lit("file:"))).select("node")).distinct()
    inside = symbols.join(files.select(F.substring("node", 6, 1 << 30).alias("path")), "path", "left_semi").select(F.col("id").alias("node"))
    others = ids.join(component_files, ids["node"] == component_files["id"], "left_anti").select("node")
    return others.unionByName(files).unionByName(inside).distinct()


def impact(edges: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(node, depth, resolution, boundary) of what depends on the starts within ``depth`` steps.

    Where ``starts`` has a column ``start`` beside ``node``, every start has an
    impact of its own, with that column.
    ``edges`` has src, dst, kind, method and resolution (its place among
    RESOLUTIONS). A path is as good as its weakest edge; of the shortest paths
    to a node the best one counts. Co-change is no dependency. A node is at the
    boundary if an edge that reaches it is of the reference index.
    """
    keys = [c for c in ("start", "node") if c in starts.columns]
    links = edges.where("kind <> 'co_changes'").groupBy("src", "dst").agg(F.min("resolution").alias("edge"), F.max((F.col("method") == "reference_index").cast("int")).alias("outer"))
    seen = cut(starts.select(*keys, F.lit(0).alias("depth"), F.lit(0).alias("resolution"), F.lit(False).alias("boundary")).distinct())
    front = seen
    for step in range(1, depth + 1):
        met = links.join(front.drop("depth", "boundary").withColumnsRenamed({"node": "dst", "resolution": "so_far"}).hint("merge"), "dst").withColumnRenamed("src", "node")
        found = met.groupBy(*keys).agg(F.min(F.greatest("edge", "so_far")).alias("resolution"), (F.max("outer") == 1).alias("boundary"))
        front = cut(found.join(seen.hint("merge"), keys, "left_anti").select(*keys, F.lit(step).alias("depth"), "resolution", "boundary"))
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def impact_edges(edges: DataFrame, starts: DataFrame, nodes: DataFrame, depth: int = 3) -> DataFrame:
    """(src, dst, resolution) of all edges that the impact follows, loops back into it included; with ``start`` where the starts have it."""
    keys = [c for c in ("start", "node") if c in starts.columns]
    walked = starts.select(*keys).unionByName(nodes.where(F.col("depth") < depth).select(*keys)).distinct()
    return edges.where("kind <> 'co_changes'").join(walked.withColumnRenamed("node", "dst").hint("merge"), "dst").select(*keys[:-1], "src", "dst", "resolution")


def edge_counts(edges: DataFrame) -> DataFrame:
    """(node, incoming and outgoing edges by resolution, outside): co-change left out, the reference index counted apart."""
    own = edges.where("kind <> 'co_changes'")
    outside = F.col("method") == "reference_index"
    count = lambda d, r: F.count_if(~outside & (F.col("side") == d) & (F.col("resolution") == r)).alias(f"{d}_{r}")
    ends = own.select("method", "resolution", F.explode(F.array(F.struct(F.lit("out").alias("side"), F.col("src").alias("node")), F.struct(F.lit("in").alias("side"), F.col("dst").alias("node")))).alias("e")).select("method", "resolution", "e.*")
    return ends.groupBy("node").agg(*(count(d, r) for d in ("in", "out") for r in RESOLUTIONS), F.count_if(outside & (F.col("side") == "in")).alias("outside"))


def band(share: Column) -> Column:
    """Name of a share of the graph that a change can reach."""
    return F.when(share >= 0.3, "System-wide").when(share >= 0.1, "Wide").otherwise("Contained")
