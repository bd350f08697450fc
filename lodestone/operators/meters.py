"""How far a change reaches: counts over the whole reach, and walks that end at a budget of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.lineage import cut

# Fixed value: how a link by the index of outside references is found.
OUTER = "reference_index"


def _links(edges: DataFrame) -> DataFrame:
    return edges.where("kind <> 'co_changes'")


def reach_nodes(edges: DataFrame, starts: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(start, node, depth, outer): all that depends on each start, and what lies outside of the files looked at.

    ``edges`` has src (depends on), dst, kind and method, ``starts`` start and
    node, ``nodes`` node and path (null: of no file), ``files`` path. A node is
    outer if its path isn't among the files or an edge of the least depth is of
    the reference index; it is met, but nothing is followed from there. Starts
    have depth 0 and are followed wherever they lie. Fronts and what is seen grow
    with the reach, so they are never broadcast.
    """
    inside = files.select("path").distinct().withColumn("in", F.lit(True))
    placed = nodes.select("node", "path").distinct().join(inside.hint("merge"), "path", "left").groupBy("node").agg(F.bool_or(F.col("path").isNotNull() & F.col("in").isNull()).alias("away"))
    links = _links(edges).groupBy("src", "dst").agg(F.bool_or(F.col("method") == OUTER).alias("indexed"))
    links = cut(links.join(placed.withColumnRenamed("node", "src").hint("merge"), "src", "left").select("src", "dst", (F.col("indexed") | F.coalesce("away", F.lit(False))).alias("outer")))
    seen = cut(starts.select("start", "node").distinct().withColumns({"depth": F.lit(0), "outer": F.lit(False)}))
    front, depth = seen, 0
    while True:
        depth += 1
        met = links.withColumnRenamed("dst", "node").join(front.select("start", "node").hint("merge"), "node").groupBy("start", F.col("src").alias("node")).agg(F.bool_or("outer").alias("outer"))
        found = cut(met.join(seen.hint("merge"), ["start", "node"], "left_anti").select("start", "node", F.lit(depth).alias("depth"), "outer"))
        if found.isEmpty():
            return seen
        front = found.where(~F.col("outer"))
        seen = cut(seen.unionByName(found)) if depth % 8 == 0 else seen.unionByName(found)


def reach_meter(edges: DataFrame, starts: DataFrame, nodes: DataFrame, files: DataFrame, component_files: DataFrame) -> DataFrame:
    """One row a start: the share of the system that depends on it, in counts.

    Beside the inputs of ``reach_nodes`` edges have a resolution (resolved,
    ambiguous or unresolved), nodes a flag symbol, and ``component_files`` holds
    component and path. Returns start, files, symbols and components affected
    (those of the start itself left out for files and components) with their
    totals, share (of the files), max_depth, by_depth (nodes at each depth),
    outside (files, or nodes of no file, that are met outside), ambiguous and
    unresolved (edges that the walk meets, those to nodes seen before included,
    and unresolved edges out of the start) and lower_bound: true if something
    unresolved or outside hides a part of the reach.
    """
    walked = cut(reach_nodes(edges, starts, nodes, files))
    of = nodes.groupBy("node").agg(F.min("path").alias("path"), F.bool_or("symbol").alias("symbol"))
    known = walked.join(of.hint("merge"), "node", "left")
    own = known.where("depth = 0 AND path IS NOT NULL").select("start", "path").distinct()
    own_components = own.join(component_files.hint("merge"), "path").select("start", "component").distinct()
    met = known.where("depth > 0 AND NOT outer")
    affected = met.where("path IS NOT NULL").select("start", "path").distinct().join(own.hint("merge"), ["start", "path"], "left_anti")
    components = affected.join(component_files.hint("merge"), "path").select("start", "component").distinct().join(own_components.hint("merge"), ["start", "component"], "left_anti")
    depths = met.groupBy("start", "depth").agg(F.count("*").alias("n")).groupBy("start").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "n"))), lambda x: x["n"]).alias("by_depth"))
    outside = known.where("depth > 0 AND outer").select("start", F.coalesce("path", F.col("node").cast("string")).alias("where")).distinct()
    followed = walked.where(~F.col("outer")).select("start", F.col("node").alias("dst"))
    ends = _links(edges).where("resolution <> 'resolved'").select("src", "dst", "resolution")
    open_out = ends.where("resolution = 'unresolved'").join(walked.where("depth = 0").select("start", F.col("node").alias("src")).hint("merge"), "src")
    doubtful = ends.join(followed.hint("merge"), "dst").select("start", "resolution").unionByName(open_out.select("start", "resolution"))
    # One aggregate counts all of them, in place of a join for each.
    counted = doubtful.select("start", F.col("resolution").alias("what"))
    parts = {"files": affected, "symbols": met.where("symbol"), "components": components, "own_files": own, "own_components": own_components, "outside": outside}
    for name, part in parts.items():
        counted = counted.unionByName(part.select("start", F.lit(name).alias("what")))
    counts = counted.groupBy("start").agg(*(F.count_if(F.col("what") == name).alias(name) for name in (*parts, "ambiguous", "unresolved")))
    # One row each.
    totals = files.select("path").distinct().agg(F.count("*").alias("n_files")).join(component_files.agg(F.count_distinct("component").alias("n_components"))).join(of.agg(F.count_if("symbol").alias("n_symbols")))
    out = starts.select("start").distinct().join(counts.hint("merge"), "start", "left").join(depths.hint("merge"), "start", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rest = F.greatest(F.col("n_files") - zero("own_files"), F.lit(0))
    return out.join(F.broadcast(totals)).select(
        "start",
        zero("files").alias("files"),
        rest.alias("files_total"),
        zero("symbols").alias("symbols"),
        F.col("n_symbols").alias("symbols_total"),
        zero("components").alias("components"),
        F.greatest(F.col("n_components") - zero("own_components"), F.lit(0)).alias("components_total"),
        F.when(rest > 0, zero("files") / rest).otherwise(F.lit(0.0)).alias("share"),
        F.coalesce(F.size("by_depth"), F.lit(0)).alias("max_depth"),
        F.coalesce("by_depth", F.array().cast("array<bigint>")).alias("by_depth"),
        zero("outside").alias("outside"),
        zero("ambiguous").alias("ambiguous"),
        zero("unresolved").alias("unresolved"),
        ((zero("unresolved") > 0) | (zero("outside") > 0)).alias("lower_bound"),
    )


def impact_within(edges: DataFrame, starts: DataFrame, nodes: DataFrame, files: DataFrame, depth: int = 3, most_nodes: int = 150) -> tuple[DataFrame, DataFrame]:
    """The nodes and the edges of a walk from each start that ends at a budget.

    ``edges`` has src, dst, kind, method, resolution (0 resolved, 1 ambiguous, 2
    unresolved) and ord, their order; ``starts`` start, node and nth, the order
    of a start's nodes; ``nodes`` and ``files`` are those of ``reach_nodes``. The
    walk takes the nodes one after another, in the order in which they were met
    (that of the nodes they were met from, then of the edges), and ends before
    the first one that finds ``most_nodes`` met already. What a node is met from
    is taken whole, so the last one may exceed the budget.

    Returns (start, node, depth, place, resolution, boundary), the weakest
    resolution along the edges that met it, and (start, src, dst, resolution) of
    every edge followed. A level is a few joins, and running totals go over the
    nodes of a start that the budget lets in.
    """
    inside = files.select("path").distinct().withColumn("in", F.lit(True))
    away = nodes.select("node", "path").where("path IS NOT NULL").distinct().join(inside.hint("merge"), "path", "left").where("in IS NULL").select(F.col("node").alias("src")).distinct().withColumn("away", F.lit(True))
    links = cut(_links(edges).join(away.hint("merge"), "src", "left").select("src", "dst", "resolution", "ord", ((F.col("method") == OUTER) | F.coalesce("away", F.lit(False))).alias("boundary")))
    first = starts.groupBy("start", "node").agg(F.min("nth").alias("nth"))
    at = lambda *order: F.row_number().over(Window.partitionBy("start").orderBy(*order))
    front = cut(first.select("start", "node", at("nth", "node").alias("place"), F.lit(0).alias("weakest"), F.lit(0).cast("long").alias("before")))
    seen, met_nodes, met_edges = front.select("start", "node"), [], []
    for step in range(1, depth + 1):
        met = cut(links.join(front.select("start", F.col("node").alias("dst"), "place", "weakest", "before").hint("merge"), "dst"))
        fresh = met.join(seen.withColumnRenamed("node", "src").hint("merge"), ["start", "src"], "left_anti")
        first_met = F.min_by(F.struct("place", "ord", F.greatest("resolution", "weakest").alias("resolution"), "boundary"), F.struct("place", "ord"))
        won = fresh.groupBy("start", F.col("src").alias("node")).agg(first_met.alias("w")).select("start", "node", "w.*")
        gains = won.groupBy("start", "place").agg(F.count("*").alias("gain"))
        so_far = Window.partitionBy("start").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        running = front.join(gains.hint("merge"), ["start", "place"], "left").withColumn("so_far", F.col("before") + F.coalesce(F.sum("gain").over(so_far), F.lit(0)))
        taken = cut(running.where(F.col("so_far") < most_nodes).select("start", "place", "so_far", "gain"))
        totals = taken.groupBy("start").agg(F.max(F.col("so_far") + F.coalesce("gain", F.lit(0))).alias("total"))
        let_in = won.join(taken.select("start", "place").hint("merge"), ["start", "place"]).withColumn("here", at("place", "ord", "node"))
        new = cut(let_in.join(totals.hint("merge"), "start").select("start", "node", F.col("here").alias("place"), F.col("resolution").alias("weakest"), F.col("total").alias("before"), "boundary"))
        met_edges.append(met.join(taken.select("start", "place").hint("merge"), ["start", "place"]).select("start", "src", "dst", "resolution"))
        met_nodes.append(new.select("start", "node", F.lit(step).alias("depth"), "place", F.col("weakest").alias("resolution"), "boundary"))
        seen = seen.unionByName(new.select("start", "node"))
        front = new.where(F.col("before") < most_nodes)
    out_nodes, out_edges = met_nodes[0], met_edges[0]
    for n, e in zip(met_nodes[1:], met_edges[1:], strict=True):
        out_nodes, out_edges = out_nodes.unionByName(n), out_edges.unionByName(e)
    return out_nodes, out_edges


def impact_counts(edges: DataFrame, starts: DataFrame, walked_nodes: DataFrame, walked_edges: DataFrame) -> DataFrame:
    """(start, nodes, boundary, resolved, ambiguous, unresolved) of walks: edges followed, and unresolved ones out of the start."""
    open_out = edges.where("resolution = 2").join(starts.select("start", F.col("node").alias("src")).distinct().hint("merge"), "src").select("start", "resolution")
    of = lambda r: F.count_if(F.col("resolution") == r)
    ends = walked_edges.select("start", "resolution").unionByName(open_out).groupBy("start").agg(of(0).alias("resolved"), of(1).alias("ambiguous"), of(2).alias("unresolved"))
    met = walked_nodes.groupBy("start").agg(F.count("*").alias("nodes"), F.count_if("boundary").alias("boundary"))
    both = starts.select("start").distinct().join(met.hint("merge"), "start", "left").join(ends.hint("merge"), "start", "left")
    return both.select("start", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("nodes", "boundary", "resolved", "ambiguous", "unresolved")))
