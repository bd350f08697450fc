"""The graph by components, files and symbols in one pass: what lies outside is shown by its directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.lineage import spread
from lodestone.operators.ranking import top_per_key

# Symbols of a view, and directories of the outside by level.
MOST_SYMBOLS = 600
MOST_DIRECTORIES = {"component": 12, "file": 25, "symbol": 30}


def wanted_symbols(symbols: DataFrame, most: int = MOST_SYMBOLS, file: str | None = None) -> DataFrame:
    """The symbols that a view shows: macros only if they have points, the most critical ones, ties by id."""
    own = symbols.where("kind <> 'macro' OR criticality > 0")
    return (own if file is None else own.where(F.col("path") == file)).orderBy(F.desc("criticality"), "id").limit(most)


def _endpoints(places: DataFrame, files: DataFrame, component_files: DataFrame, symbols: DataFrame, file: str | None) -> DataFrame:
    """(node, views): what each node of the graph is shown as at every level of MOST_DIRECTORIES, null for nothing."""
    inside = files.select("path").distinct().withColumn("in", F.lit(True))
    component = component_files.groupBy("path").agg(F.min("component").alias("component"))
    shown = symbols.select(F.col("id").alias("node"), F.lit(True).alias("shown"))
    own = places.groupBy("node").agg(F.min("path").alias("path")).join(inside, "path", "left").join(component, "path", "left").join(F.broadcast(shown), "node", "left")
    directory = F.when(T.dirname(F.col("path")) == "", ".").otherwise(T.dirname(F.col("path")))
    outside, whole = F.concat(F.lit("dir:"), directory), F.concat(F.lit("file:"), F.col("path"))
    away = F.col("path").isNotNull() & F.col("in").isNull()
    beside = F.when((F.col("path") != file), whole) if file is not None else F.lit(None).cast("string")
    view = lambda mapped, boundary: F.struct(mapped.alias("group"), boundary.alias("boundary"))
    symbol = F.coalesce("shown", F.lit(False))
    views = F.array(
        view(F.when(away, outside).otherwise(F.col("component")), away),
        view(F.when(away, outside).when(F.col("path").isNotNull(), whole), away),
        view(F.when(symbol, F.col("node")).when(away, outside).otherwise(beside), away & ~symbol),
    )
    return own.select("node", views.alias("views"))


def graph_view(edges: DataFrame, places: DataFrame, files: DataFrame, component_files: DataFrame, symbols: DataFrame, co_change: bool = False, file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes and the edges of the graph at the levels component, file and symbol.

    ``edges`` has src, dst, kind, resolution (0 the best), weight and ord, their
    order; ``places`` node and path (ids are text), ``files`` path,
    ``component_files`` component and path, ``symbols`` those of
    ``wanted_symbols``. With ``file`` the symbols are those of one file, and
    other files that they touch are shown as files. Edges of one kind between
    two groups are one, with the sum of their weights and the best resolution;
    loops and edges with an end that isn't shown are dropped. What lies outside
    of the files is shown by directory, the busiest 12, 25 or 30 by level (how
    many ends lie there, and for symbols how many edges lead there as well; the
    first met of those that tie), and edges of the others are dropped.

    Returns (level, id, kind, boundary, size) of what edges touch: size counts
    the ends of a directory, and for symbols 1 and the edges that lead there; and
    (level, src, dst, kind, resolution, weight).
    """
    ends = _endpoints(places, files, component_files, symbols, file)
    own = edges if co_change else edges.where("kind <> 'co_changes'")
    # Views are long texts that pack well: by their packed size too many edges would come to one task.
    half = spread(own, "src").join(ends.select(F.col("node").alias("src"), F.col("views").alias("a")).hint("merge"), "src")
    met = spread(half, "dst").join(ends.select(F.col("node").alias("dst"), F.col("views").alias("b")).hint("merge"), "dst")
    level = F.get(F.array(*map(F.lit, MOST_DIRECTORIES)), F.col("nth")).alias("level")
    levels = met.select("kind", "resolution", "weight", "ord", F.posexplode(F.arrays_zip("a", "b")).alias("nth", "v")).select("kind", "resolution", "weight", "ord", level, "v.a", "v.b")
    # Every end outside counts, also that of an edge which isn't shown.
    sides = levels.select("level", "ord", F.explode(F.array(F.struct(F.lit(0).alias("side"), "a.group", "a.boundary"), F.struct(F.lit(1).alias("side"), "b.group", "b.boundary"))).alias("e")).where("e.boundary")
    busy = sides.groupBy("level", F.col("e.group").alias("id")).agg(F.count("*").alias("ends"), F.min(F.struct("ord", "e.side")).alias("first"))
    grouped = levels.where("a.group <> b.group").groupBy("level", F.col("a.group").alias("src"), F.col("b.group").alias("dst"), "kind").agg(F.sum("weight").alias("weight"), F.min("resolution").alias("resolution"))
    into = grouped.where("level = 'symbol' AND kind <> 'co_changes'").groupBy("level", F.col("dst").alias("id")).agg(F.count("*").alias("into"))
    sized = busy.join(into, ["level", "id"], "left").withColumn("size", F.col("ends") + F.coalesce("into", F.lit(0)))
    most = F.create_map(*(F.lit(x) for pair in MOST_DIRECTORIES.items() for x in pair))[F.col("level")]
    kept = top_per_key(sized, ["level"], [F.desc("size"), F.asc("first")], max(MOST_DIRECTORIES.values()), "nth").where(F.col("nth") <= most).select("level", "id", "size").withColumn("boundary", F.lit(True))
    shown = grouped
    for end in ("src", "dst"):
        known = kept.select("level", F.col("id").alias(end), F.lit(True).alias("known"))
        shown = shown.join(F.broadcast(known), ["level", end], "left").where(F.col("known") | ~F.startswith(end, F.lit("dir:"))).drop("known")
    touched = shown.select("level", F.explode(F.array("src", "dst")).alias("id")).distinct().where(~F.startswith("id", F.lit("dir:")))
    inner = touched.join(into, ["level", "id"], "left").select("level", "id", (F.lit(1) + F.coalesce("into", F.lit(0))).alias("size"), F.lit(False).alias("boundary"))
    kind = F.when(F.col("boundary"), "boundary").when(F.startswith("id", F.lit("file:")), "file").otherwise(F.col("level"))
    nodes = inner.unionByName(kept.select("level", "id", "size", "boundary")).select("level", "id", kind.alias("kind"), "boundary", "size")
    return nodes, shown.select("level", "src", "dst", "kind", "resolution", "weight")
