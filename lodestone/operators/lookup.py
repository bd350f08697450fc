"""Look-ups in the source model, many at a time: symbols by name, windows of code, neighbours, signals.

Each takes a table of requests with a ``query_id`` and joins on equal keys, so a
request costs what it finds. A request that finds nothing has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.intervals import overlap_join
from lodestone.operators.ranking import top_per_key

# How much of each kind an answer holds.
MOST_SYMBOLS = 3
MOST_LINES = 80
MOST_NEIGHBOURS = 40
MOST_SIGNALS = 25


def names_of(name: Column, short_name: Column) -> Column:
    """Every name that a symbol answers to: whole, short, and what follows each ``::``."""
    parts = F.split(name, "::", -1)
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "::"))
    return F.array_compact(F.array_distinct(F.concat(F.array(name, short_name), tails)))


def matches(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """All symbols that answer to the names (query_id, name), with the query's id; names are never broadcast, there may be several a symbol."""
    keyed = symbols.withColumn("key", F.explode(names_of(F.col("name"), F.col("short_name"))))
    return keyed.join(names.select("query_id", F.trim("name").alias("key")).hint("merge"), "key").drop("key")


def symbol_lookup(symbols: DataFrame, names: DataFrame, order: list[str], most: int = MOST_SYMBOLS) -> DataFrame:
    """The first symbols of each name in the given order, and how many there are in all."""
    found = matches(symbols, names)
    total = found.groupBy("query_id").agg(F.count("*").alias("total"))
    return top_per_key(found, ["query_id"], order, most).join(total.hint("merge"), "query_id")


def code_window(files: DataFrame, wanted: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """(query_id, path, start, end, total, body): lines of files (path, text), from the first line at the earliest, to the last one and ``most`` lines at most.

    ``wanted`` has query_id, path, start and end; without an end, or with 0, the
    window reaches 40 lines on. A window past the last line or with its end
    before its start has an empty body. A null text is one empty line.
    """
    asked = F.when(F.coalesce("end", F.lit(0)) == 0, F.col("start") + 40).otherwise(F.col("end"))
    met = wanted.join(files.select("path", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines")), "path")
    first = met.withColumn("total", F.size("lines")).withColumn("asked", asked).withColumn("start", F.greatest(F.lit(1), "start"))
    cut = first.withColumn("end", F.least("total", "asked", F.col("start") + most - 1))
    return cut.select("query_id", "path", "start", "end", "total", F.array_join(F.slice("lines", F.col("start"), F.greatest(F.lit(0), F.col("end") - F.col("start") + 1)), "\n").alias("body"))


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str, order: list[str], most: int = MOST_NEIGHBOURS) -> DataFrame:
    """(query_id, other, kind, resolution, method, total, outside): callers or callees of the nodes (query_id, node).

    ``edges`` has src, dst, kind, resolution and method, of which co-changes are
    no neighbours. ``outside`` counts those that are known by their name alone.
    """
    mine, other = ("dst", "src") if direction == "callers" else ("src", "dst")
    found = edges.where("kind <> 'co_changes'").withColumnRenamed(mine, "node").withColumnRenamed(other, "other").join(nodes.select("query_id", "node").distinct(), "node")
    counts = found.groupBy("query_id").agg(F.count("*").alias("total"), F.count_if(F.col("method") == "reference_index").alias("outside"))
    return top_per_key(found, ["query_id"], order, most).join(counts, "query_id").select("query_id", "other", "kind", "resolution", "method", "total", "outside")


def signals_for(signals: DataFrame, symbols: DataFrame, targets: DataFrame, order: list[str], most: int = MOST_SIGNALS) -> DataFrame:
    """Signals of each target (query_id, name): those that begin in its first symbol, or, where no symbol has the name, those of the files with that path or base name.

    Signals meet symbols by their lines. The first signals of a file are chosen
    once for all targets that name it, so a target adds ``most`` rows at most.
    """
    first = symbol_lookup(symbols, targets, ["path", "start", "name"], 1).select("query_id", "path", F.col("start").alias("first"), F.col("end").alias("last"))
    within = overlap_join(signals, first, "path", ("start", "start"), ("first", "last")).select("query_id", *(F.col(f"p.{c}") for c in signals.columns))
    files = signals.withColumn("key", F.explode(F.array_distinct(F.array("path", F.substring_index("path", "/", -1)))))
    told = top_per_key(files, ["key"], order, most)
    asked = targets.select("query_id", F.col("name").alias("key")).join(first.select("query_id").hint("merge"), "query_id", "left_anti")
    named = told.join(asked, "key").drop("key")
    return top_per_key(within.unionByName(named), ["query_id"], order, most)
