"""Components: shared name prefixes, directories, communities of files."""

from __future__ import annotations

from collections.abc import Hashable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.lineage import spread, stored

# Share of names that make a prefix common, files below which directories are components,
# members below which a directory stays whole.
MAJORITY, SMALL_SCOPE, SMALL_DIRECTORY = 0.6, 30, 4
#: Links whose connected parts one task finds.
FEW_LINKS = 200_000


def prefix_lengths(names: DataFrame, keys: list[str], parts: Column, share: float) -> DataFrame:
    """(keys, length): of each group the longest prefix of parts that at least ``share`` of the names have; 0 if none.

    A prefix is as common as its longest part at most, so the longest common one
    is that of the most parts. Names are counted by prefix, never gathered.
    """
    n = names.groupBy(*keys).agg(F.count("*").alias("n"))
    starts = names.select(*keys, parts.alias("p")).where("size(p) > 0").select(*keys, "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("length"))
    counted = starts.groupBy(*keys, "length", F.slice("p", F.lit(1), F.col("length")).alias("prefix")).agg(F.count("*").alias("k"))
    best = counted.join(n, keys).where(F.col("k") >= F.col("n") * F.lit(share)).groupBy(*keys).agg(F.max("length").alias("length"))
    return n.join(best, keys, "left").select(*keys, F.coalesce("length", F.lit(0)).alias("length"))


def name_parts(path: Column) -> Column:
    return F.split(T.basename(path), "_")


def common_directory(paths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, directory): the longest directory that holds all paths of a group; empty for the root."""
    folders = paths.withColumn("_d", F.filter(F.split(T.dirname(F.col("path")), "/"), lambda x: x != ""))
    length = prefix_lengths(folders, keys, F.col("_d"), 1.0)
    return folders.groupBy(*keys).agg(F.min("_d").alias("_d")).join(length, keys).select(*keys, F.array_join(F.slice("_d", F.lit(1), F.col("length")), "/").alias("directory"))


def largest_directories(paths: DataFrame, depth: int, most_files: int = 500, n: int = 3) -> DataFrame:
    """The ``n`` largest directories at a depth that hold no more than ``most_files`` files."""
    parts = F.split("path", "/")
    return paths.where(F.size(parts) > depth).groupBy(F.array_join(F.slice(parts, 1, depth), "/").alias("directory")).agg(F.count("*").alias("files")).where(F.col("files") <= most_files).orderBy(F.desc("files"), "directory").limit(n)


def louvain(links: dict[tuple[Hashable, Hashable], float], nodes: list, total: float | None = None) -> dict:
    """Communities of an undirected weighted graph by local moves of modularity and merging, in the order of the nodes.

    Where the links are those of one connected part of a graph, ``total`` is twice
    the weight of all of that graph's links: the communities are then those that
    the whole graph gives, as no move looks beyond a part but for that weight.
    """
    member = {v: i for i, v in enumerate(nodes)}  # node -> node of the present, merged graph
    graph: dict[int, dict[int, float]] = {i: {} for i in range(len(nodes))}
    for (a, b), w in links.items():
        i, j = member[a], member[b]
        graph[i][j] = graph[i].get(j, 0) + w
        if i != j:
            graph[j][i] = graph[j].get(i, 0) + w
    while True:
        # A loop counts at both of its ends.
        degree = {i: sum(near.values()) + near.get(i, 0) for i, near in graph.items()}
        total = sum(degree.values()) if total is None else total
        if not total:
            return member
        of, weight, moved_ever, moved = {i: i for i in graph}, dict(degree), False, True
        # A node stays where it is while no community of its neighbours, nor its own, has changed since it was looked at.
        now, changed, looked = 0, dict.fromkeys(graph, 0), dict.fromkeys(graph, -1)
        while moved:
            moved = False
            for i, near in graph.items():
                home, before = of[i], looked[i]
                if changed[home] <= before and all(changed[of[j]] <= before for j in near):
                    continue
                into: dict[int, float] = {}
                for j, w in near.items():
                    if j != i:
                        c = of[j]
                        into[c] = into.get(c, 0) + w
                own = degree[i]
                weight[home] -= own
                stay = into.get(home, 0) - own * weight[home] / total
                best, most = home, stay
                for c, w in into.items():  # the least of those that tie
                    gain = w - own * weight[c] / total
                    if gain > most or (gain == most and c < best):
                        best, most = c, gain
                if most > stay + 1e-12:
                    of[i], moved, moved_ever, now = best, True, True, now + 1
                    changed[home] = changed[best] = now
                weight[of[i]] += own
                looked[i] = now
        if not moved_ever:
            return member
        place = {c: k for k, c in enumerate(dict.fromkeys(of.values()))}
        merged: dict[int, dict[int, float]] = {k: {} for k in place.values()}
        for i, near in graph.items():
            for j, w in near.items():
                a, b = place[of[i]], place[of[j]]
                # Two nodes of one community give their link from both ends, which is what a loop's two ends are.
                merged[a][b] = merged[a].get(b, 0) + (w / 2 if a == b and i != j else w)
        graph = merged
        member = {v: place[of[i]] for v, i in member.items()}


def _parts_of_few(links: DataFrame) -> DataFrame:
    """(node, part) of links (a, b) that one task holds; a part is named by any of its nodes."""

    def run(frames):
        import pandas as pd

        over: dict = {}

        def root(x):
            while over.setdefault(x, x) != x:
                over[x] = over[over[x]]
                x = over[x]
            return x

        for frame in frames:
            for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
                a, b = root(a), root(b)
                over[a] = b
        nodes = list(over)
        if nodes:
            yield pd.DataFrame({"node": nodes, "part": [root(x) for x in nodes]})

    kind = dict(links.dtypes)["a"]
    return links.repartition(1).mapInPandas(run, f"node {kind}, part {kind}")


def connected(links: DataFrame) -> DataFrame:
    """(node, part): the least node that links (a, b) lead to from each node that has any.

    Every round puts each node together with the one of itself and its neighbours
    that comes first by a hash of that round, and goes on with the links between
    those that are left: they shrink by a share a round, whatever the length of
    chains and the size of parts. One task does the rest once it is small.
    """
    apart = F.col("a") != F.col("b")
    left = stored(links.where(apart).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds: list[DataFrame] = []
    while left.count() > FEW_LINKS:
        rank = lambda c, k=len(rounds): F.struct(F.xxhash64(c, F.lit(k)), F.col(c).alias("node"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(rank("b")).alias("near")).select(F.col("a").alias("node"), F.least("near", rank("a"))["node"].alias("part"))
        first = stored(first, "firsts")
        to = lambda end: first.select(F.col("node").alias(end), F.col("part").alias(f"to_{end}")).hint("merge")  # noqa: E731, B023
        moved = left.join(to("a"), "a").join(to("b"), "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        left = stored(moved.where(apart).distinct(), "links")
        rounds.append(first)
    found = _parts_of_few(left)
    for first in reversed(rounds):  # a node without links in later rounds is its part
        later = found.select(F.col("node").alias("part"), F.col("part").alias("last"))
        found = first.join(later.hint("merge"), "part", "left").select("node", F.coalesce("last", "part").alias("part"))
    found = stored(found, "parts")
    least = found.groupBy("part").agg(F.min("node").alias("least"))
    return found.join(least.hint("merge"), "part").select("node", F.col("least").alias("part"))


def communities(files: DataFrame, links: DataFrame) -> DataFrame:
    """(directory, path, community) of the files of each directory.

    ``links`` has a, b and weight; only those within a directory count. A task
    takes a connected part of a directory at a time, whose files are what is
    bounded here; small directories and those without links stay whole.
    Communities are numbered in the order of their first files.
    """
    # Files are numbers in the order of their paths from here on.
    each = files.select(T.dirname(F.col("path")).alias("directory"), "path").distinct()
    placed = stored(each.repartitionByRange("directory", "path").sortWithinPartitions("directory", "path").withColumn("id", F.monotonically_increasing_id()), "files")
    pairs = links.where("a <> b").select(T.dirname(F.col("a")).alias("directory"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight", T.dirname(F.col("b")).alias("other"))
    summed = pairs.where("directory = other").groupBy("directory", "a", "b").agg(F.sum("weight").cast("double").alias("weight"))
    known = lambda end: placed.select(F.col("path").alias(end), F.col("id").alias(f"id_{end}")).hint("merge")
    inside = stored(summed.join(known("a"), "a").join(known("b"), "b").select("directory", F.col("id_a").alias("a"), F.col("id_b").alias("b"), "weight"), "inside")
    sizes = placed.groupBy("directory").agg(F.count("*").alias("files"))
    large = stored(inside.groupBy("directory").agg((F.sum("weight") * 2).alias("total")).join(sizes.hint("merge"), "directory").where(F.col("files") >= SMALL_DIRECTORY).select("directory", "total"), "directories")
    parts = connected(inside)
    linked = inside.join(large.hint("merge"), "directory").join(parts.withColumnRenamed("node", "a").hint("merge"), "a")

    def group(edges):
        import pandas as pd

        a, b = edges["a"].tolist(), edges["b"].tolist()
        near = dict(zip(zip(a, b, strict=True), edges["weight"].tolist(), strict=True))
        ids = sorted({*a, *b})
        found = louvain(near, ids, float(edges["total"].iloc[0]))
        first: dict[int, int] = {}
        for i in ids:
            first.setdefault(found[i], i)
        return pd.DataFrame({"id": ids, "first": [first[found[i]] for i in ids]})

    grouped = spread(linked, "part").groupBy("part").applyInPandas(group, "id long, first long")
    # A file without links is a community of its own in a directory that has any, and of its directory else.
    first = F.when(F.col("total").isNotNull(), F.coalesce("first", "id")).otherwise(-1)
    firsts = placed.join(large.hint("merge"), "directory", "left").join(grouped.hint("merge"), "id", "left").select("directory", "path", first.alias("first"))
    nth = F.dense_rank().over(Window.partitionBy("directory").orderBy("first")) - 1
    return firsts.select("directory", "path", nth.cast("long").alias("community"))


def components(files: DataFrame, links: DataFrame, scope_path: str = "") -> DataFrame:
    """(path, name): the component of each file.

    A component is a directory in a small scope, else a community of its files.
    It is named by the prefix that all its files' names share, if that says more
    than the one that most of the scope shares; else by its file of the largest
    weighted degree, its directory below the scope and the number of its other
    files. Repeats of a name are numbered, larger components first.
    """
    small = files.select("path").distinct().agg((F.count("*") < SMALL_SCOPE).alias("small"))
    grouped = communities(files, links).join(F.broadcast(small)).withColumn("community", F.when(F.col("small"), 0).otherwise(F.col("community"))).drop("small")  # one row
    bare = grouped.withColumn("file", T.stem(F.col("path"))).withColumn("parts", F.split("file", "_"))
    scope = prefix_lengths(bare.withColumn("all", F.lit(0)), ["all"], F.col("parts"), MAJORITY).select(F.col("length").alias("scope"))
    keys = ["directory", "community"]
    shared = prefix_lengths(bare, keys, F.col("parts"), 1.0)
    degree = links.select(F.explode(F.array("a", "b")).alias("path"), "weight").groupBy("path").agg(F.sum("weight").alias("degree"))
    weighed = bare.join(degree, "path", "left").groupBy(*keys).agg(
        F.count("*").alias("files"), F.min("path").alias("first"), F.min("parts").alias("parts"), F.min_by("file", F.struct(-F.coalesce("degree", F.lit(0)), "path")).alias("hub")
    )
    named = weighed.join(shared, keys).join(F.broadcast(scope))  # one row
    below = F.regexp_replace(T.without_prefix(F.col("directory"), F.lit(scope_path)), "^/", "")
    hub = F.concat("hub", F.when(below != "", F.concat(F.lit(" ("), below, F.lit(")"))).otherwise(""), F.lit(" +"), (F.col("files") - 1).cast("string"))
    named = named.withColumn("base", F.when(F.col("files") == 1, F.array_join("parts", "_")).when(F.col("length") > F.col("scope"), F.array_join(F.slice("parts", F.lit(1), F.col("length")), "_")).otherwise(hub))
    nth = F.row_number().over(Window.partitionBy("base").orderBy(F.desc("files"), "first"))
    named = named.withColumn("name", F.when(nth == 1, F.col("base")).otherwise(F.concat("base", F.lit(" #"), nth.cast("string"))))
    return grouped.join(named.select(*keys, "name"), keys).select("path", "name")
