"""From parsed sources to a graph: symbols, resolved calls, includes, macro uses, outside references.

``parsed`` is what ``sources.c_structure.structure`` returns. Names are resolved
by joins on candidate sets that were summed up beforehand, so a name that many
functions have and many calls use makes no pairs. Where several definitions
fit, the first one in the order of paths and places is the target; the whole
set is to be had from ``candidates`` by the edge's ``candidate_key``. No join is
a broadcast: what is exploded or parsed is many times as large as estimated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

# Method names that say nothing about a class, and the least length of a telling name.
GENERIC_NAMES = (
    "init update start stop read write reset begin end get set run loop setup enable disable available healthy handle process check clear flush "
    "open close send receive name type value data size count length"
).split()
TELLING = 5
# Fixed value: the folder that includes are looked up in besides the includer's own and the root.
INCLUDE_ROOT = "libraries/"


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def symbols(parsed: DataFrame) -> DataFrame:
    """(id, path, ordinal, name, short_name, kind, start, end, signature, class_name); repeats of a name in a file get ~2, ~3."""
    rows = parsed.select("path", F.posexplode("symbols").alias("ordinal", "s"))
    return rows.select(F.concat(F.lit("sym:"), "path", F.lit("#"), "s.name", "s.suffix").alias("id"), "path", "ordinal", *(f"s.{c}" for c in ("name", "short_name", "kind", "start", "end", "signature", "class_name")))


def _of_function(parsed: DataFrame, column: str) -> DataFrame:
    """The rows of a list with the function that each belongs to."""
    rows = parsed.select("path", "symbols", F.posexplode(column).alias("place", "x")).withColumn("f", F.get("symbols", F.col("x.from")))
    return rows.select(F.concat(F.lit("sym:"), "path", F.lit("#"), "f.name", "f.suffix").alias("caller"), F.col("f.class_name").alias("caller_class"), "path", "place", "x.*").drop("from")


def _keyed(functions: DataFrame, tier: int, key: Column) -> DataFrame:
    """Definitions of a tier by key: those of one full name count once, in the place of the first and with the id of the last."""
    order = F.struct("path", "ordinal")
    return functions.select(F.lit(tier).alias("tier"), key.alias("key"), "name", "id", order.alias("order")).where("key IS NOT NULL").groupBy("tier", "key", "name").agg(F.min("order").alias("order"), F.max_by("id", "order").alias("id"))


def candidates(symbols: DataFrame) -> DataFrame:
    """(tier, key, name, order, id): what a call could mean, by the way it is written.

    Tier 0: named with its class; 1: own class; 2: no class; 3: any.
    """
    functions = symbols.where("kind = 'function'")
    last = F.substring_index("class_name", "::", -1)
    tiers = (
        _keyed(functions, 0, F.concat("short_name", F.lit("\0"), last)),
        _keyed(functions, 1, F.col("name")),
        _keyed(functions.where("class_name IS NULL"), 2, F.col("short_name")),
        _keyed(functions, 3, F.col("short_name")),
    )
    return reduce(DataFrame.unionByName, tiers)


def _sets(found: DataFrame) -> DataFrame:
    return found.groupBy("tier", "key").agg(F.count("*").alias("n"), F.min_by("id", "order").alias("first"))


def resolve_calls(parsed: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every call site with its resolution: caller, path, line, name, resolution, target, candidates, candidate_key.

    A call with a class in front means that class's functions; a plain one its
    own class's, else functions without a class, else any; one on an object any.
    One candidate is resolved unless the object hides the class, several are
    ambiguous, none is external.
    """
    sets = _sets(candidates(symbols))
    calls = _of_function(parsed, "calls")
    plain = F.col("qualifier").isNull() & ~F.col("member")
    keys = {
        0: F.when(F.col("qualifier").isNotNull(), F.concat("name", F.lit("\0"), "qualifier")),
        1: F.when(plain, F.concat("caller_class", F.lit("::"), "name")),
        2: F.when(plain, F.col("name")),
        3: F.when(F.col("qualifier").isNull(), F.col("name")),
    }
    nothing = F.concat(F.lit("\0"), "caller")  # no name begins so; calls without a key of a tier stay spread out
    for tier, key in keys.items():
        calls = calls.withColumn(f"key{tier}", F.coalesce(key, nothing)).join(sets.where(F.col("tier") == tier).select(F.col("key").alias(f"key{tier}"), F.struct(F.lit(tier).alias("tier"), "key", "n", "first").alias(f"set{tier}")).hint("merge"), f"key{tier}", "left")
    best = F.coalesce(*(F.col(f"set{tier}") for tier in keys))
    return calls.withColumn("best", best).select(
        "caller",
        "path",
        "place",
        "line",
        "name",
        F.when(F.col("best").isNull(), "external").when((F.col("best.n") == 1) & ((F.col("best.tier") < 3) | ~F.col("member")), "resolved").otherwise("ambiguous").alias("resolution"),
        F.col("best.first").alias("target"),
        F.coalesce("best.n", F.lit(0)).alias("candidates"),
        F.when(F.col("best.n") > 1, F.struct("best.tier", "best.key")).alias("candidate_key"),
    )


def external_calls(calls: DataFrame) -> DataFrame:
    """(caller, external_calls): calls of names that no source defines."""
    return calls.where("resolution = 'external'").groupBy("caller").agg(F.count("*").alias("external_calls"))


def resolve_includes(parsed: DataFrame, paths: DataFrame) -> DataFrame:
    """Every include with its resolution: path, line, place, include, system, resolution, target, candidates.

    Looked up beside the includer, below the include root and from the root of
    the repository; else by the end of paths, where several that fit are
    ambiguous. ``paths`` has a path of every file; each is entered under all its
    ends, whose number is its depth.
    """
    known = paths.select("path").distinct()
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    by_end = known.select("path", F.explode(ends).alias("include")).groupBy("include").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    rows = parsed.select("path", F.posexplode("includes").alias("place", "x")).select("path", "place", "x.line", F.col("x.path").alias("include"), "x.system")
    tries = (T.normalize_path(F.concat(T.dirname(F.col("path")), F.lit("/"), "include")), F.concat(F.lit(INCLUDE_ROOT), "include"), F.col("include"))
    for k, at in enumerate(tries):
        rows = rows.withColumn(f"t{k}", at).join(known.select(F.col("path").alias(f"t{k}"), F.lit(True).alias(f"is{k}")).hint("merge"), f"t{k}", "left")
    direct = F.coalesce(*(F.when(F.col(f"is{k}"), F.col(f"t{k}")) for k in range(len(tries))))
    found = rows.withColumn("direct", direct).join(by_end.hint("merge"), "include", "left")
    resolution = F.when(F.col("direct").isNotNull() | (F.col("n") == 1), "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return found.select("path", "line", "place", "include", "system", resolution.alias("resolution"), F.coalesce("direct", "first").alias("target"), F.when(F.col("direct").isNotNull(), 1).otherwise(F.coalesce("n", F.lit(0))).alias("candidates"))


def macro_uses(parsed: DataFrame, symbols: DataFrame) -> DataFrame:
    """First use of each macro in each function: caller, path, line, name, resolution, target."""
    macros = symbols.where("kind = 'macro'").groupBy("name").agg(F.count("*").alias("n"), F.min_by("id", F.struct("path", "ordinal")).alias("target"))
    used = _of_function(parsed, "names_in_functions").join(macros.hint("merge"), "name")
    return used.select("caller", "path", "place", "line", "name", F.when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("resolution"), "target", F.col("n").alias("candidates"))


def reference_index(symbols: DataFrame, outside: DataFrame) -> DataFrame:
    """Names in files outside the scope that only the scope defines: path, line, name, kind, resolution, target, candidates.

    Generic method names, short macros and what is defined outside too tell
    nothing about the scope. A method named without its object stays ambiguous.
    """
    method = (F.col("kind") == "function") & F.col("class_name").isNotNull()
    generic = F.col("short_name").isin(GENERIC_NAMES) | (F.length("short_name") < TELLING)
    telling = symbols.where(~(method & generic) & ~((F.col("kind") == "macro") & (F.length("name") < TELLING)))
    elsewhere = outside.select(F.explode("symbols").alias("s")).select(F.col("s.short_name").alias("short_name")).distinct()
    own = telling.join(elsewhere.hint("merge"), "short_name", "left_anti").withColumn("order", F.struct("path", "ordinal"))
    named = own.groupBy("short_name", "name").agg(F.min("order").alias("order"), F.max_by(F.struct("id", "kind", method.alias("method")), "order").alias("s"))
    index = named.groupBy("short_name").agg(F.count("*").alias("n"), F.min_by("s", "order").alias("s"), F.bool_and("s.method").alias("methods"))
    names = outside.select("path", F.explode("names").alias("x")).select("path", F.col("x.name").alias("short_name"), "x.line")
    kind = F.when(F.col("s.kind") == "macro", "uses_macro").when(F.col("s.kind") == "class", "references").otherwise("calls")
    resolution = F.when((F.col("n") == 1) & ~F.col("methods"), "resolved").otherwise("ambiguous")
    return names.join(index.hint("merge"), "short_name").select("path", "line", F.col("short_name").alias("name"), kind.alias("kind"), resolution.alias("resolution"), F.col("s.id").alias("target"), F.col("n").alias("candidates"))


def edges(parsed: DataFrame, symbols: DataFrame, paths: DataFrame, outside: DataFrame | None = None) -> DataFrame:
    """The graph: src, dst, kind, method, resolution, candidates, path, line, weight.

    Repeats of (src, dst, kind) are one edge with their number as the weight and
    the rest as of the first. Nodes are symbols, ``file:`` paths and ``open:`` ends.
    """
    calls, includes = resolve_calls(parsed, symbols).where("resolution <> 'external'"), resolve_includes(parsed, paths)
    indirect = _of_function(parsed, "indirect_calls")

    def rows(df, step, src, dst, kind, method, resolution="resolution", n="candidates", place="place"):
        named = lambda x: F.lit(x[1:]) if x.startswith("=") else F.expr(x)
        return df.select(src.alias("src"), dst.alias("dst"), named(kind).alias("kind"), F.lit(method).alias("method"), named(resolution).alias("resolution"), F.expr(n).cast("long").alias("candidates"), "path", "line", F.struct(F.lit(step).alias("step"), "path", F.expr(place).cast("long").alias("place")).alias("order"))

    opened = includes.where("resolution = 'unresolved' AND NOT system")
    closed = includes.where("resolution <> 'unresolved'")
    parts = [
        rows(calls, 0, F.col("caller"), F.col("target"), "=calls", "name_match"),
        rows(indirect, 1, F.col("caller"), F.concat(F.lit("open:"), "caller", F.lit(":"), F.col("line").cast("string")), "=calls", "name_match", "=unresolved", "0"),
        rows(macro_uses(parsed, symbols), 2, F.col("caller"), F.col("target"), "=uses_macro", "name_match"),
        rows(opened, 3, file_id(F.col("path")), F.concat(F.lit("open:include:"), "include"), "=includes", "include_path"),
        rows(closed, 3, file_id(F.col("path")), file_id(F.col("target")), "=includes", "include_path"),
    ]
    if outside is not None:
        deep = parsed.select(F.col("path").alias("target")).distinct()
        into = resolve_includes(outside, paths).join(deep.hint("merge"), "target", "left_semi")
        parts += [
            rows(into, 4, file_id(F.col("path")), file_id(F.col("target")), "=includes", "reference_index"),
            rows(reference_index(symbols, outside), 5, file_id(F.col("path")), F.col("target"), "kind", "reference_index", place="line"),
        ]
    first = F.min_by(F.struct("method", "resolution", "candidates", "path", "line"), "order").alias("e")
    return reduce(DataFrame.unionByName, parts).groupBy("src", "dst", "kind").agg(first, F.count("*").alias("weight")).select("src", "dst", "kind", "e.*", "weight")


def boundary(edges: DataFrame) -> DataFrame:
    """Files outside the scope that name or include what is inside."""
    return edges.where("method = 'reference_index'").select(F.substring("src", 6, 1 << 30).alias("path")).distinct()
