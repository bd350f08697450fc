"""The pack for newcomers: open questions, where to start reading, architecture, and its text as ordered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.intervals import overlap_join
from lodestone.operators.ranking import top_per_key

# Comments that are looked at and open questions that are told, files to read, and functions and uses of each.
COMMENTS, MOST_UNKNOWNS = 40, 12
MOST_FILES, MOST_FUNCTIONS, MOST_USES, MOST_TOPS = 5, 2, 3, 3


def unknowns(signals: DataFrame, blame: DataFrame, commits: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, path, line, sha, text): workaround comments that their commit doesn't explain, then how many ends are open.

    Of the first 40 workaround comments by ``nth`` those whose line's commit (by
    ``blame``: path, start, end, sha) is a reason or a revert are explained; of
    the others the first 12 are told. The last row counts unresolved edges, if
    there are any.
    """
    # The wording.
    first = signals.where("kind = 'workaround_comment'").orderBy("nth").limit(COMMENTS).select("nth", "path", F.col("start").alias("line"), "snippet")
    owned = overlap_join(first.withColumnRenamed("line", "start"), blame.select("path", F.col("start").alias("s"), F.col("end").alias("e"), "sha"), "path", ("start", "start"), ("s", "e"))
    of = owned.groupBy("nth").agg(F.min(F.struct("s", "sha")).alias("b")).select("nth", "b.sha")
    told = first.join(of, "nth", "left").join(commits.select("sha", "rationale", "revert"), "sha", "left").where("NOT (coalesce(rationale, false) OR coalesce(revert, false))").orderBy("nth").limit(MOST_UNKNOWNS)
    why = F.when(F.col("sha").isNull(), "no commit explains it").otherwise("its commit doesn’t say why")
    text = F.concat(F.lit('The comment says "'), "snippet", F.lit('", but '), why, F.lit("."))
    ends = edges.where("resolution = 'unresolved'").agg(F.count("*").alias("n")).where("n > 0")
    open_ends = ends.select(
        F.lit(None).cast("long").alias("place"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("sha"),
        F.concat(F.col("n").cast("string"), F.lit(" call(s) or include(s) could not be followed (function pointers, callbacks, generated headers): what they reach is unknown.")).alias("text"),
    )
    return told.select(F.col("nth").cast("long").alias("place"), "path", F.col("line").cast("int").alias("line"), "sha", text.alias("text")).unionByName(open_ends)


def top_functions(symbols: DataFrame, key: str, most: int) -> DataFrame:
    """(key, functions): the short names of the most critical functions of each key, those without points left out; ties by id."""
    scored = symbols.where("kind = 'function' AND criticality > 0")
    best = top_per_key(scored, [key], [F.desc("criticality"), F.asc("id")], most, "_nth")
    return best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_nth", "name"))).alias("l")).select(key, F.transform("l", lambda x: F.substring_index(x["name"], "::", -1)).alias("functions"))


def reading_order(components: DataFrame, component_files: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, path, why, functions): the header that most files include, then the most critical file of each component, five in all.

    ``components`` has component, name and criticality, ``component_files``
    component and path, ``files`` path and criticality, ``edges`` kind,
    resolution and dst_path. Components come by criticality; a file that two
    reasons name is told for the first. Ties go by path and by component.
    """
    inside = files.select("path")
    included = edges.where("kind = 'includes' AND resolution = 'resolved'").groupBy(F.col("dst_path").alias("path")).agg(F.count("*").alias("n")).join(inside, "path", "left_semi")
    hub = included.orderBy(F.desc("n"), "path").limit(1).select(F.lit(0).alias("at"), "path", F.concat(F.lit("The interface everything else uses: included "), F.col("n").cast("string"), F.lit(" times.")).alias("why"))
    best = component_files.join(files, "path").groupBy("component").agg(F.min_by("path", F.struct(-F.col("criticality"), "path")).alias("path"))
    plain = F.regexp_replace("name", r" \+\d+$", "")
    # Each component names one file, and five rows are wanted, so few of the first components matter: a file belongs to one of them.
    named = components.join(best, "component").orderBy(F.desc("criticality"), "component").limit(MOST_FILES + 1)
    order = F.row_number().over(Window.orderBy(F.desc("criticality"), "component"))  # of six rows at most
    rest = named.select(order.alias("at"), "path", F.concat(F.lit("The most critical file of "), plain, F.lit(".")).alias("why"))
    told = top_per_key(hub.unionByName(rest), ["path"], [F.asc("at")], 1).orderBy("at").limit(MOST_FILES)
    placed = told.withColumn("place", F.row_number().over(Window.orderBy("at")))
    functions = top_functions(symbols.join(F.broadcast(told.select("path")), "path", "left_semi"), "path", MOST_FUNCTIONS)
    none = F.array().cast("array<string>")
    return placed.join(functions, "path", "left").select("place", "path", "why", F.coalesce("functions", none).alias("functions"))


def module_of(path: Column, depth: int) -> Column:
    """The first ``depth`` directories of a path, or the path itself where it has none."""
    cut = F.substring_index(T.dirname(path), "/", depth)
    return F.when(cut == "", path).otherwise(cut)


def module_links(uses: DataFrame) -> DataFrame:
    """(module, name, files, count, uses): what each module has to do with the scope, by files, then uses, then name.

    ``uses`` has module, file, path, line, header and nth, their order; the
    first three uses of a module are told as ``path:line header``.
    """
    counted = uses.groupBy("module").agg(F.count_distinct("file").alias("files"), F.count("*").alias("count"))
    few = top_per_key(uses, ["module"], [F.asc("nth")], MOST_USES, "_nth").groupBy("module").agg(F.array_sort(F.collect_list(F.struct("_nth", F.concat("path", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "header").alias("use")))).alias("l"))
    return counted.join(few, "module").select("module", T.basename(F.col("module")).alias("name"), "files", "count", F.transform("l", lambda x: x["use"]).alias("uses"))


def reach_in(couplings: DataFrame, includers: DataFrame, component_files: DataFrame, depth: int) -> DataFrame:
    """(module, header, component): the modules outside that include a header of a component's own.

    ``couplings`` has header and owner, ``includers`` header and path.
    """
    modules = includers.select("header", module_of(F.col("path"), depth).alias("module")).distinct()
    owner = component_files.select(F.col("path").alias("owner"), "component")
    return couplings.join(modules, "header").join(owner, "owner", "left").select("module", "header", "component")


def component_info(components: DataFrame, component_files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``components`` with files (how many) and functions, the three most critical ones of each."""
    sizes = component_files.groupBy("component").agg(F.count("*").alias("files"))
    tops = top_functions(symbols, "component", MOST_TOPS)
    return components.join(sizes, "component", "left").join(tops, "component", "left").withColumn("files", F.coalesce("files", F.lit(0))).withColumn("functions", F.coalesce("functions", F.array().cast("array<string>")))


def section(rows: DataFrame, number: int, nth: Column, line: Column) -> DataFrame:
    """Rows as lines of a document: (section, nth, line); a null line is none."""
    return rows.select(F.lit(number).alias("section"), nth.cast("long").alias("nth"), line.alias("line")).where("line IS NOT NULL")


def level_mark(level: Column) -> Column:
    return F.when(level == "high", "\U0001f534").when(level == "medium", "\U0001f7e0").otherwise("⚪")


def markdown(scope: Column, snapshot: DataFrame, cards: DataFrame, components: DataFrame, order: DataFrame, questions: DataFrame, used_by: DataFrame, depends_on: DataFrame) -> DataFrame:
    """The lines of the pack's document: (section, nth, line), in the order of both.

    ``snapshot`` is one row (repo, commit), ``cards`` has place, verdict, title,
    function, path, start and end; the others are what the functions above
    return, components with level and place and ``used_by`` and ``depends_on``
    from ``module_links``. No step holds the whole text.
    """
    # Headings and labels.
    head = F.concat(F.lit("# "), "repo", F.when(scope != "", F.concat(F.lit(" / "), scope)).otherwise(""), F.lit(" — onboarding pack"))
    told = F.concat(F.lit("Snapshot `"), "commit", F.lit("`. Every statement is labelled Verified / Inferred / Unknown and cites code or commits at this commit."))
    one = lambda number, nth, text: section(snapshot, number, F.lit(nth), F.lit(text))

    def names(number: int, nth: int, label: str, links: DataFrame) -> DataFrame:
        # Modules are few: they are directories of the scope's depth.
        every = links.agg(F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("f"), (-F.col("count")).alias("c"), "name"))).alias("l"))
        listed = F.array_join(F.transform("l", lambda x: F.concat(x["name"], F.lit(" ("), (-x["f"]).cast("string"), F.lit(")"))), ", ")
        return section(every, number, F.lit(nth), F.concat(F.lit(f"**{label}:** "), F.when(F.size("l") > 0, listed).otherwise("nothing outside the scope"), F.lit(".")))

    where = F.concat(F.lit("["), T.basename(F.col("path")), F.format_string(":%d–%d](", "start", "end"), F.lit("https://github.com/"), "repo", F.lit("/blob/"), "commit", F.lit("/"), "path", F.format_string("#L%d-L%d)", "start", "end"))
    own = cards.join(F.broadcast(snapshot))  # one row
    functions = F.array_join(F.transform("functions", lambda f: F.concat(F.lit("`"), f, F.lit("`"))), ", ")
    part = F.concat(F.lit("- "), level_mark(F.col("level")), F.lit(" **"), "name", F.format_string("** (%d files) — ", "files"), F.when(F.size("functions") > 0, functions).otherwise("no scored functions"))
    parts = [
        section(snapshot, 0, F.lit(0), head), section(snapshot, 0, F.lit(1), told), one(0, 2, ""),
        one(1, 0, "## System at a glance"), names(1, 1, "Used by", used_by), one(1, 2, ""), names(1, 3, "Depends on", depends_on), one(1, 4, ""),
        one(2, 0, "## What not to break"), section(own, 2, F.col("place") * 3 + 1, F.concat(F.lit("### "), "verdict", F.lit(" if changed: "), "title")), section(own, 2, F.col("place") * 3 + 2, F.concat(F.lit("`"), "function", F.lit("`, "), where)), section(own, 2, F.col("place") * 3 + 3, F.lit("")),
        one(3, 0, "## Components"), section(components, 3, F.col("place") + 1, part), one(4, 0, ""),
        one(5, 0, "## Open questions / unknowns"), section(questions, 5, F.coalesce("place", F.lit(1 << 40)) + 1, F.concat(F.lit("- **UNKNOWN** "), "text")), one(6, 0, ""),
        one(7, 0, "## Where to start reading"), section(order, 7, F.col("place"), F.concat(F.col("place").cast("string"), F.lit(". `"), "path", F.lit("` — "), "why")),
    ]
    lines = parts[0]
    for more in parts[1:]:
        lines = lines.unionByName(more)
    return lines


def write_document(lines: DataFrame, path: str, order: tuple[str, ...] = ("section", "nth")) -> None:
    """Writes a document's lines (column ``line``) as text files whose names, sorted, give its order; nothing passes the driver."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)
