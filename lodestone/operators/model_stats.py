"""Counts of a model, key commits of lines, scopes of changes and what touched code relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.intervals import lengths, overlap_join, overlap_length
from lodestone.operators.lineage import spread
from lodestone.operators.ranking import top_per_key

# Weights of a commit's lines, kinds of assumptions and how many are told of a function, lists' lengths, a reason's length.
REVERT, RATIONALE, BUGFIX = 4, 3, 2
ASSUMED, MOST_ASSUMED = ("timing", "timing_constant", "hw_register", "watchdog", "isr"), 4
MOST_SCANS, MOST_REVIEWS = 20, 30
LEAST_REASON, MOST_REASON = 10, 1000
STATES = ("SAFE", "RISKY", "DANGEROUS", "STOP")
#: Commits that are sent to every task; more are dealt out.
FEW_COMMITS = 100_000


def structure_stats(files: DataFrame, symbols: DataFrame, edges: DataFrame, external: DataFrame, reference_files: DataFrame) -> DataFrame:
    """One row of counts: files parsed, failed and unbalanced, symbols by kind, edges by resolution, files outside, calls that leave.

    ``files`` has parsed and unbalanced, ``symbols`` kind, ``edges`` src, method
    and resolution, ``external`` external_calls. Each part is one row.
    """
    of = lambda column, value: F.count_if(F.col(column) == value)
    parts = [
        files.agg(F.count_if("parsed").alias("files_parsed"), F.count_if(~F.col("parsed")).alias("parse_failures"), F.count_if("unbalanced").alias("unbalanced")),
        symbols.agg(F.count("*").alias("symbols"), of("kind", "function").alias("functions"), of("kind", "class").alias("classes"), of("kind", "macro").alias("macros")),
        edges.agg(
            *(of("resolution", r).alias(r) for r in ("resolved", "ambiguous", "unresolved")),
            F.count_distinct(F.when(F.col("method") == "reference_index", F.col("src"))).alias("boundary_files"),
        ),
        external.agg(F.coalesce(F.sum("external_calls"), F.lit(0)).alias("external_calls")),
        reference_files.agg(F.count("*").alias("reference_files")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part))
    return out


def key_commit_in(ranges: DataFrame, blame: DataFrame, commits: DataFrame) -> DataFrame:
    """(id, sha, points): the commit that says most about the lines of each range (id, path, start, end).

    A commit has a point for each line that ``blame`` (path, start, end, sha)
    gives it within the range, four times for a revert, three times for a
    reason, twice for a fix. The one whose lines come first wins ties.
    """
    times = F.when(F.col("revert"), REVERT).when(F.col("rationale"), RATIONALE).when(F.col("bugfix"), BUGFIX).otherwise(1)
    weights = commits.select("sha", times.alias("times"))
    few = weights.limit(FEW_COMMITS + 1).count() <= FEW_COMMITS
    owned = blame.select("path", F.col("start").alias("s"), F.col("end").alias("e"), "sha")
    asked = ranges.select("id", "path", "start", "end")
    known = lengths(asked, ("start", "end")), lengths(owned, ("s", "e"))
    weighed = owned.join(F.broadcast(weights) if few else weights.hint("merge"), "sha")
    met = overlap_join(asked, weighed, "path", ("start", "end"), ("s", "e"), known=known)
    lines = overlap_length((F.col("start"), F.col("end")), (F.col("s"), F.col("e")))
    # One shuffle by range serves both steps.
    own = spread(met.select("id", "sha", "s", (lines * F.col("times")).alias("points")), "id")
    points = own.groupBy("id", "sha").agg(F.sum("points").alias("points"), F.min("s").alias("first"))
    return points.groupBy("id").agg(F.max_by(F.struct("sha", "points"), F.struct("points", -F.col("first"), "sha")).alias("k")).select("id", "k.*")


def touched_assumptions(touched: DataFrame, signals: DataFrame) -> DataFrame:
    """(id, start, text): up to four timing and hardware assumptions inside each touched function (id, name, path, start, end), by ``nth``."""
    own = touched.select("id", "name", "path", F.col("start").alias("first"), F.col("end").alias("last"))
    told = signals.where(F.col("kind").isin(*ASSUMED)).select("path", "start", "kind", "snippet", "nth")
    met = overlap_join(told, own, "path", ("start", "start"), ("first", "last")).select("id", "name", "start", "kind", "snippet", "nth")
    # Fixed value: the wording; the first underscore of a kind is a space.
    words = F.regexp_replace("kind", "^([^_]*)_", "$1 ")
    text = F.concat(F.substring_index("name", "::", -1), F.lit(" relies on "), words, F.format_string(" at line %d: `", "start"), "snippet", F.lit("`"))
    return top_per_key(met, ["id"], [F.asc("nth")], MOST_ASSUMED).select("id", "start", text.alias("text"))


def analysed_scopes(changes: DataFrame, scans: DataFrame, directories: DataFrame) -> DataFrame:
    """(review_id, scope, scan_covers): the scope that a review analyses.

    It is the scan's (review_id, scope) if any changed source (review_id, path)
    lies inside it, else the directory (review_id, directory) that all changed
    sources share. The empty scope holds all.
    """
    met = changes.where(T.is_source(F.col("path"))).join(scans, "review_id")
    inside = met.where((F.col("scope") == "") | (F.col("path") == F.col("scope")) | F.startswith("path", F.concat("scope", F.lit("/"))))
    covered = inside.groupBy("review_id").agg(F.min("scope").alias("covered"))
    every = changes.select("review_id").distinct().join(covered, "review_id", "left").join(directories, "review_id", "left")
    return every.select("review_id", F.coalesce("covered", "directory", F.lit("")).alias("scope"), F.col("covered").isNotNull().alias("scan_covers"))


def newest(rows: DataFrame, keys: list[str], at: str, tie: str, most: int) -> DataFrame:
    """The newest rows of each owner: 20 scans, 30 reviews."""
    return top_per_key(rows, keys, [F.desc(at), F.desc(tie)], most)


def valid_overrides(overrides: DataFrame) -> DataFrame:
    """Overrides (verdict, reason) that count: of a verdict, with a reason of ten characters or more, of which a thousand are kept."""
    reason = F.regexp_replace(F.coalesce("reason", F.lit("")), r"^\s+|\s+$", "")
    return overrides.withColumn("reason", F.left(reason, F.lit(MOST_REASON))).where(F.col("verdict").isin(*STATES) & (F.length(reason) >= LEAST_REASON))


def deletion_counts(snapshots: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(snapshot_id, table, rows): what goes with each snapshot; tables without rows of one have none."""
    parts = [df.join(snapshots, "snapshot_id", "left_semi").groupBy("snapshot_id").agg(F.count("*").alias("rows")).withColumn("table", F.lit(name)) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("snapshot_id", "table", "rows")
