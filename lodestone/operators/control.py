"""Control tables: snapshots, runs, token counts, cached answers, as DataFrame merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_absent(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with those rows of ``new`` whose key it lacks; of new rows of one key one goes in."""
    return table.unionByName(new.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def upsert(table: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row for each key of both tables: the last by ``at``, new rows before old ones of the same time."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*table.columns), F.struct(at, "_new")).alias("r"))
    return last.select("r.*")


def scan_once(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Requests with the finished or active run of their snapshot, if there is one: run_id, else null.

    ``runs`` has run_id, snapshot_id, state and at; failed ones don't count and
    finished ones come before those that still run.
    """
    usable = runs.where("state <> 'failed'")
    best = usable.groupBy("snapshot_id").agg(F.max_by("run_id", F.struct(F.col("state") == "done", "at")).alias("run_id"))
    return requests.join(best, "snapshot_id", "left")


def mark_interrupted(runs: DataFrame) -> DataFrame:
    """Runs that were queued or running when the service stopped have failed."""
    return runs.withColumn("state", F.when(F.col("state").isin("queued", "running"), "failed").otherwise(F.col("state")))


def token_totals(ledger: DataFrame) -> DataFrame:
    """(run_id, tokens): tokens of the calls of each run, answers from the cache left out."""
    return ledger.groupBy("run_id").agg(F.coalesce(F.sum(F.when(~F.col("cached"), F.col("tokens"))), F.lit(0)).alias("tokens"))


def delete_with_references(references: DataFrame, objects: DataFrame, deleted: DataFrame, keys: tuple[str, str]) -> DataFrame:
    """Objects that no owner refers to any more once some owners are deleted.

    ``references`` has owner and object columns named by ``keys``.
    """
    owner, thing = keys
    left = references.join(deleted.select(owner), owner, "left_anti").select(thing)
    touched = references.join(deleted.select(owner), owner, "left_semi").select(thing).distinct()
    return objects.join(touched, thing, "left_semi").join(left, thing, "left_anti")


def permalink(repo: Column, sha: Column, path: Column, start: Column, end: Column) -> Column:
    """The web address of lines of a file at a commit."""
    lines = F.when(start.isNotNull(), F.concat(F.lit("#L"), start.cast("string"), F.when(end > start, F.concat(F.lit("-L"), end.cast("string"))).otherwise("")))
    return F.concat(F.lit("https://github.com/"), repo, F.lit("/blob/"), sha, F.lit("/"), path, F.coalesce(lines, F.lit("")))


def citation_label(kind: Column, path: Column, start: Column, end: Column, sha: Column) -> Column:
    """Short text of a citation: path and lines of code, the first digits of a commit."""
    code = F.concat(path, F.when(start.isNotNull(), F.concat(F.lit(":"), start.cast("string"), F.when(end > start, F.concat(F.lit("-"), end.cast("string"))).otherwise(""))).otherwise(""))
    return F.when(kind == "commit", F.substring(sha, 1, 8)).otherwise(code)
