"""Co-change mining: pairs of files that commits touch together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.lineage import spread


def once(touched: DataFrame) -> DataFrame:
    """(commit, file) without repeats and nulls.

    Rows are dealt out by commit first: hardly one repeats, so a task that reads
    many would hold them all. The pairs of a commit are made where its files are.
    """
    return spread(touched.dropna(subset=["commit", "file"]).select("commit", "file"), "commit").distinct()


def commit_pairs(touched: DataFrame, max_files: int = 25) -> DataFrame:
    """(commit, file_a, file_b), a before b, of commits that touch 2 to ``max_files`` files.

    Larger commits are sweeps. They are counted, not gathered, before they are
    dropped, so no task holds one, and what is gathered is bounded.
    """
    own = once(touched)
    fit = own.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n").between(2, max_files)).select("commit")
    sets = own.join(fit.hint("merge"), "commit", "left_semi").groupBy("commit").agg(F.array_sort(F.collect_list("file")).alias("files"))
    return sets.select("commit", F.posexplode("files").alias("at", "file_a"), "files").select("commit", "file_a", F.explode(F.expr("slice(files, at + 2, size(files))")).alias("file_b"))


def pairs(touched: DataFrame, min_support: int = 3, max_files: int = 25) -> DataFrame:
    """Pairs of files touched by the same commits, with support and strength.

    ``touched`` has ``commit`` and ``file``; repeated rows count once and null
    keys are ignored. Strength is support over the smaller number of commits of
    the two files, sweeps included.
    """
    found = commit_pairs(touched, max_files).groupBy("file_a", "file_b").agg(F.count("*").alias("support")).where(F.col("support") >= min_support)
    commits = once(touched).groupBy("file").agg(F.count("*").alias("n"))
    return (
        found.join(commits.select(F.col("file").alias("file_a"), F.col("n").alias("n_a")), "file_a")
        .join(commits.select(F.col("file").alias("file_b"), F.col("n").alias("n_b")), "file_b")
        .select("file_a", "file_b", "support", (F.col("support") / F.least("n_a", "n_b")).alias("strength"))
    )


def recent_commits(touched: DataFrame, when: DataFrame, min_support: int = 3, max_files: int = 25, n: int = 5) -> DataFrame:
    """(file_a, file_b, commits): the newest ``n`` common commits of each pair as one string.

    ``when`` has commit and at. The newest are kept by rank, not by gathering all.
    """
    from lodestone.operators.ranking import top_per_key

    found = commit_pairs(touched, max_files)
    enough = found.groupBy("file_a", "file_b").agg(F.count("*").alias("k")).where(F.col("k") >= min_support).drop("k")
    dated = found.join(enough, ["file_a", "file_b"], "left_semi").join(when, "commit")
    ranked = top_per_key(dated, ["file_a", "file_b"], [F.desc("at"), F.desc("commit")], n, "r")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "commit"))), lambda x: x["commit"].cast("string")), ",")
    return ranked.groupBy("file_a", "file_b").agg(joined.alias("commits"))
