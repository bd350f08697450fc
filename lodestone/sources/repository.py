"""Parsers of repository listings, logs and diffs, as DataFrame expressions.

The texts come from a connector (one row a listing, log record or diff); all of
them are split and read inside Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The control characters that frame the log's records, fields and changes.
RECORD, FIELD, GROUP = "\x1e", "\x1f", "\x1d"
# Modes of symbolic links and submodules, and the id of no object.
SYMLINK, SUBMODULE, NO_OBJECT = "120000", "160000", "0" * 40


def tree_entries(listings: DataFrame) -> DataFrame:
    """(path, blob_sha) of the files in NUL-framed tree listings (column ``text``).

    An entry is ``mode type sha``, a tab and the path, which may hold tabs.
    Submodules and symbolic links are no files.
    """
    entry = listings.select(F.explode(F.split("text", "\0", -1)).alias("e")).where("e <> ''")
    head = F.split(F.substring_index("e", "\t", 1), " +")
    parsed = entry.select(F.get(head, F.lit(0)).alias("mode"), F.get(head, F.lit(1)).alias("type"), F.get(head, F.lit(2)).alias("blob_sha"), F.regexp_extract("e", r"(?s)^[^\t]*\t(.*)$", 1).alias("path"))
    return parsed.where((F.col("type") == "blob") & (F.col("mode") != SYMLINK)).select("path", "blob_sha")


def log_entries(logs: DataFrame) -> DataFrame:
    """Commits of framed logs (column ``text``), in their order, with their raw changes.

    A record holds sha, author, email, seconds, message and, after the group
    mark, lines ``:mode mode old new status``, a tab, the path and for renames
    and copies the new path behind another tab.
    """
    record = logs.select(F.posexplode(F.split("text", RECORD, -1)).alias("log_pos", "r")).where(F.col("r") != "")
    field = F.split(F.substring_index("r", GROUP, 1), FIELD, 5)
    lines = F.filter(F.split(F.regexp_extract("r", f"(?s)^[^{GROUP}]*{GROUP}(.*)$", 1), "\n"), lambda x: x.startswith(":"))

    def change(line):
        head, paths = F.split(F.substring_index(line, "\t", 1), " "), F.split(line, "\t", -1)
        moved = F.size(paths) > 2
        return F.struct(
            F.substring(F.get(head, F.lit(4)), 1, 1).alias("status"),
            F.nullif(F.get(head, F.lit(2)), F.lit(NO_OBJECT)).alias("old_blob"),
            F.nullif(F.get(head, F.lit(3)), F.lit(NO_OBJECT)).alias("new_blob"),
            F.when(moved, F.get(paths, F.lit(2))).otherwise(F.get(paths, F.lit(1))).alias("path"),
            F.when(moved, F.get(paths, F.lit(1))).alias("old_path"),
        )

    return record.select(
        "log_pos",
        F.get(field, F.lit(0)).alias("sha"),
        F.get(field, F.lit(1)).alias("author_name"),
        F.get(field, F.lit(2)).alias("author_email"),
        F.timestamp_seconds(F.get(field, F.lit(3)).cast("long")).alias("authored_at"),
        F.regexp_replace(F.get(field, F.lit(4)), r"^\s+|\s+$", "").alias("message"),
        F.transform(lines, change).alias("changes"),
    )


def commit_files(log: DataFrame) -> DataFrame:
    """(commit, file, at): the files of each commit, for the history operators."""
    return log.select(F.col("sha").alias("commit"), F.explode("changes").alias("c"), F.col("authored_at").alias("at")).select("commit", F.col("c.path").alias("file"), "at").distinct()


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """Hunks of unified diffs without context (columns ``id`` and ``text``): paths, starts and counts.

    A missing count is 1, and a side that is ``/dev/null`` has no path.
    """
    files = diffs.select("id", F.posexplode(F.split("text", r"(?m)^diff --git ", -1)).alias("file_no", "f")).where("file_no > 0")
    side = lambda mark, prefix: F.nullif(F.regexp_replace(F.regexp_extract("f", rf"(?m)^{mark} ([^\t\n]*)", 1), f"^{prefix}/", ""), F.lit("/dev/null"))
    heads = files.select("id", "file_no", F.nullif(side("---", "a"), F.lit("")).alias("old_path"), F.nullif(side(r"\+\+\+", "b"), F.lit("")).alias("new_path"), F.posexplode_outer(F.regexp_extract_all("f", F.lit(r"(?m)^(@@ [^@]* @@)"), 1)).alias("hunk_no", "h"))
    number = lambda sign, group: F.regexp_extract("h", rf"{sign}(\d+)(?:,(\d+))?", group)
    count = lambda sign: F.when(F.col("h").isNotNull(), F.when(number(sign, 2) == "", 1).otherwise(F.try_to_number(number(sign, 2), F.lit("9999999999")).cast("int")))
    start = lambda sign: F.try_to_number(number(sign, 1), F.lit("9999999999")).cast("int")
    return heads.select("id", "file_no", "old_path", "new_path", "hunk_no", start("-").alias("old_start"), count("-").alias("old_count"), start(r"\+").alias("new_start"), count(r"\+").alias("new_count"))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """Changed lines of unified diffs: id, file_no, hunk_no, place, side (removed or added), text."""
    files = diffs.select("id", F.posexplode(F.split("text", r"(?m)^diff --git ", -1)).alias("file_no", "f")).where("file_no > 0")
    hunks = files.select("id", "file_no", F.posexplode(F.split("f", r"(?m)^@@ -", -1)).alias("hunk_no", "h")).where("hunk_no > 0")
    lines = hunks.select("id", "file_no", (F.col("hunk_no") - 1).alias("hunk_no"), F.posexplode(F.split("h", "\n", -1)).alias("place", "l")).where("place > 0 AND left(l, 1) IN ('-', '+')")
    return lines.select("id", "file_no", "hunk_no", "place", F.when(F.left("l", F.lit(1)) == "-", "removed").otherwise("added").alias("side"), F.substring("l", 2, 1 << 30).alias("text"))


def raw_diff(diffs: DataFrame) -> DataFrame:
    """(id, path, old_blob, new_blob) of NUL-framed raw diffs without renames (columns ``id`` and ``text``)."""
    entry = F.regexp_extract_all("text", F.lit("(?s):[0-7]+ [0-7]+ [0-9a-f]+ [0-9a-f]+ [A-Z][0-9]*\0[^\0]*"), 0)
    head = F.split(F.substring_index("e", "\0", 1), " ")
    return diffs.select("id", F.explode(entry).alias("e")).select("id", F.substring_index("e", "\0", -1).alias("path"), F.nullif(F.get(head, F.lit(2)), F.lit(NO_OBJECT)).alias("old_blob"), F.nullif(F.get(head, F.lit(3)), F.lit(NO_OBJECT)).alias("new_blob"))


def blame_ranges(blames: DataFrame) -> DataFrame:
    """Ranges of incremental line ownership listings (columns ``path`` and ``text``): path, start, end, sha, orig_path, orig_start.

    A record begins with the commit, its line, the line now and the number of
    lines, and ends with the file's name in that commit.
    """
    record = F.regexp_extract_all("text", F.lit(r"(?ms)^[0-9a-f]{40} \d+ \d+ \d+$.*?^filename [^\n]*"), 0)
    number = lambda k: F.regexp_extract("r", r"^[0-9a-f]{40} (\d+) (\d+) (\d+)", k).cast("int")
    return blames.select("path", F.explode(record).alias("r")).select(
        "path", number(2).alias("start"), (number(2) + number(3) - 1).alias("end"), F.left("r", F.lit(40)).alias("sha"), F.regexp_extract("r", r"(?m)^filename ([^\n]*)\z", 1).alias("orig_path"), number(1).alias("orig_start")
    )
