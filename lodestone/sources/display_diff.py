"""Unified diffs with context, for display: files with counters and rows with both line numbers.

``diffs`` has columns ``id`` and ``text``. A null or empty text has no files.
Only lines between a hunk's head and the next head are rows, so a removed line
that reads like a file's head stays one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Files of a diff and rows of a file that are shown.
MOST_FILES = 60
MOST_LINES = 600

_HUNK = r"(?dm)^(?=@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"


def _files(diffs: DataFrame, most_files: int) -> DataFrame:
    """(id, file_no, parts): what comes before the first hunk of each file, then its hunks."""
    files = diffs.select("id", F.posexplode(F.split("text", r"(?dm)^diff --git ", -1)).alias("file_no", "f"))
    return files.where(F.col("file_no").between(1, most_files)).select("id", "file_no", F.split("f", _HUNK, -1).alias("parts"))


def _rows_of(hunk: Column) -> Column:
    """The rows of a hunk, marks included."""
    return F.filter(F.split(hunk, "\n", -1), lambda l: F.left(l, F.lit(1)).isin("+", "-", " "))


def _marked(hunks: Column, mark: str) -> Column:
    """How many rows of the hunks have a mark."""
    return F.aggregate(hunks, F.lit(0), lambda n, h: n + F.size(F.filter(F.split(h, "\n", -1), lambda l: F.startswith(l, F.lit(mark)))))


def diff_files(diffs: DataFrame, most_files: int = MOST_FILES, most_lines: int = MOST_LINES) -> DataFrame:
    """(id, file_no, path, status, binary, additions, deletions, truncated): counted past the cap of rows, without a shuffle."""
    head = F.get("parts", F.lit(0))
    hunks = F.slice("parts", 2, F.size("parts"))
    named = lambda mark: F.nullif(F.regexp_extract("head", rf"(?dm)^{mark} \"?([^\t\n\"]*)", 1), F.lit(""))
    side = lambda c, prefix: F.regexp_replace(F.nullif(c, F.lit("/dev/null")), f"^{prefix}/", "")
    read = _files(diffs, most_files).select("id", "file_no", head.alias("head"), hunks.alias("hunks")).select(
        "*", named("---").alias("before"), named(r"\+\+\+").alias("after"), F.regexp_extract("head", r"(?d)\Aa/.+ b/([^\n]+)", 1).alias("said"), F.regexp_extract("head", r"(?dm)^Binary files [^\n]*", 0).alias("odd"),
        _marked(F.col("hunks"), "+").alias("additions"), _marked(F.col("hunks"), "-").alias("deletions"), _marked(F.col("hunks"), " ").alias("context"),
    )
    old, new = side(F.col("before"), "a"), side(F.col("after"), "b")
    status = (
        F.when(F.col("after").isNotNull(), F.when(old.isNull(), "added").when(new.isNull(), "deleted").otherwise("modified"))
        .when(F.contains("odd", F.lit("/dev/null and")), "added")
        .when(F.endswith("odd", F.lit("and /dev/null differ")), "deleted")
        .otherwise("modified")
    )
    path = F.when(F.col("after").isNotNull(), F.coalesce(new, old, "said")).otherwise(F.col("said"))
    return read.select("id", "file_no", path.alias("path"), status.alias("status"), (F.col("odd") != "").alias("binary"), "additions", "deletions", (F.col("additions") + F.col("deletions") + F.col("context") > most_lines).alias("truncated"))


def diff_rows(diffs: DataFrame, most_files: int = MOST_FILES, most_lines: int = MOST_LINES) -> DataFrame:
    """(id, file_no, hunk_no, row_no, kind, old, new, text): the first rows of each file, an added row without old number, a removed one without new.

    Both windows share one exchange by file, which moves the rows that are shown.
    """
    hunks = _files(diffs, most_files).select("id", "file_no", F.posexplode("parts").alias("hunk_no", "h")).where("hunk_no > 0")
    number = lambda k: F.regexp_extract("h", r"\A@@ -(\d+)(?:,\d+)? \+(\d+)", k).cast("int")
    # No more of a hunk than the cap of its file can be shown.
    rows = hunks.select("id", "file_no", "hunk_no", number(1).alias("old_start"), number(2).alias("new_start"), F.posexplode(F.slice(_rows_of(F.col("h")), 1, most_lines)).alias("place", "l"))
    mark = F.left("l", F.lit(1))
    file = Window.partitionBy("id", "file_no").orderBy("hunk_no", "place")
    before = Window.partitionBy("id", "file_no", "hunk_no").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda other: F.coalesce(F.count_if(mark != other).over(before), F.lit(0)).cast("int")
    placed = rows.withColumn("row_no", F.row_number().over(file)).where(F.col("row_no") <= most_lines)
    return placed.select(
        "id", "file_no", "hunk_no", "row_no", F.when(mark == "+", "add").when(mark == "-", "del").otherwise("ctx").alias("kind"),
        F.when(mark != "+", F.col("old_start") + seen("+")).alias("old"), F.when(mark != "-", F.col("new_start") + seen("-")).alias("new"), F.substring("l", 2, 1 << 30).alias("text"),
    )
