"""Histories of lines: logs whose records hold the diff of a range, and the commit that brought a range's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources.repository import FIELD, GROUP, RECORD

#: Lines that an entry keeps of each side.
MOST_LINES = 40


def bare(line: Column) -> Column:
    """A line without its white space."""
    return F.regexp_replace(line, T.portable(r"\s") + "+", "")


def line_history(logs: DataFrame, most_commits: int = 8) -> DataFrame:
    """Entries of range logs (columns ``id`` and ``text``), the newest first.

    A record holds sha, author, email, seconds and message and, after the group
    mark, a diff of the range. Returns id, pos (from 0), sha, author_name,
    author_email, authored_at, message, subject, body, the message's flags
    (bugfix, rationale, revert, revert_of), added and removed (the first
    MOST_LINES lines of each side, heads of files left out) and truncated (the
    log ended at ``most_commits`` rather than at the lines' origin). Records
    without a group mark are none; a null text has no entries.
    """
    records = F.filter(F.split("text", RECORD, -1), lambda r: r.contains(GROUP))
    rows = logs.select("id", F.size(records).alias("n"), F.posexplode(records).alias("pos", "r"))
    field = F.split(F.substring_index("r", GROUP, 1), FIELD, 5)
    lines = F.split(F.expr(f"substring(r, instr(r, '{GROUP}') + 1)"), "\n", -1)

    def side(mark: str) -> Column:
        own = F.filter(lines, lambda x: x.startswith(mark) & ~x.startswith("+++") & ~x.startswith("---"))
        return F.transform(F.slice(own, 1, MOST_LINES), lambda x: F.substring(x, 2, 1 << 30))

    read = rows.select(
        "id",
        "pos",
        (F.col("n") >= most_commits).alias("truncated"),
        F.get(field, F.lit(0)).alias("sha"),
        F.get(field, F.lit(1)).alias("author_name"),
        F.get(field, F.lit(2)).alias("author_email"),
        F.timestamp_seconds(F.try_to_number(F.get(field, F.lit(3)), F.lit("999999999999")).cast("long")).alias("authored_at"),
        F.regexp_replace(F.coalesce(F.get(field, F.lit(4)), F.lit("")), r"^\s+|\s+$", "").alias("message"),
        side("+").alias("added"),
        side("-").alias("removed"),
    )
    message = F.col("message")
    return read.withColumns({"subject": T.subject(message), "body": T.body(message), **{k: v for k, v in T.message_flags(message).items() if k != "refs"}})


def introduced_by(history: DataFrame, present: DataFrame) -> DataFrame:
    """(id, sha): the oldest entry that added a line of the range as it reads today, white space left out.

    ``present`` has id and line, the range's lines now; lines of white space
    alone say nothing. A range whose lines no entry added has no row: they were
    moved or laid out anew.
    """
    wanted = present.select("id", bare(F.col("line")).alias("bare")).where("bare <> ''").distinct()
    added = history.select("id", "pos", "sha", F.explode("added").alias("line")).select("id", "pos", "sha", bare(F.col("line")).alias("bare"))
    return added.join(wanted, ["id", "bare"], "left_semi").groupBy("id").agg(F.max_by("sha", "pos").alias("sha"))
