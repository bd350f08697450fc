"""Places that someone guards on purpose: groups of evidence within a function, scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.intervals import overlap_join
from lodestone.operators.ranking import sessions

# Words by which a message states a workaround and a comment warns, and the lines between two groups.
EXPLICIT_WORKAROUND = r"\b(errat(a|um)|silicon|work[- ]?arounds?|quirks?|glitch\w*|spurious|anomal\w*|alignment errors?|corrupt\w*|integrity|undocumented|chip rev\w*|hardware bug|hw bug|bad \w*\s?data)\b"
WARNING = r"\b(errat(a|um)|silicon|work[- ]?arounds?|quirks?|hack|bug in|hardware bug|anomal\w*|glitch\w*|spurious|corrupt\w*|undocumented|not documented|alignment errors?)\b"
GROUP_GAP = 8


def fence_candidates(signals: DataFrame, functions: DataFrame, commits: DataFrame) -> DataFrame:
    """(function_id, group_no, signal_id, start, end, weight, near, score) of each group of evidence in a function.

    ``signals`` has id, path, start, end, kind, snippet and detail (the commit of
    a git signal), ``functions`` id, path, start, end and level, ``commits`` sha
    and subject. Reverts weigh most, then commits that state a workaround and
    comments of four words or more that warn; other workaround comments weigh
    little and the rest nothing. Evidence lies in the innermost function around
    its first line and outside of any it is left out. The group is named by its
    weightiest evidence, the first of those that tie; ``near`` counts them all.
    """
    stated = F.coalesce("subject", F.lit("")).rlike("(?i)" + T.portable(EXPLICIT_WORKAROUND))
    warns = F.coalesce("snippet", F.lit("")).rlike("(?i)" + T.portable(WARNING)) & (F.size(F.split("snippet", r"\s+", -1)) >= 4)
    weight = (
        F.when(F.col("kind") == "git_revert", 5)
        .when((F.col("kind") == "git_workaround") & stated, 3)
        .when((F.col("kind") == "workaround_comment") & warns, 3)
        .when(F.col("kind") == "workaround_comment", 1)
        .otherwise(0)
    )
    subjects = commits.select(F.col("sha").alias("detail"), "subject")
    evidence = signals.join(subjects, "detail", "left").withColumn("weight", weight).where("weight > 0").select(F.col("id").alias("signal_id"), "path", "start", "end", "weight")
    ranges = functions.select("path", F.col("id").alias("function_id"), "level", F.col("start").alias("s"), F.col("end").alias("e"))
    around = overlap_join(evidence, ranges, "path", ("start", "start"), ("s", "e")).select("signal_id", "start", "end", "weight", "function_id", "level", "s", "e")
    inner = around.groupBy("signal_id", "start", "end", "weight").agg(F.min_by(F.struct("function_id", "level"), F.struct(F.col("e") - F.col("s"), -F.col("s"), "function_id")).alias("f"))
    grouped = sessions(inner.select("signal_id", "start", "end", "weight", "f.*"), ["function_id"], ["start", "signal_id"], F.col("start"), F.col("end"), GROUP_GAP, "group_no")
    anchor = F.min_by(F.struct("signal_id", "start", "end", "weight"), F.struct(-F.col("weight"), "start", "signal_id"))
    found = grouped.groupBy("function_id", "level", "group_no").agg(anchor.alias("a"), F.count("*").alias("near"))
    bonus = F.when(F.col("level") == "high", 2).when(F.col("level") == "medium", 1).otherwise(0)
    score = F.col("a.weight") + F.least(F.col("near") - 1, F.lit(4)) * 0.5 + bonus
    return found.select("function_id", "group_no", "a.*", "near", score.cast("double").alias("score"))
