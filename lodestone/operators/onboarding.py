"""What a newcomer to a code base is told first: assumptions, interfaces, hidden couplings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

# Kinds of assumptions in the order they are told, and how many items a list holds.
ASSUMPTION_KINDS = ("isr", "timing", "timing_constant", "watchdog", "hw_register", "hw_access")
MOST_ASSUMPTIONS = 40
MOST_INTERFACES = 15
SOURCE_FILE = r"\.(c|cc|cpp|cxx)$"


def assumptions(signals: DataFrame, most: int = MOST_ASSUMPTIONS) -> DataFrame:
    """(kind, path, start, snippet): the first timing and hardware assumptions by kind, path and line.

    A snippet that a file repeats is told once, at its first place in that order.
    """
    place = F.array_position(F.array(*map(F.lit, ASSUMPTION_KINDS)), F.col("kind"))
    wanted = signals.where((F.col("source") == "static") & F.col("kind").isin(*ASSUMPTION_KINDS))
    first = wanted.groupBy("path", "snippet").agg(F.min(F.struct(place.alias("nth"), "start", "kind")).alias("at"))
    return first.select("at.nth", "at.kind", "path", "at.start", "snippet").orderBy("nth", "path", "start", "snippet").limit(most).drop("nth")


def interfaces(edges: DataFrame, most: int | None = MOST_INTERFACES) -> DataFrame:
    """(node, files, resolved): what code outside the scope includes or names, resolved uses first, then by files.

    ``edges`` has src, dst, method and resolution (0: resolved).
    """
    used = edges.where("method = 'reference_index'").groupBy(F.col("dst").alias("node"))
    found = used.agg(F.countDistinct("src").alias("files"), (F.min("resolution") == 0).alias("resolved"))
    return found if most is None else found.orderBy(F.desc("resolved"), F.desc("files"), "node").limit(most)


def hidden_couplings(files: DataFrame, includes: DataFrame) -> DataFrame:
    """(header, owner, includers): headers of one module that outside code includes in place of the public one.

    ``files`` has the scope's path, ``includes`` the resolved includes from
    outside it (path, line, header). A header belongs to the source whose name is
    its own or the longest part of it that ends before an underscore; of sources
    of one name the last path counts. The public header is the one included most,
    the least of those that tie; its own module's headers are no couplings.
    """
    stems = files.where(F.col("path").rlike(SOURCE_FILE)).groupBy(T.stem(F.col("path")).alias("stem")).agg(F.max("path").alias("owner"))
    used = includes.groupBy("header").agg(F.count("*").alias("includers"))
    public = used.orderBy(F.desc("includers"), "header").limit(1).select(F.col("header").alias("public"), T.stem(F.col("header")).alias("public_stem"))
    # A header meets only the names that may own it, so no header is compared with every source.
    parts = F.split(T.stem(F.col("header")), "_", -1)
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "_"))
    owned = used.withColumn("stem", F.explode(names)).join(stems, "stem").groupBy("header", "includers").agg(F.max_by(F.struct("stem", "owner"), F.length("stem")).alias("own"))
    other = owned.join(F.broadcast(public), (F.col("header") != F.col("public")) & (F.col("own.stem") != F.col("public_stem")))
    return other.select("header", F.col("own.owner").alias("owner"), "includers")
