"""Validation of claims against the evidence that they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a claim may say of itself; statuses from the least certain to the most.
STATUSES = ("unknown", "inferred", "verified")
BASES = ("code_fact", "commit_statement", "comment_statement", "inference")
CONFIDENCES = ("low", "medium", "high")


def squash(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def quotes(text: str, quote: str) -> Column:
    """True if all pieces of a quote, which dots may part, stand in a text in their order; both are column names."""
    pieces = f"filter(split({quote}, '\\\\s*(?:\\\\.\\\\.\\\\.|…)\\\\s*', -1), p -> p <> '')"
    step = f"CASE WHEN at < 0 OR locate(p, {text}, at + 1) = 0 THEN -1 ELSE locate(p, {text}, at + 1) + length(p) - 1 END"
    return F.expr(f"size({pieces}) > 0 AND aggregate({pieces}, 0, (at, p) -> {step}) >= 0")


def rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATUSES)), status).cast("int")


def validate(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """The status that each claim's evidence allows, and why it is lower than claimed.

    ``claims`` has claim_id, packet, text, status, basis, confidence, cite (array
    of ids) and quote; ``evidence`` packet, id, kind (code, commit or other),
    text, status (of claims that are evidence themselves, else null). Only cited
    evidence of the claim's own packet counts, and a quote must stand in one of
    the cited texts. Claims without text are dropped. Columns: claim_id, text,
    claimed, status, basis, confidence, citations (ids of one kind once), reason.
    """
    known = lambda c, values, other: F.when(F.col(c).isin(*values), F.col(c)).otherwise(F.lit(other))
    quote = squash(F.col("quote"))
    own = claims.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(
        "claim_id", "packet", F.trim("text").alias("text"), known("status", STATUSES, "unknown").alias("claimed"), known("basis", BASES, "inference").alias("basis"),
        known("confidence", CONFIDENCES, None).alias("confidence"), F.coalesce("cite", F.array().cast("array<string>")).alias("cite"), F.nullif(quote, F.lit("")).alias("quote"),
    )
    cited = own.select("claim_id", "packet", "quote", F.posexplode("cite").alias("nth", "id")).where("id IS NOT NULL")
    items = evidence.select("packet", "id", "kind", squash(F.col("text")).alias("body"), F.col("status").alias("item_status"), F.lit(True).alias("found"))
    met = cited.join(items, ["packet", "id"], "left").withColumn("quoted", F.coalesce(F.when(F.col("quote").isNotNull(), quotes("body", "quote")), F.lit(False)))
    summed = met.groupBy("claim_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("found").isNull(), F.struct("nth", "id")))).alias("missing"),
        F.count("found").alias("valid"),
        F.bool_or("quoted").alias("quoted"),
        F.count_if(F.col("kind") == "commit").alias("commits"),
        F.count_if(F.col("kind") == "code").alias("codes"),
        F.count("item_status").alias("with_status"),
        F.max(rank(F.col("item_status"))).alias("cap"),
        F.sort_array(F.collect_set(F.when(F.col("found"), F.struct("kind", "id")))).alias("items"),
    )
    at = own.join(summed, "claim_id", "left").withColumn("r0", rank(F.col("claimed")))
    at = at.withColumn("unquoted", F.col("quote").isNotNull() & ~F.coalesce("quoted", F.lit(False)))
    at = at.withColumn("n", F.when(F.col("unquoted"), 0).otherwise(F.coalesce("valid", F.lit(0))))
    at = at.withColumn("r1", F.when(F.col("unquoted") & (F.col("r0") == 3), 2).otherwise(F.col("r0")))
    # The wording of reasons.
    why = (
        F.when(F.col("r1") < 3, None)
        .when(F.col("basis") == "inference", "basis is inference")
        .when(F.col("n") == 0, "no valid citation")
        .when((F.col("basis") == "commit_statement") & (F.col("commits") == 0), "commit_statement without a commit citation")
        .when((F.col("basis") != "commit_statement") & (F.col("codes") == 0), F.concat("basis", F.lit(" without a code citation")))
    )
    at = at.withColumn("why2", why).withColumn("r2", F.when(F.col("why2").isNotNull(), 2).otherwise(F.col("r1")))
    at = at.withColumn("r3", F.when((F.col("r2") == 2) & (F.col("n") == 0), 1).otherwise(F.col("r2")))
    capped = (F.col("n") > 0) & (F.col("with_status") == F.col("valid")) & (F.col("cap") < F.col("r3"))
    at = at.withColumn("r4", F.when(capped, F.col("cap")).otherwise(F.col("r3")))
    reasons = F.concat(
        F.transform(F.coalesce("missing", F.array().cast("array<struct<nth:int,id:string>>")), lambda m: F.concat(F.lit("cites "), m["id"], F.lit(", which was not in its evidence"))),
        F.array(
            F.when(F.col("r1") < F.col("r0"), "quoted text is not in the cited evidence"),
            F.col("why2"),
            F.when(F.col("r3") < F.col("r2"), "inferred without a valid citation"),
            F.when(F.col("r4") < F.col("r3"), "cannot be more certain than the claims it is built on"),
        ),
    )
    status = F.element_at(F.array(*map(F.lit, STATUSES)), F.col("r4"))
    return at.select(
        "claim_id",
        "text",
        "claimed",
        status.alias("status"),
        F.when(F.col("r4") == 2, "inference").otherwise(F.col("basis")).alias("basis"),
        F.when(F.col("r4") == 2, F.coalesce("confidence", F.lit("low"))).alias("confidence"),
        F.when(F.col("n") > 0, F.col("items")).otherwise(F.array().cast("array<struct<kind:string,id:string>>")).alias("citations"),
        F.when(F.col("r4") != F.col("r0"), F.array_join(reasons, "; ")).alias("reason"),
    )
