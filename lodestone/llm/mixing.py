"""Mixing sources to target weights, in SQL functions alone.

The words of each source stand one after another, its documents in the order of
a hash, and are cut into blocks of one length. The mix is a number of shards of
equal size. Each shard draws how many of its slots every source fills: the whole
part of what is expected as such, and the rest by a multinomial draw. A source's
slots are numbered through all shards; a pseudorandom permutation of the
source's block numbers, another one for each pass over them, says which block a
slot takes, and slots meet blocks by that number.

No step needs a source in one task: places come from running sums over ranges of
the order, slots are dealt out before they are made, and blocks and slots meet
by their numbers, of which each occurs a bounded number of times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD_SQL, numbered, stash

WEIGHTS = (5, 2, 1)  # of the sources in their order, over and over
ROUNDS = 24  # of the permutation, each swaps about half of the numbers
CHUNK = 4096  # slots, copies or draws that one row of a plan stands for before they are spread
SLOTS = 200_000  # slots that a task makes, about
CELLS = 1 << 12  # of the unit interval, where draws meet sources

_BITS = float(1 << 53)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and number of words of every row, with a hash that orders the documents of a source."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    return docs.select(doc_id.alias("doc_id"), source.alias("source"), F.regexp_count(text, F.lit(WORD_SQL)).cast("long").alias("size"), F.xxhash64(doc_id, text).alias("h"))


def _spread(rows: DataFrame, count: str, name: str, parts: int | None = None) -> DataFrame:
    """A row for each number from 0 below ``count``, made in two steps; with ``parts`` large counts are shared out between them."""
    chunks = rows.where(F.col(count) > 0).withColumn("_from", F.explode(F.expr(f"sequence(0L, ({count} - 1) div {CHUNK})")))
    # By number, as the rows that stand for many slots are too few and small for Spark to leave them apart.
    dealt = chunks if parts is None else chunks.repartition(parts, "sid", "_from")
    last = F.least(F.col("_from") * CHUNK + CHUNK - 1, F.col(count) - 1)
    return dealt.withColumn(name, F.explode(F.sequence(F.col("_from") * CHUNK, last))).drop("_from")


def targets(found: DataFrame, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """sid, source, source_size, n_docs and target of every source.

    Sources in the order of their code points, null last, have the weights 5, 2
    and 1 over and over, and share out ``share`` of all words. A target stops at
    ``most`` times its source's size, and the excess goes to the others by their
    weights until none is above. A round is a sum over one row a source.
    """
    own = found.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rows = numbered(own.withColumn("absent", F.col("source").isNull()), ["absent", "source"], "sid").drop("absent")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    rows = stash(rows.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most), "sources")
    whole = (rows.agg(F.sum("source_size")).first()[0] or 0) * share[0] / share[1]
    left, weights = whole, None
    while True:  # a source that is capped once stays so, as the others' shares only grow
        capped = F.lit(False) if weights is None else F.col("weight") * F.lit(float(left)) > F.col("cap") * F.lit(float(weights))
        sums = rows.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0)).alias("fixed"), F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("weights")).first()
        now = whole - (sums["fixed"] or 0), sums["weights"] or 0
        if now == (left, weights) or not now[1]:
            break
        left, weights = now
    free = F.lit(0.0) if not weights else F.col("weight") * F.lit(float(left)) / F.lit(float(weights))
    return rows.withColumn("target", F.least(F.col("cap").cast("double"), free)).select("sid", "source", "source_size", "n_docs", "target")


def placed(found: DataFrame, sources: DataFrame) -> DataFrame:
    """sid, doc_id, size and start of every document with words: where it begins among the words of its source.

    Rows that are the same in all are told apart by a number of their own.
    """
    rows = found.where("size > 0").groupBy("source", "doc_id", "h", "size").agg(F.count("*").alias("copies"))
    named = rows.join(sources.select("sid", F.col("source").alias("named")), F.col("source").eqNullSafe(F.col("named"))).drop("source", "named")
    each = _spread(named, "copies", "copy").drop("copies")
    order = ["sid", "h", "doc_id", "size", "copy"]
    parts = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), found.count() // 500_000)
    ranges = stash(each.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "order")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy("sid", "part").agg(F.sum("size").alias("words"))
    starts = sums.select("sid", "part", F.coalesce(F.sum("words").over(before(Window.partitionBy("sid").orderBy("part"))), F.lit(0)).alias("first"))
    within = F.coalesce(F.sum("size").over(before(Window.partitionBy("sid", "part").orderBy(*order[1:]))), F.lit(0))
    return ranges.withColumn("within", within).join(starts, ["sid", "part"]).select("sid", "doc_id", "size", (F.col("first") + F.col("within")).alias("start"))


def permuted(rows: DataFrame, x: str, n: str, key: str, name: str) -> DataFrame:
    """``rows`` with the place of x, from 0 below n, in a pseudorandom permutation of these numbers that ``key`` picks.

    Each round pairs the numbers off, x with (k - x) mod n, and a hash of the
    pair says whether it swaps. A round is its own inverse, so all of them
    together are a permutation, of any n. Rounds are columns of their own, which
    Spark compiles; as one nested expression it would repeat each of them.
    """
    out = rows.withColumn(name, F.col(x))
    for r in range(ROUNDS):
        other = F.pmod(F.pmod(F.xxhash64(key, F.lit(r)), F.col(n)) - F.col(name), F.col(n))
        swaps = F.xxhash64(key, F.lit(r), F.greatest(F.col(name), F.col("_other"))).bitwiseAND(F.lit(1)) == 1
        out = out.withColumn("_other", other).withColumn(name, F.when(swaps, F.col("_other")).otherwise(F.col(name)))
    return out.drop("_other")


def _plan(sources: DataFrame, block: int, per_shard: int, most: int) -> tuple[DataFrame, int, int]:
    """Blocks and expected slots of every source, the number of shards, and how many tasks the slots are shared out to."""
    blocks = F.ceil(F.col("source_size") / F.lit(block))
    rows = sources.where("source_size > 0").withColumn("blocks", blocks).withColumn("most", F.col("blocks") * most)
    # As many passes as the target asks for; the last block of a source may be short.
    rows = rows.withColumn("expected", F.least(F.col("target") * F.col("blocks") / F.col("source_size"), F.col("most").cast("double")))
    expected = rows.agg(F.sum("expected")).first()[0] or 0
    shards = max(1, -int(-expected // per_shard))
    tasks = max(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(expected) // SLOTS)
    each = F.col("expected") / F.lit(float(shards))
    return stash(rows.withColumn("base", F.floor(each)).withColumn("rest", each - F.floor(each)), "slot-plan"), shards, tasks


def _drawn(plan: DataFrame, shards: int, seed: int) -> DataFrame:
    """sid, shard and draw of the multinomial part: as many draws a shard as the rests of all sources add up to.

    A draw is a number of the unit interval, where each source has a stretch as
    long as its share of the rests; they meet by the cells that they lie in.
    """
    spark = plan.sparkSession
    total = plan.agg(F.sum("rest")).first()[0] or 0.0
    draws = round(total)
    if not draws:
        return spark.createDataFrame([], "sid long, shard long, draw long")
    u = F.pmod(F.xxhash64(F.lit(seed), "shard", "draw"), F.lit(1 << 53)) / F.lit(_BITS)
    each = spark.range(shards * draws).select((F.col("id") % shards).alias("shard"), F.floor(F.col("id") / shards).alias("draw")).withColumn("u", u)
    # Stretches: a running sum over one row a source, by ranges of the number.
    parts = plan.withColumn("part", F.floor(F.col("sid") / CHUNK))
    own = Window.partitionBy("part").orderBy("sid")
    before = parts.groupBy("part").agg(F.sum("rest").alias("of"))
    starts = before.select("part", (F.sum("of").over(Window.orderBy("part")) - F.col("of")).alias("first"))
    bounds = parts.withColumn("to", F.sum("rest").over(own)).join(starts, "part").select("sid", "rest", ((F.col("first") + F.col("to") - F.col("rest")) / total).alias("lo"), ((F.col("first") + F.col("to")) / total).alias("hi"))
    cells = bounds.where("rest > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.floor(F.col("hi") * CELLS))))
    met = each.withColumn("cell", F.floor(F.col("u") * CELLS)).join(cells, "cell").where((F.col("lo") <= F.col("u")) & (F.col("u") < F.col("hi")))
    # Stretches that touch may both miss or hold a number by rounding: the first one has it.
    return met.groupBy("shard", "draw").agg(F.min("sid").alias("sid")).select("sid", "shard", "draw")


def slots(sources: DataFrame, block: int = 64, per_shard: int = 65_536, most: int = 2, seed: int = 13) -> DataFrame:
    """sid, shard, ordinal, pass and block of every slot of the mix; the order within a shard is that of a hash.

    A source takes no block more than ``most`` times: draws beyond leave their
    slot empty, of which there are at most a few in a shard.
    """
    plan, shards, tasks = _plan(sources, block, per_shard, most)
    base = _spread(plan.withColumn("slots", F.col("base") * shards), "slots", "ordinal", tasks).withColumn("shard", F.floor(F.col("ordinal") / F.col("base")))
    drawn = _drawn(plan, shards, seed)
    at = F.row_number().over(Window.partitionBy("sid").orderBy("shard", "draw")) - 1  # about a draw a shard
    more = drawn.withColumn("at", at).join(plan, "sid").withColumn("ordinal", F.col("base") * shards + F.col("at"))
    columns = ["sid", "shard", "ordinal", "blocks", "most"]
    rows = base.select(*columns).unionByName(more.select(*columns)).where(F.col("ordinal") < F.col("most"))
    passed = rows.withColumn("pass", F.floor(F.col("ordinal") / F.col("blocks"))).withColumn("nth", F.col("ordinal") % F.col("blocks"))
    keyed = passed.withColumn("key", F.xxhash64(F.lit(seed), "sid", "pass"))
    # Written, as what is asked of a place later on must not be asked of all rounds again.
    return stash(permuted(keyed, "nth", "blocks", "key", "block").select("sid", "shard", "ordinal", "pass", "block"), "slots")


def pieces(documents: DataFrame, block: int = 64) -> DataFrame:
    """sid, block, doc_id, start, from and length: the parts of documents that lie in each block.

    ``from`` is the place in the document of the part's first word.
    """
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    rows = documents.withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("block") * block, F.col("start"))
    hi = F.least((F.col("block") + 1) * block, F.col("start") + F.col("size"))
    return rows.select("sid", "block", "doc_id", "start", "size", (lo - F.col("start")).alias("from"), (hi - lo).alias("length"))


def mix(documents: DataFrame, sources: DataFrame, block: int = 64, per_shard: int = 65_536, most: int = 2, seed: int = 13) -> DataFrame:
    """The mix: shard, place (a number that orders a shard's slots), sid, pass, block, and the words of documents that the slot takes.

    A row is a part of a document: doc_id, start (place of the document in its
    source), from and length, in words. A slot has a row for each document that
    its block touches, at most ``block``.
    """
    found = slots(sources, block, per_shard, most, seed).withColumn("place", F.xxhash64(F.lit(seed + 1), "shard", "sid", "ordinal"))
    return found.join(pieces(documents, block), ["sid", "block"]).select("shard", "place", "sid", "pass", "block", "doc_id", "start", "size", "from", "length")


def mixed(docs: DataFrame, share: tuple[int, int] = (3, 2), most: int = 2, block: int = 64, per_shard: int = 65_536, seed: int = 13) -> DataFrame:
    """How many words of every document the mix takes; a row for each row of ``docs``.

    Sources share ``share`` of all words by their weights, no target above
    ``most`` times its source's size, and no document is taken more than ``most``
    times. What a source gives is within a block a shard of its target.

    Columns: doc_id, size (words), source (null stays null), source_size, target
    (of the source), taken (words, repeats counted). A null source is a source
    of its own, the last one. Null and empty texts have no words and are not
    taken. A null doc_id stays null; repeated rows are documents of their own; a
    long text is cut like any other. An empty table gives no rows; other columns
    are ignored. Reruns over the same rows agree, whatever their partitions.
    """
    found = stash(sizes(docs), "sizes")
    sources = stash(targets(found, share, most), "targets")
    documents = stash(placed(found, sources), "placed")
    taken = mix(documents, sources, block, per_shard, most, seed).groupBy("sid", "start", "doc_id").agg(F.sum("length").alias("taken"))
    with_words = documents.join(taken.drop("doc_id"), ["sid", "start"], "left").select("sid", "doc_id", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    empty = found.where("size = 0").join(sources.select("sid", F.col("source").alias("named")), F.col("source").eqNullSafe(F.col("named")))
    rows = with_words.unionByName(empty.select("sid", "doc_id", "size", F.lit(0).cast("long").alias("taken")))
    return rows.join(sources, "sid").select("doc_id", "size", "source", "source_size", "target", "taken")
