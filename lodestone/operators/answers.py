"""What is kept of models' answers: layers and files that hold up, answers that leak their prompt, answers asked before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

# Sides of the layers in their order and layers of each; characters of a title and of a line; prompt lines that tell.
SIDES = (("above", 2), ("inside", 3), ("below", 2))
TITLE, LINE = 40, 120
TELLING_LINE, MOST_SAID = 30, 2


def layers(raw: DataFrame, pools: DataFrame) -> DataFrame:
    """(overview_id, place, side, title, role, members) of the layers of each overview that hold up.

    ``raw`` has overview_id, nth, side, title, role and members, an answer's
    layers in its order; ``pools`` overview_id, side and names, what the scan
    found on a side. A member must be such a name, whatever its case, that no
    layer before has used on that side; a layer needs members and a title, and a
    side has two, three and two layers at most. An overview without a layer
    inside has none at all. An answer is a few layers, folded in place.
    """
    side = F.create_map(*(F.lit(x) for s, most in SIDES for x in (s, most)))
    order = F.create_map(*(F.lit(x) for k, (s, _) in enumerate(SIDES) for x in (s, k)))
    known = raw.where(F.col("side").isin(*(s for s, _ in SIDES)) & (F.trim(F.coalesce("title", F.lit(""))) != "")).join(pools, ["overview_id", "side"])
    lowered = F.transform("names", F.lower)
    spelled = F.transform(F.coalesce("members", F.array().cast("array<string>")), lambda m: F.get(F.col("names"), F.array_position(lowered, F.lower(F.trim(m))).cast("int") - 1))
    layer = F.struct("nth", "side", T.clip_words(F.trim("title"), TITLE).alias("title"), T.clip_words(F.trim(F.coalesce("role", F.lit(""))), LINE).alias("role"), F.array_compact(spelled).alias("members"))
    queue = known.groupBy("overview_id").agg(F.array_sort(F.collect_list(layer)).alias("queue"))
    empty = F.array().cast("array<struct<nth:bigint,side:string,title:string,role:string,members:array<string>>>")

    def step(taken: Column, x: Column) -> Column:
        same = F.filter(taken, lambda t: t["side"] == x["side"])
        fresh = F.array_except(x["members"], F.flatten(F.transform(same, lambda t: t["members"])))
        # A name that an answer repeats within a layer stays repeated, as it was not used before.
        kept = F.filter(x["members"], lambda m: F.array_contains(fresh, m))
        own = F.struct(x["nth"].cast("long").alias("nth"), x["side"].alias("side"), x["title"].alias("title"), x["role"].alias("role"), kept.alias("members"))
        return F.when((F.size(same) < side[x["side"]]) & (F.size(kept) > 0), F.array_append(taken, own)).otherwise(taken)

    folded = queue.select("overview_id", F.aggregate("queue", empty, step).alias("l")).where(F.exists("l", lambda t: t["side"] == "inside"))
    placed = F.array_sort(F.transform("l", lambda t: F.struct(order[t["side"]].alias("o"), t["nth"].alias("nth"), t.alias("t"))))
    return folded.select("overview_id", F.posexplode(placed).alias("place", "x")).select("overview_id", "place", "x.t.side", "x.t.title", "x.t.role", "x.t.members")


def described_files(raw: DataFrame, paths: DataFrame) -> DataFrame:
    """(overview_id, path, what): the first description of each file that was asked for, by its path or its name.

    ``raw`` has overview_id, nth, path and what, ``paths`` overview_id, nth and
    path. A name that several files bear means the first of them.
    """
    named = paths.select("overview_id", "nth", "path", F.explode(F.array_distinct(F.array(F.col("path"), T.basename(F.col("path"))))).alias("key"))
    first = named.groupBy("overview_id", "key").agg(F.min_by("path", "nth").alias("path"))
    said = raw.where(F.trim(F.coalesce("what", F.lit(""))) != "").select("overview_id", "nth", F.col("path").alias("key"), "what")
    best = said.join(first, ["overview_id", "key"]).groupBy("overview_id", "path").agg(F.min_by("what", "nth").alias("what"))
    return best.select("overview_id", "path", T.clip_words(F.trim("what"), LINE).alias("what"))


def prompt_lines(prompt: str) -> list[str]:
    """The lines of a prompt that tell it from other texts, as ``leaks_prompt`` compares them."""
    bare = (" ".join(line.strip().removeprefix("-").split()).lower() for line in prompt.split("\n"))
    return [line for line in bare if len(line) >= TELLING_LINE]


def leaks_prompt(text: Column, lines: list[str]) -> Column:
    """True if a text says two or more lines of the prompt, whatever its case and white space."""
    said = T.squash(F.coalesce(text, F.lit("")))
    return F.size(F.filter(F.array(*map(F.lit, lines)), lambda line: F.contains(said, line))) >= MOST_SAID if lines else F.lit(False)


def cache_key(*parts: Column) -> Column:
    """The key of a request: a digest of its parts, which can't run into one another."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}), 256)


def cached_answers(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (with key) and the answer that the cache (key, answer, at) had first; null where it has none."""
    first = cache.groupBy("key").agg(F.min_by("answer", "at").alias("answer"))
    return requests.join(first, "key", "left")
