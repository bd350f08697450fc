"""Guarded places: the range that a group of evidence protects, where it comes from, and one card for copies of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.fences import WARNING
from lodestone.operators.history_rules import VERDICTS, states_workaround, strength

# Lines of the longest range, lines of code that a comment speaks of, cards in all and of a file.
LONGEST_RANGE, CODE_UNDER_COMMENT = 14, 3
MOST_CARDS, MOST_OF_FILE = 8, 3


def line_classes(files: DataFrame) -> DataFrame:
    """A row for each line of ``files`` (path, text and code, the text with all but code blanked).

    Returns path, line, text, has_code, the number of lines with code up to it
    (codes), and the first and last line of the run of comment lines that it is
    in (null outside of one). A comment line has no code, isn't empty and is no
    directive.
    """
    lines = F.arrays_zip(F.split("text", "\n", -1).alias("text"), F.split("code", "\n", -1).alias("code"))
    rows = files.select("path", F.posexplode(lines).alias("at", "l")).select("path", (F.col("at") + 1).alias("line"), F.coalesce("l.text", F.lit("")).alias("text"), F.rlike(F.coalesce("l.code", F.lit("")), F.lit(r"\S")).alias("has_code"))
    bare = F.regexp_replace("text", r"^\s+", "")
    marked = rows.withColumn("comment", ~F.col("has_code") & (bare != "") & ~F.startswith(bare, F.lit("#")))
    order = Window.partitionBy("path").orderBy("line")
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("codes", F.sum(F.col("has_code").cast("int")).over(up_to)).withColumn("run", F.sum((~F.col("comment")).cast("int")).over(up_to))
    run = Window.partitionBy("path", "run", "comment")
    first, last = (F.when(F.col("comment"), f("line").over(run)) for f in (F.min, F.max))
    return counted.select("path", "line", "text", "has_code", "codes", first.alias("run_first"), last.alias("run_last"))


def guarded_ranges(lines: DataFrame, guards: DataFrame, evidence: DataFrame) -> DataFrame:
    """(guard_id, path, start, end, comment_line, comment): the lines that each guard protects.

    ``lines`` come from ``line_classes``; ``guards`` has guard_id, path and the
    range of its function (fn_start, fn_end), ``evidence`` guard_id, nth, start,
    end, weight and is_comment. A range holds all evidence, each comment that is
    evidence with the whole block of comment lines around it, and the code under
    the comment up to its third line (a comment beside code counts that line as
    the first). It stays in the function and ends after 14 lines. ``comment`` is
    the prose of the weightiest comment, the first of those that tie, and
    ``comment_line`` its first line; both are null without one.
    """
    own = evidence.join(guards, "guard_id")
    plain = own.select("guard_id", F.col("start").alias("a"), F.col("end").alias("k"), F.lit(None).cast("struct<w:int,nth:long,a:int,b:int>").alias("c"))
    said = own.where("is_comment").withColumnRenamed("start", "line").drop("end")
    here = lines.select("path", "line", "has_code", "codes")
    at = said.join(here, ["path", "line"], "left")
    near = lambda off, name: lines.select("path", (F.col("line") + off).alias("line"), F.col(name))
    # The runs that end right before the line and begin right after it.
    spread = at.join(near(1, "run_first"), ["path", "line"], "left").join(near(-1, "run_last"), ["path", "line"], "left")
    beside = F.coalesce("has_code", F.lit(False))
    a = F.when(beside | F.col("run_first").isNull() | (F.col("line") - 1 < F.col("fn_start")), F.col("line")).otherwise(F.greatest("run_first", "fn_start"))
    b = F.when(beside | F.col("run_last").isNull() | (F.col("line") + 1 > F.col("fn_end")), F.col("line")).otherwise(F.least("run_last", "fn_end"))
    blocks = spread.withColumns({"a": a, "b": b, "seen": beside.cast("int")}).drop("codes", "run_first", "run_last")
    # The line of code that many lines of code after the block.
    counted = blocks.join(lines.select("path", F.col("line").alias("b"), "codes"), ["path", "b"], "left")
    wanted = counted.withColumn("codes", F.coalesce("codes", F.lit(0)) + CODE_UNDER_COMMENT - F.col("seen"))
    ends = wanted.join(lines.where("has_code").select("path", "codes", F.col("line").alias("third")), ["path", "codes"], "left")
    grown = ends.withColumn("k", F.least(F.coalesce("third", "fn_end"), F.greatest("fn_end", "b")))
    first_of = F.struct((-F.col("weight")).cast("int").alias("w"), F.col("nth").cast("long").alias("nth"), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))
    parts = plain.unionByName(grown.select("guard_id", "a", "k", first_of.alias("c")))
    whole = parts.groupBy("guard_id").agg(F.min("a").alias("a"), F.max("k").alias("k"), F.min("c").alias("c")).join(guards, "guard_id")
    start = F.greatest("a", "fn_start")
    ranges = whole.withColumn("from", start).select("guard_id", "path", F.col("from").alias("start"), F.least("k", "fn_end", F.col("from") + LONGEST_RANGE - 1).alias("end"), F.col("c.a").alias("comment_line"), F.col("c.b").alias("comment_end"))
    told = ranges.where("comment_line IS NOT NULL").select("guard_id", "path", F.explode(F.sequence("comment_line", "comment_end")).alias("line")).join(lines.select("path", "line", "text"), ["path", "line"])
    prose = told.groupBy("guard_id").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l")).select("guard_id", comment_text(F.transform("l", lambda x: x["text"])).alias("comment"))
    return ranges.drop("comment_end").join(prose, "guard_id", "left")


def comment_text(lines: Column, most: int = 400) -> Column:
    """The prose of comment lines: what stands before a comment's mark and the marks themselves dropped, joined, clipped."""
    step = F.transform(lines, lambda x: F.regexp_replace(x, r"^.*?(//+|/\*+)", ""))
    step = F.transform(step, lambda x: F.regexp_replace(x, r"\*+/.*$", ""))
    step = F.filter(F.transform(step, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*\*+(?!/)", ""), r"^\s+|\s+$", "")), lambda x: x != "")
    return T.clip_mark(F.trim(F.regexp_replace(F.array_join(step, " "), r"\s+", " ")), most)


def origins(history: DataFrame, of: str) -> DataFrame:
    """Why each range exists: the commit that states a workaround, else the oldest fix or reason.

    Returns the key, sha, subject, author_name, authored_at, stated (subject,
    body or null) and said, the sentence of the body that states it or the
    subject. Among commits that state one the subject goes before the body and
    the older before the newer; reverts are no origins.
    """
    ranked = history.where(~F.col("revert")).withColumn("strength", strength()).where("strength > 0 OR bugfix OR rationale")
    strong = F.col("strength") > 0
    order = F.struct((~strong).cast("int"), -F.col("strength"), F.when(strong, F.col("authored_at")), F.when(strong, F.col("pos")).otherwise(-F.col("pos")))
    best = ranked.groupBy(of).agg(F.min_by(F.struct("sha", "subject", "body", "author_name", "authored_at", "strength"), order).alias("o")).select(of, "o.*")
    stated = F.when(F.col("strength") == 2, "subject").when(F.col("strength") == 1, "body")
    sentence = F.get(F.filter(T.sentences(F.col("body")), states_workaround), F.lit(0))
    said = F.coalesce(F.when(F.col("strength") == 1, T.clip_words(sentence, 200)), F.col("subject"))
    return best.select(of, "sha", "subject", "author_name", "authored_at", stated.alias("stated"), said.alias("said"))


def reverted_before(history: DataFrame, commits: DataFrame, of: str) -> DataFrame:
    """The newest revert of each range that names what it undid, with that change.

    ``commits`` has sha, subject, author_name and authored_at of all commits,
    for changes that the history doesn't hold; a change that neither holds gives
    no row. Returns the key, revert_sha, change_sha, change_subject, days between
    the two and reason, the first line of the revert's message that says more
    than what it reverts.
    """
    undoing = history.where("revert AND revert_of IS NOT NULL")
    rev = undoing.groupBy(of).agg(F.min_by(F.struct("sha", "revert_of", "body", "authored_at"), "pos").alias("r")).select(of, "r.*")
    inside = history.select(F.col(of).alias("_of"), F.col("sha").alias("change_sha"), F.col("subject").alias("change_subject"), F.col("authored_at").alias("changed_at"), "pos")
    met = rev.join(inside, (F.col(of) == F.col("_of")) & F.startswith("change_sha", F.col("revert_of")))
    first = met.groupBy(of).agg(F.min_by(F.struct("change_sha", "change_subject", "changed_at"), "pos").alias("i"))
    known = commits.select(F.col("sha").alias("revert_of"), F.struct(F.col("sha").alias("change_sha"), F.col("subject").alias("change_subject"), F.col("authored_at").alias("changed_at")).alias("k"))
    both = rev.join(first, of, "left").join(known, "revert_of", "left").withColumn("c", F.coalesce("i", "k")).where("c IS NOT NULL")
    lines = F.transform(F.split("body", "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    reason = F.get(F.filter(lines, lambda x: (x != "") & ~F.rlike(x, F.lit("(?i)^this reverts commit"))), F.lit(0))
    days = F.floor((F.unix_timestamp("authored_at") - F.unix_timestamp("c.changed_at")) / 86_400 + F.lit(0.5))
    return both.select(of, F.col("sha").alias("revert_sha"), "c.change_sha", "c.change_subject", days.alias("days"), T.clip_mark(reason, 200).alias("reason"))


def headline(text: Column) -> Column:
    """The sentence of a comment that warns, else its first, as a title."""
    every = T.sentences(text)
    warns = F.get(F.filter(every, lambda s: F.rlike(s, F.lit("(?i)" + T.portable(WARNING)))), F.lit(0))
    return T.sentence_case(T.clip_words(F.regexp_replace(F.coalesce(warns, F.get(every, F.lit(0))), r"[.:;,!]+$", ""), 110))


def title(subject: Column, stated: Column, comment: Column, undone: Column, function: Column) -> Column:
    """A card's title: a subject that states the workaround, the comment's warning, any subject, what was undone, the function."""
    of_subject = T.sentence_case(T.bare_subject(subject))
    return (
        F.when(stated == "subject", of_subject)
        .when(comment.isNotNull(), headline(comment))
        .when(subject.isNotNull(), of_subject)
        .when(undone.isNotNull(), F.concat(F.lit("Reverted before: "), T.bare_subject(undone)))
        .otherwise(F.concat(function, F.lit(": code with a workaround history")))
    )


def rank(floor: Column, undone: Column, origin: Column, stated: Column, score: Column) -> Column:
    """What cards are ordered by: the verdict first, then a revert, an origin and the evidence's score."""
    worst = F.array_position(F.array(*map(F.lit, VERDICTS)), floor) - 1
    return worst * 10 + F.when(undone.isNotNull(), 4).otherwise(0) + F.when(stated == "subject", 4).when(origin.isNotNull(), 1).otherwise(0) + score


def card_keys(undone: Column, origin: Column, stated: Column, comment: Column, title: Column) -> Column:
    """What makes two cards copies of one guard: the change undone, the commit whose subject states it, the same words."""
    key = lambda kind, value: F.concat(F.lit(kind + ":"), value)  # noqa: E731  null without a value
    return F.array_compact(F.array(key("revert", undone), F.when(stated == "subject", key("origin", origin)), key("text", T.norm_key(comment)), key("text", T.norm_key(title))))


def group_cards(cards: DataFrame, snapshot: str, most: int = MOST_CARDS, of_file: int = MOST_OF_FILE) -> DataFrame:
    """(snapshot, card_no, id, copies): cards in their order, each with the ids of the copies that it stands for.

    ``cards`` has the snapshot, id, path, rank and keys. They are gone through
    from the highest rank (ties by id): a card that shares a key with one that
    was taken before is a copy of the first such and adds its keys to it, so
    that a later copy may match them alone; any other is taken unless ``of_file``
    of its file or ``most`` in all are. The candidates of a snapshot are few (a
    quota picks them), so that each snapshot is one array, folded in place.
    """
    row = F.struct((-F.col("rank")).alias("rank"), "id", "path", "keys")
    queue = cards.groupBy(snapshot).agg(F.array_sort(F.collect_list(row)).alias("queue"))
    kinds = dict(cards.dtypes)
    empty = F.array().cast(f"array<struct<id:{kinds['id']},path:{kinds['path']},keys:array<string>,copies:array<{kinds['id']}>>>")

    def step(taken: Column, x: Column) -> Column:
        twin = F.array_position(F.transform(taken, lambda g: F.arrays_overlap(g["keys"], x["keys"])), F.lit(True))
        joined = F.transform(
            taken,
            lambda g, i: F.when(
                i + 1 == twin, F.struct(g["id"].alias("id"), g["path"].alias("path"), F.array_union(g["keys"], x["keys"]).alias("keys"), F.array_append(g["copies"], x["id"]).alias("copies"))
            ).otherwise(g),
        )
        full = (F.size(taken) >= most) | (F.size(F.filter(taken, lambda g: g["path"] == x["path"])) >= of_file)
        own = F.struct(x["id"].alias("id"), x["path"].alias("path"), x["keys"].alias("keys"), F.array().cast(f"array<{kinds['id']}>").alias("copies"))
        return F.when(twin > 0, joined).when(full, taken).otherwise(F.array_append(taken, own))

    folded = queue.select(snapshot, F.posexplode(F.aggregate("queue", empty, step)).alias("card_no", "g"))
    return folded.select(snapshot, "card_no", "g.id", "g.copies")


def because(reasons: DataFrame, floor: DataFrame) -> DataFrame:
    """(case_id, because): what the reasons at a case's floor mean, each once, in their order."""
    # The wording of rules and contracts.
    rules = {
        "reverted_before": "a change to these lines was reverted before", "explicit_workaround": "the commit behind it states a hardware workaround",
        "workaround_comment": "a comment warns about it", "bugfix_history": "shaped by a bug-fix commit",
    }
    contracts = {
        "isr": "an interrupt handler", "timing": "timing calls", "timing_constant": "a timing constant", "watchdog": "the watchdog",
        "hw_access": "volatile hardware access", "hw_register": "register access", "concurrency": "locking", "external_interface": "an external interface",
    }
    named = lambda words, key: F.create_map(*(F.lit(x) for pair in words.items() for x in pair))[key]
    contract = F.concat(F.lit("touches "), F.coalesce(named(contracts, F.substring_index("detail", " ", 1)), F.lit("hardware-facing code")))
    words = F.when(F.col("rule") == "contract_signal", contract).otherwise(F.coalesce(named(rules, F.col("rule")), F.regexp_replace("rule", "_", " ")))
    at_floor = reasons.join(floor, "case_id").where("verdict = floor").select("case_id", "place", words.alias("words"))
    once = at_floor.groupBy("case_id", "words").agg(F.min("place").alias("place"))
    return once.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda x: x["words"]).alias("because"))



def report(candidates: DataFrame, ranges: DataFrame, origins: DataFrame, reverts: DataFrame, floors: DataFrame, snapshot: str) -> DataFrame:
    """The cards of each snapshot: (snapshot, card_no, guard_id, id, title, verdict, rank, path, start, end, copies).

    ``candidates`` has guard_id, the snapshot, path, function (its short name)
    and score; ``ranges`` comes from ``guarded_ranges``, ``origins`` and
    ``reverts`` from the functions above with guard_id as their key, ``floors``
    has guard_id and floor. A place is a card only if a change of it would be
    dangerous at least. Cards are ordered by rank and stand for their copies;
    ``copies`` holds the ids (``path:line``) of the places that a card stands for.
    """
    grave = floors.where(F.col("floor").isin(*VERDICTS[2:]))
    found = candidates.join(ranges.drop("path"), "guard_id").join(grave, "guard_id")
    found = found.join(origins.select("guard_id", F.col("sha").alias("origin"), "subject", "stated"), "guard_id", "left").join(reverts.select("guard_id", "change_sha", "change_subject"), "guard_id", "left")
    named = found.withColumn("title", title(F.col("subject"), F.col("stated"), F.col("comment"), F.col("change_subject"), F.col("function"))).withColumn("id", F.concat_ws(":", "path", F.col("start").cast("string")))
    cards = named.withColumn("rank", rank(F.col("floor"), F.col("change_sha"), F.col("origin"), F.col("stated"), F.col("score"))).withColumn("keys", card_keys(F.col("change_sha"), F.col("origin"), F.col("stated"), F.col("comment"), F.col("title")))
    grouped = group_cards(cards, snapshot)
    return grouped.join(cards, [snapshot, "id"]).select(snapshot, "card_no", "guard_id", "id", "title", F.col("floor").alias("verdict"), "rank", "path", "start", "end", "copies")
