"""Pattern signals of source lines, and criticality from signals, history and callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import graph, ranking
from lodestone.operators.intervals import overlap_join

# Kind, weight and pattern of signals in code; of the rules of a kind the first that fits a line counts.
CODE_RULES = (
    ("isr", 3, r"\b\w+_IRQHandler\b|\bISR\s*\(|__attribute__\s*\(\(\s*(interrupt|isr)\b|\bCH_IRQ_(PROLOGUE|EPILOGUE|HANDLER)\b|\birq_handler\b|FromISR\b"),
    (
        "concurrency",
        2,
        r"\b(__disable_irq|__enable_irq|chSysLock\w*|chSysUnlock\w*|irqsave|irqrestore|taskENTER_CRITICAL|portENTER_CRITICAL|WITH_SEMAPHORE|HAL_Semaphore|take_blocking|__sync_\w+|__atomic_\w+|__DMB|__DSB|__ISB)\b|std::atomic|\b\w*sem\w*(\.|->)(take|give)\s*\(",
    ),
    ("hw_access", 2, r"\bvolatile\b|\(\s*(volatile\s+)?\w+\s*\*\s*\)\s*0x[0-9A-Fa-f]{4,}"),
    (
        "hw_register",
        2,
        r"\b(register_read|register_write|read_registers|write_register|modify_register|_register_read|_register_write|_register_modify|setup_checked_registers|set_checked_register)\s*\(|\b(MPUREG|REG|BIT|BITS|ICMREG|BMI\d*_REG)_\w+",
    ),
    ("bus_io", 1, r"\b(transfer|transfer_fullduplex|set_chip_select|set_speed|set_read_flag|read_fifo|spi_\w+|i2c_\w+|can_\w+|uart_\w+)\s*\("),
    (
        "timing",
        2,
        r"\b(delay|delay_microseconds|delay_microseconds_boost|usleep|udelay|mdelay|px4_usleep|nanosleep|HAL_Delay|chThdSleep\w*|in_expected_delay|register_periodic_callback|adjust_periodic_callback|register_timer_process|ScheduleDelayed|ScheduleOnInterval|hrt_absolute_time)\s*\(",
    ),
    ("timing", 1, r"\bAP_HAL::(micros|millis|micros64|millis64)\s*\(|\b(micros|millis|micros64|millis64)\s*\(\s*\)"),
    ("watchdog", 2, r"(?i)\b\w*(watchdog|wdt|iwdg)\w*\s*\("),
    ("hw_recovery", 2, r"(?i)\b\w*(reset|recover|reinit|restart)\w*\s*\("),
    ("defensive", 1, r"(?i)\b(retr(y|ies)|attempts?|tries|max_tries)\b|\b\w*(crc|checksum|sanity|_check_\w+|check_\w+|validate\w*|is_valid)\w*\s*\("),
    (
        "external_interface",
        2,
        r"\bAP_GROUPINFO\w*\s*\(|\bAP_NESTEDGROUPINFO\s*\(|\bMAVLINK_MSG_ID_\w+|\bmavlink_msg_\w+|\bGCS_SEND_TEXT\b|\bgcs\(\)\.send_\w+|\bsend_text\s*\(|AP::logger\(\)\.Write\w*\s*\(|\bLOG_\w+_MSG\b",
    ),
)
# Constants of time in code, rules for directives, rules for comments (the first that fits a comment counts).
CODE_CONSTANT = ("timing_constant", 1, r"(?i)\b(const|constexpr)\s+[\w:]+\s+\w*(timeout|rate|_hz|_us|_ms|period|interval|delay)\w*\s*=\s*-?\d")
DIRECTIVE_RULES = (
    ("platform_variant", 1, r"^#\s*(if|ifdef|ifndef|elif)\b.*\b(CONFIG_HAL_BOARD\w*|HAL_\w+|BOARD\w*|CHIP\w*|STM32\w*|__arm__|__linux__|_WIN32|SITL\w*|HAL_BUILD_AP_PERIPH|CONFIG_\w+)"),
    ("timing_constant", 1, r"(?i)^#\s*define\s+\w*(TIMEOUT|RATE|HZ|_US|_MS|PERIOD|INTERVAL|DELAY|DEADLINE)\w*\s+\(?\s*-?\d"),
)
COMMENT_RULES = (
    (
        "workaround_comment",
        3,
        r"(?i)\b(errat(a|um)|silicon|work[- ]?arounds?|quirks?|hack|chip rev\w*|anomal\w*|glitch\w*|spurious|datasheet|undocumented|alignment error|corrupt\w*|hardware bug|bug in the (chip|sensor|hardware))\b",
    ),
    ("rationale_comment", 1, r"\b(do not|don't|must not|must|never|careful|important|XXX|FIXME|HACK)\b"),
)
# Weights of who wrote a line last, points of outside references, how many signals of a kind count.
GIT_KINDS = (("revert", "git_revert", 3), ("rationale", "git_workaround", 2), ("bugfix", "git_bugfix", 1))
EXTERNAL_POINTS, KIND_CAP, LOOSE_CAP, TOP_FUNCTIONS = 2, 3, 5, 3
LOOSE_KINDS = ("workaround_comment", "timing_constant", "external_interface")
SNIPPET, DETAIL = 160, 80


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def rule_hits(text: Column, rules, excluded=None) -> Column:
    """Hits of a rule table on a text in the rules' order: array of (kind, weight, detail)."""

    def hit(kind, weight, pattern):
        found = F.regexp_extract(text, T.portable(pattern), 0)
        own = excluded(kind, found) if excluded else F.lit(False)
        return F.when((found != "") & ~own, F.struct(F.lit(kind).alias("kind"), F.lit(weight).alias("weight"), F.substring(_trim(found), 1, DETAIL).alias("detail")))

    return F.filter(F.array(*(hit(*rule) for rule in rules)), lambda h: h.isNotNull())


def first_of_kind(hits: Column) -> Column:
    """Of the hits of each kind the first."""
    return F.filter(hits, lambda h, i: ~F.exists(F.slice(hits, F.lit(1), i), lambda before: before["kind"] == h["kind"]))


def code_signals(parsed: DataFrame) -> DataFrame:
    """Signals of code, directives and comments: path, start, end, kind, source, snippet, detail, weight, place.

    The head of a function is no call of it, except that an interrupt handler's
    own name is the signal. ``place`` orders the signals of a path.
    """
    code = F.split("code", "\n", -1)
    source = F.split("text", "\n", -1)
    # Of functions that begin on one line the last one gives its name.
    heads = F.filter("symbols", lambda s: s["kind"] == "function")
    per_line = parsed.select("path", "heads" if "heads" in parsed.columns else heads.alias("heads"), F.posexplode(F.arrays_zip(code.alias("code"), source.alias("source"))).alias("at", "l")).where(F.rlike("l.code", F.lit(r"\S")))
    own = F.try_element_at(F.filter("heads", lambda s: s["start"] == F.col("at") + 1), F.lit(-1))["short_name"]
    per_line = per_line.select("path", (F.col("at") + 1).alias("line"), F.col("l.code").alias("code"), _trim(F.col("l.source")).alias("snippet"), own.alias("own"))

    def is_head(kind, found):
        return F.coalesce(F.endswith(F.regexp_replace(found, r"\s*\($", ""), F.col("own")), F.lit(False)) if kind != "isr" else F.lit(False)

    hits = per_line.withColumn("hits", rule_hits(F.col("code"), CODE_RULES, is_head)).withColumn("hits", F.concat(first_of_kind(F.col("hits")), rule_hits(F.col("code"), (CODE_CONSTANT,))))
    place = lambda step, at: F.struct(F.lit(step).alias("step"), F.col(at).cast("long").alias("at"), F.col("k").cast("long").alias("k"))
    shape = lambda df, step, source, at: df.select("path", F.col("line").alias("start"), F.col("line").alias("end"), "h.kind", F.lit(source).alias("source"), T.clip(F.col("snippet"), SNIPPET).alias("snippet"), "h.detail", "h.weight", place(step, at).alias("place"))
    of_code = shape(hits.select("path", "line", "snippet", F.posexplode("hits").alias("k", "h")), 0, "static", "line")
    directives = parsed.select("path", source.alias("lines"), F.posexplode("directives").alias("at", "d")).select("path", "at", "d.line", _trim(F.get("lines", F.col("d.line") - 1)).alias("snippet"), F.posexplode(rule_hits(F.col("d.text"), DIRECTIVE_RULES)).alias("k", "h"))
    comments = parsed.select("path", F.posexplode("comments").alias("at", "c")).select("path", "at", "c.line", F.col("c.text").alias("snippet"), F.posexplode(F.slice(rule_hits(F.col("c.text"), COMMENT_RULES), 1, 1)).alias("k", "h"))
    return of_code.unionByName(shape(directives, 1, "static", "at")).unionByName(shape(comments, 2, "comment", "at"))


def git_signals(parsed: DataFrame, blame: DataFrame, commits: DataFrame) -> DataFrame:
    """A signal for each blame range with code whose commit is a revert, a workaround or a fix, in this order.

    ``blame`` has path, start, end and sha; ``commits`` sha, subject and the
    three flags.
    """
    flags = F.coalesce(*(F.when(F.col(flag), F.struct(F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))) for flag, kind, weight in GIT_KINDS))
    blank = parsed.select("path", F.transform(F.split("code", "\n", -1), lambda x: ~F.rlike(x, F.lit(r"\S"))).alias("blank"))
    ranges = blame.join(commits.select("sha", "subject", flags.alias("h")).where("h IS NOT NULL"), "sha").join(blank.hint("merge"), "path")
    within = F.slice("blank", F.greatest(F.col("start"), F.lit(1)), F.greatest(F.col("end") - F.col("start") + 1, F.lit(0)))
    with_code = ranges.where(F.exists(within, lambda b: ~b))
    place = F.struct(F.lit(3).alias("step"), F.col("start").cast("long").alias("at"), F.lit(0).cast("long").alias("k"))
    return with_code.select("path", "start", "end", "h.kind", F.lit("git").alias("source"), T.clip(F.col("subject"), SNIPPET).alias("snippet"), F.col("sha").alias("detail"), "h.weight", place.alias("place"))


def fan_in(edges: DataFrame) -> DataFrame:
    """(id, resolved, ambiguous, outside) callers by edges; co-change doesn't count."""
    outside = F.col("method") == "reference_index"
    count = lambda c: F.count_if(~outside & (F.col("resolution") == c)).alias(c)
    return edges.where("kind <> 'co_changes'").groupBy(F.col("dst").alias("id")).agg(count("resolved"), count("ambiguous"), F.count_if(outside).alias("outside"))


def symbol_factors(symbols: DataFrame, signals: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, factor, points, detail) of every function: capped signals by kind, callers, outside references."""
    functions = symbols.where("kind = 'function'").select("id", "path", F.col("start").alias("first"), F.col("end").alias("last"))
    inside = overlap_join(signals.select("path", "start", "end", "kind", "weight", "place"), functions, "path", ("start", "end"), ("first", "last")).select("id", "start", "kind", "weight", "place")
    nth = F.row_number().over(Window.partitionBy("id", "kind").orderBy("place", "start"))
    capped = inside.withColumn("nth", nth).groupBy("id", "kind").agg(
        F.sum(F.when(F.col("nth") <= KIND_CAP, F.col("weight"))).cast("double").alias("points"),
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("nth") <= 3, F.struct("nth", "start")))).alias("at"),
    )
    where = F.array_join(F.transform("at", lambda x: F.concat(F.lit("L"), x["start"].cast("string"))), ", ")
    by_kind = capped.select("id", F.col("kind").alias("factor"), "points", F.concat(F.col("n").cast("string"), F.lit("\u00d7 ("), where, F.when(F.col("n") > 3, ", \u2026").otherwise(""), F.lit(")")).alias("detail"))
    callers = functions.select("id").join(fan_in(edges).hint("merge"), "id")
    called = callers.where("resolved + ambiguous > 0").select("id", F.lit("fan_in").alias("factor"), graph.fan_in_points(F.col("resolved"), F.col("ambiguous")).alias("points"), F.format_string("%d resolved, %d ambiguous callers", "resolved", "ambiguous").alias("detail"))
    named = callers.where("outside > 0").select("id", F.lit("external_references").alias("factor"), F.lit(float(EXTERNAL_POINTS)).alias("points"), F.format_string("named from %d file(s) outside the deep scope", "outside").alias("detail"))
    return by_kind.unionByName(called).unionByName(named)


def score_symbols(symbols: DataFrame, signals: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, path, name, score, level, factors) of every function; of the scored ones the first tenth is high, the next quarter medium."""
    factors = symbol_factors(symbols, signals, edges)
    scored = factors.groupBy("id").agg(F.round(F.sum("points"), 1).alias("score"), F.sort_array(F.collect_list(F.struct("points", "factor", "detail")), asc=False).alias("factors"))
    every = symbols.where("kind = 'function'").select("id", "path", "name").join(scored.hint("merge"), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return ranking.levels(every, "score", "id")


def score_files(files: DataFrame, scores: DataFrame, symbols: DataFrame, signals: DataFrame) -> DataFrame:
    """(path, score, level): the three most critical functions of each file, and up to five telling signals outside of functions."""
    top = ranking.top_per_key(scores.where("score > 0"), ["path"], [F.desc("score"), F.asc("id")], TOP_FUNCTIONS).groupBy("path").agg(F.sum("score").alias("functions"))
    ranges = symbols.where("kind = 'function'").select("path", F.col("start").alias("first"), F.col("end").alias("last"))
    telling = signals.where(F.col("kind").isin(*LOOSE_KINDS))
    loose = overlap_join(telling, ranges, "path", ("start", "start"), ("first", "last"), "left_anti")
    counted = loose.groupBy("path").agg(F.least(F.count("*"), F.lit(LOOSE_CAP)).alias("loose"))
    score = F.round(F.coalesce("functions", F.lit(0.0)) + F.coalesce("loose", F.lit(0)), 1)
    return ranking.levels(files.select("path").distinct().join(top.hint("merge"), "path", "left").join(counted.hint("merge"), "path", "left").select("path", score.alias("score")), "score", "path")
