"""String expressions: paths, clips, keys, evidence quotes, message classes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension (case-sensitive).
LANGUAGES = {
    "c": "c", "h": "c-header", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp-header", "hpp": "cpp-header", "hxx": "cpp-header",
    "s": "asm", "S": "asm", "asm": "asm", "py": "python", "cmake": "cmake", "mk": "make", "ld": "linker-script", "md": "markdown",
    "txt": "text", "json": "json", "xml": "xml", "yaml": "yaml", "yml": "yaml", "sh": "shell",
}
# File names that decide the language by themselves.
NAMES = {"CMakeLists.txt": "cmake", "Makefile": "make", "makefile": "make"}


def portable(pattern: str) -> str:
    """A pattern whose word boundaries are ASCII and whose white space outside of classes is Unicode's, whatever Java takes for them."""
    word, space = "[A-Za-z0-9_]", r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
    border = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    pieces = re.split(r"(\[(?:\\.|[^\]\\])*\]|\\.)", pattern)  # classes and escapes stand by themselves
    return "".join(border if x == r"\b" else space if x == r"\s" else x for x in pieces)


# Words of commit messages that mark fixes, hardware or timing reasons, and reverts.
BUGFIX = r"\b(fix(e[sd]|ing)?|bugs?|bugfix|hotfix|regression|crash(es|ed)?|broken|wrong|incorrect)\b"
RATIONALE = r"\b(errat(a|um)|silicon|work[- ]?arounds?|quirks?|chip rev\w*|revision|glitch(es)?|spurious|races?|timing|timeouts?|delays?|reset|retry|retries|hangs?|datasheet|undocumented|anomal\w*|alignment|corrupt\w*|bad data|seen on)\b"
REVERT = r"\brevert(s|ed|ing)?\b"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]+$", "")


def language(path: Column) -> Column:
    """Language by name, else by the extension after a dot that isn't first; ``other`` if unknown."""
    by_name = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    by_extension = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(by_name[basename(path)], by_extension[F.regexp_extract(basename(path), r"^.+\.([^.]+)$", 1)], F.lit("other"))


def in_scope(path: Column, scope: str) -> Column:
    """Whole path segments: the scope itself or what lies below it; the empty scope holds all."""
    return F.lit(True) if not scope else (path == scope) | path.startswith(scope + "/")


def normalize_path(path: Column) -> Column:
    """Folds ``.`` and ``..`` segments; ``..`` above the root is dropped."""
    fold = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda a, s: F.when((s == "") | (s == "."), a).when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)),
    )
    return F.array_join(fold, "/")


def clip(text: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - len(mark)), F.lit(mark))).otherwise(text)


def clip_mark(text: Column, n: int) -> Column:
    """A text of at most n characters; a longer one ends with an ellipsis of one character, without white space before it."""
    return F.when(F.length(text) > n, F.concat(F.regexp_replace(F.left(text, F.lit(n - 1)), r"\s+$", ""), F.lit("\u2026"))).otherwise(text)


def clip_words(text: Column, n: int) -> Column:
    """A text of at most n characters, or what stands before the last space among its first n and an ellipsis.

    A comma, semicolon or colon at the cut is dropped. Without such a space only
    the last character goes.
    """
    first = F.left(text, F.lit(n))
    head = F.when(F.instr(first, " ") > 0, F.regexp_extract(first, r"(?s)^(.*) ", 1)).otherwise(F.left(text, F.length(text) - 1))
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.regexp_replace(head, "[,;:]$", ""), F.lit("\u2026")))


def bare_subject(subject: Column) -> Column:
    """A commit's subject without the name of its part, such as ``driver: ``."""
    return F.regexp_replace(subject, r"^[A-Za-z0-9_./-]+:\s*", "")


def sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, 2, 1 << 30))


def squash(text: Column) -> Column:
    """White space runs as one space, lower case, trimmed."""
    return F.trim(F.lower(F.regexp_replace(text, r"\s+", " ")))


def norm_key(text: Column) -> Column:
    """Lower case with runs of anything but ASCII letters, digits and underscore as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9_]+", " "))


def occurrence_score(text: Column, words: list[str]) -> Column:
    """Per query word that occurs: 1, and 0.2 more for each further occurrence."""
    total = F.lit(0.0)
    for w in words:
        n = (F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)
        total = total + F.when(n > 0, 1 + (n - 1) * 0.2).otherwise(0.0)
    return total


def subject(message: Column) -> Column:
    return F.regexp_replace(F.substring_index(message, "\n", 1), r"^\s+|\s+$", "")


def body(message: Column) -> Column:
    return F.regexp_replace(F.when(F.instr(message, "\n") > 0, F.substring(message, F.instr(message, "\n") + 1, F.length(message))).otherwise(F.lit("")), r"^\s+|\s+$", "")


def message_flags(message: Column) -> dict[str, Column]:
    """bugfix, rationale, revert, revert_of and refs of a commit message."""
    of = F.regexp_extract(message, r"(?i)This reverts commit ([0-9a-f]{7,40})", 1)
    refs = F.regexp_extract_all(message, F.lit(r"(?:^|[\s(,])#(\d{1,6})(?![A-Za-z0-9_])"), 1)
    return {
        "bugfix": F.rlike(message, F.lit("(?i)" + portable(BUGFIX))),
        "rationale": F.rlike(message, F.lit("(?i)" + portable(RATIONALE))),
        "revert": (of != "") | F.rlike(subject(message), F.lit("(?i)" + portable(REVERT))),
        "revert_of": F.when(of != "", of),
        "refs": F.transform(F.array_distinct(refs), lambda r: r.cast("int")),
    }


# Languages of sources and of files whose lines are traced, and paths of tests.
SOURCE_LANGUAGES = ("c", "c-header", "cpp", "cpp-header")
TRACED_LANGUAGES = (*SOURCE_LANGUAGES, "asm")
TEST_PATH = r"(^|/)(tests?|unittests?|gtest)/|(^|/)test_[^/]+$|_tests?\.(c|cc|cpp)$"


def is_source(path: Column) -> Column:
    return language(path).isin(*SOURCE_LANGUAGES)


def is_traced(path: Column) -> Column:
    return language(path).isin(*TRACED_LANGUAGES)


def is_test(path: Column) -> Column:
    return F.rlike(path, F.lit(TEST_PATH))


def is_comment_or_blank(line: Column) -> Column:
    return F.rlike(line, F.lit(r"^\s*($|//|/\*|\*)"))


def sentences(text: Column) -> Column:
    """Sentences of a text with its white space collapsed: parted after a full stop, question or exclamation mark and a space."""
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), r"(?<=[.!?]) "), lambda s: s != "")


def comment_prose(text: Column, most: int = 400) -> Column:
    """The prose of comment lines: their marks dropped, joined, clipped."""
    bare = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"^\s*(?://+|/\*+|\*+(?!/))\s?|\s*\*+/\s*$", ""))
    return clip(F.trim(F.regexp_replace(F.array_join(bare, " "), r"\s+", " ")), most)


def repository(text: Column) -> Column:
    """``owner/name`` of a repository given so or by its web address, null for anything else."""
    return F.nullif(F.regexp_extract(F.trim(text), r"^(?:https?://github\.com/|git@github\.com:)?([\w.-]+/[\w.-]+?)(?:\.git)?/?$", 1), F.lit(""))


def without_prefix(text: Column, prefix: Column) -> Column:
    return F.when(F.startswith(text, prefix), F.substring(text, F.length(prefix) + 1, F.length(text))).otherwise(text)


def percentage(share: Column) -> Column:
    """A share as a label: per cent, with a decimal below ten unless it is 0, and ``<1%`` for less than one that isn't none."""
    per_cent = share * 100
    small = F.concat(F.regexp_replace(F.format_string("%.1f", per_cent), r"\.0$", ""), F.lit("%"))
    return F.when(per_cent == 0, "0%").when(per_cent < 1, "<1%").when(per_cent < 10, small).otherwise(F.concat(F.floor(per_cent + 0.5).cast("string"), F.lit("%")))


# Units of relative times, their seconds, their names for one and more, and words for one unit before and after.
UNITS = (
    (31_536_000, "yr.", "yr.", "last yr.", "next yr."), (2_592_000, "mo.", "mo.", "last mo.", "next mo."), (604_800, "wk.", "wk.", "last wk.", "next wk."),
    (86_400, "day", "days", "yesterday", "tomorrow"), (3_600, "hr.", "hr.", None, None), (60, "min.", "min.", None, None),
)
# Constants of the 32-bit generator.
STEP32, MASK32 = 0x6D2B79F5, 0xFFFFFFFF


def ago(at: Column, now: Column) -> Column:
    """How long a time lies before now, or after, in the largest unit that it fills; empty for none."""
    seconds = F.unix_timestamp(at) - F.unix_timestamp(now)
    told = None
    for size, one, more, before, after in UNITS:
        n = F.floor(seconds / F.lit(float(size)) + 0.5)
        count = F.abs(n)
        amount = F.concat(count.cast("string"), F.lit(" "), F.when(count == 1, one).otherwise(more))
        label = F.when(n < 0, F.concat(amount, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), amount))
        if before:
            label = F.when(n == -1, before).when(n == 1, after).otherwise(label)
        told = F.when(F.abs(seconds) >= size, label) if told is None else told.when(F.abs(seconds) >= size, label)
    return F.when(at.isNull(), "").otherwise(told.otherwise("just now"))


def random32(seed: int, n: Column) -> Column:
    """The n-th number (from 1) of the 32-bit generator that starts with a seed: at least 0, below 1."""
    wrap = lambda x: x.bitwiseAND(F.lit(MASK32))
    right = lambda x, k: F.shiftright(x, k)  # noqa: E731  of numbers that aren't negative

    def times(a: Column, b: Column) -> Column:  # in halves, as the whole product may not fit
        low, high = b.bitwiseAND(F.lit(0xFFFF)), right(b, 16)
        return wrap(a * low + F.shiftleft((a * high).bitwiseAND(F.lit(0xFFFF)), 16))

    state = wrap(F.lit(seed & MASK32).cast("long") + times(F.lit(STEP32).cast("long"), wrap(n.cast("long"))))
    t = times(state.bitwiseXOR(right(state, 15)), state.bitwiseOR(F.lit(1)))
    t = wrap(t + times(t.bitwiseXOR(right(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseXOR(t)
    return t.bitwiseXOR(right(t, 14)) / F.lit(4294967296.0)
