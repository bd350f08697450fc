"""What a change to a source means: only comments, only messages, or code."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources.c_structure import blank

# Calls whose strings are messages for people.
LOG_CALLS = frozenset(
    "debug printf fprintf puts DEV_PRINTF GCS_SEND_TEXT send_text console_printf hal_printf snprintf panic AP_HAL::panic INTERNAL_ERROR "
    "LOG_INFO LOG_WARN LOG_ERROR LOG_DEBUG PX4_INFO PX4_WARN PX4_ERR PX4_DEBUG printk syslog".split()
)
# The tokens of code, and the name before a parenthesis.
TOKEN = re.compile(r"[A-Za-z_]\w*|\d[\w.]*|\S", re.A)
CALLEE = re.compile(r"([A-Za-z_][\w:]*)\s*$", re.A)


def literals(source: str, code: str) -> list[tuple[str, str | None]]:
    """String and character literals in order, each with the call that it is an argument of.

    ``code`` is the blanked source: its quotes are where literals begin and end.
    The parentheses open at a literal are kept while the code is read once.
    """
    out, opened = [], []
    at = 0
    for m in re.finditer(r"""["'();{}]""", code):
        if m.start() < at:
            continue
        if m[0] in "\"'":
            close = code.find(m[0], m.end())
            if close < 0:
                break
            callee = CALLEE.search(code, max(0, opened[-1] - 80), opened[-1]) if opened else None
            out.append((source[m.end() : close], callee and callee[1]))
            at = close + 1
        elif m[0] == "(":
            opened.append(m.start())
        elif m[0] == ")":
            if opened:
                opened.pop()
        else:
            opened.clear()
    return out


def meaning(source: str, messages: bool) -> tuple:
    """What a source means: its tokens, directives and literals; without ``messages`` those for people don't matter."""
    hidden = blank(source)
    texts = (text if messages or call not in LOG_CALLS else None for text, call in literals(source, hidden.code))
    return tuple(TOKEN.findall(hidden.code)), tuple(" ".join(text.split()) for _, text in hidden.directives), tuple(texts)


def change_class(old: str | None, new: str | None) -> str:
    """The class of a change to a C or C++ source: the mildest by which both sides mean the same, else code."""
    if old is not None and new is not None:
        for kind, messages in (("comment_whitespace", True), ("log_string", False)):
            if meaning(old, messages) == meaning(new, messages):
                return kind
    return "code"


def change_classes(changes: DataFrame) -> DataFrame:
    """Adds ``change_class`` to changes with path, old_text and new_text; prose is docs, other languages are code."""
    kind = T.language(F.col("path"))
    plain = changes.withColumn("change_class", F.when(kind.isin("markdown", "text"), "docs").when(~T.is_source(F.col("path")), "code"))

    def run(batches):
        for batch in batches:
            known = batch.column(batch.schema.get_field_index("change_class")).to_pylist()
            sides = zip(known, batch.column("old_text").to_pylist(), batch.column("new_text").to_pylist(), strict=True)
            found = pa.array([k or change_class(old, new) for k, old, new in sides], pa.string())
            yield batch.set_column(batch.schema.get_field_index("change_class"), "change_class", found)

    return plain.mapInArrow(run, plain.schema)
