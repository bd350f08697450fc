"""JSON objects in the answers of models: wrapped in prose, repeated, slightly broken or cut off."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

# What models put around their answers.
_AROUND = re.compile(r"<think>.*?</think>|```(?:json)?", re.S)
_TOKEN = re.compile(r'[{}]|"(?:[^"\\]|\\.)*(?:"|\\?\Z)', re.S)
_OPEN = re.compile(r"\{")
_STRING = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)', re.S)
_CONTROL = re.compile(r"(\\.)|([\x00-\x1f])", re.S)
_COMMA = re.compile(r",(\s*[}\]])")
_ESCAPES = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}


def object_spans(text: str) -> Iterator[str]:
    """The top-level ``{...}`` parts of a text, one after another; quotes count inside of them only."""
    at = 0
    while begin := _OPEN.search(text, at):
        depth = 0
        for m in _TOKEN.finditer(text, begin.start()):
            depth += {"{": 1, "}": -1}.get(m[0], 0)
            if not depth:
                yield text[begin.start() : m.end()]
                break
        if depth:
            return
        at = m.end()


def _escaped(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] or _ESCAPES.get(m[2]) or f"\\u{ord(m[2]):04x}", text)


def repaired(text: str) -> str:
    """A text whose strings hold no raw control characters and whose lists end without a comma."""
    return _COMMA.sub(r"\1", _STRING.sub(lambda m: _escaped(m[0]), text))


def _refuse(name: str):
    raise ValueError(name)


def is_json(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False
    return True


def first_object(text: str) -> tuple[str, bool] | None:
    """The first object that is JSON, as it stands or repaired, and whether it was."""
    for span in object_spans(_AROUND.sub("", text)):
        for attempt in (span, repaired(span)):
            if is_json(attempt):
                return attempt, attempt != span
    return None


def string_value(text: str, key: str) -> str | None:
    """The string behind ``"key":`` in a text that needn't be whole; null without the key."""
    begin = re.search(rf'"{re.escape(key)}"\s*:\s*(?=")', text)
    if not begin:
        return None
    raw = _STRING.match(text, begin.end())[0][1:]
    raw = raw.removesuffix('"') if re.fullmatch(r'(?:[^"\\]|\\.)*"', raw, re.S) else raw
    whole = repaired(f'"{raw}"')
    return json.loads(whole) if is_json(whole) else raw.replace("\\n", "\n").replace('\\"', '"')


def loose_json(answers: DataFrame, text: str = "text", key: str = "answer") -> DataFrame:
    """All columns of ``answers`` with json, repaired, objects and value, read from the column ``text``.

    ``json`` is the first top-level object of the text that is JSON, as it stands
    or once it is repaired (raw line ends and other control characters inside
    strings, commas before a closing bracket), null if there is none;
    ``repaired`` tells which. ``objects`` holds all that are JSON as they stand.
    ``value`` is the string behind ``key`` whether or not its object is whole.
    Reasoning and code fences are passed over first. Texts of any length are
    read whole; a null text has null, an empty list and null. Columns with one of
    these names, in any case, are replaced.
    """
    added = ("json", "repaired", "objects", "value")
    own = [c for c in answers.columns if c.lower() not in added]
    plain = answers.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)))
    at = own.index(text)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found = [first_object(t) for t in texts]
            objects = [[s for s in object_spans(_AROUND.sub("", t)) if is_json(s)] for t in texts]
            more = [pa.array([f and f[0] for f in found], pa.string()), pa.array([f and f[1] for f in found], pa.bool_()), pa.array(objects, pa.list_(pa.string())), pa.array([string_value(t, key) for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *added])

    kinds = (StringType(), BooleanType(), ArrayType(StringType()), StringType())
    schema = StructType([*plain.schema.fields, *(StructField(n, k) for n, k in zip(added, kinds, strict=True))])
    return plain.mapInArrow(run, schema).toDF(*own, *added)
