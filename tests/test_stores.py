"""Loose JSON, object streams, the snapshot store and the pack's document."""

import io
import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import pack
from lodestone.sources import loose_json, object_stream, store


@pytest.mark.parametrize(
    ("text", "found", "fixed"),
    [
        ('<think>{"no": 1}</think>\n```json\n{"cups": [2]}\n```', {"cups": [2]}, False),
        ('{"say": "a {brace}, a \\"quote\\" }"}{"say": "again"}', {"say": 'a {brace}, a "quote" }'}, False),
        ('He said "hm" and {wrong} but {"right": true}', {"right": True}, False),
        ('{"text": "one\ntwo\tthree\x01", "list": [{"code": "if (x) {"},\n ],}', {"text": "one\ntwo\tthree\x01", "list": [{"code": "if (x) {"}]}, True),
        ('{"a": NaN} {"b": 1}', {"b": 1}, False),
        ('{"a": {"b": "c\\\\"}} rest }', {"a": {"b": "c\\"}}, False),
        ("sorry", None, None),
        ('{"open": "never', None, None),
        ("{" * 3000 + "}" * 3000 + '{"deep": 0}', {"deep": 0}, False),
        (None, None, None),
        ("", None, None),
    ],
)
def test_first_object(spark, text, found, fixed):
    row = loose_json.loose_json(spark.createDataFrame([(1, text, "x")], "id int, text string, JSON string")).first()
    assert (row["json"] and json.loads(row["json"]), row["repaired"]) == (found, fixed)


def test_all_objects_and_values(spark):
    cut = '{"answer": "Start with \\"fan\\"\nparts.", "claims": [{"text": "psm'
    rows = spark.createDataFrame([(1, 'x {"a": 1} {oops} {"b": {"c": 2}} {"d": 3,}'), (2, cut), (3, "plain"), (4, '{"answer" : "cut off \\'), (5, "y" * 200_000 + '{"answer": "late"}')], "id int, text string")
    found = {r["id"]: r for r in loose_json.loose_json(rows).collect()}
    assert found[1]["objects"] == ['{"a": 1}', '{"b": {"c": 2}}'] and found[1]["value"] is None
    assert (found[2]["json"], found[2]["value"]) == (None, 'Start with "fan"\nparts.')
    assert found[3]["value"] is None and found[4]["value"] == "cut off \\" and found[5]["value"] == "late"
    assert loose_json.loose_json(rows.limit(0)).columns == ["id", "text", "json", "repaired", "objects", "value"]


class Dribble(io.BytesIO):
    """A stream that gives a few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(n, 3))


FRAMES = b"aa blob 5\nab\ncd\nbb missing\ncc tree 0\n\ndd blob 2\n\xff\n\n"


def test_frames_across_borders():
    want = [("aa", "blob", 5, b"ab\ncd", False), ("bb", None, None, None, True), ("cc", "tree", 0, b"", False), ("dd", "blob", 2, b"\xff\n", False)]
    assert list(object_stream.frames(io.BytesIO(FRAMES))) == list(object_stream.frames(Dribble(FRAMES))) == want
    assert list(object_stream.frames(io.BytesIO(b""))) == []


@pytest.mark.parametrize("damaged", [FRAMES[:-1], FRAMES[:-2], FRAMES[:12], b"aa blob\n", b"aa blob 3\nabcd\n", b"no head", b"x" * 9000, b"aa blob x1\n"])
def test_damaged_streams(damaged):
    with pytest.raises(object_stream.DamagedStream):
        list(object_stream.frames(io.BytesIO(damaged)))


def test_streams_are_written_and_read(spark, tmp_path):
    rows = [("a", "blob", bytearray(b"one\ntwo"), False), ("b", "tree", bytearray(b"t"), False), ("c", None, None, True), ("a", "blob", bytearray(b"one\ntwo"), False), ("d", "blob", bytearray(b"\xc3("), False)]
    folder = f"{tmp_path}/stream"
    object_stream.write_objects(spark.createDataFrame(rows, "id string, kind string, content binary, missing boolean").repartition(3), folder)
    read = object_stream.read_objects(spark, folder)
    assert read.count() == 5 and sorted((r["id"], r["size"], r["missing"]) for r in read.collect()) == [("a", 7, False), ("a", 7, False), ("b", 1, False), ("c", None, True), ("d", 2, False)]
    assert {r["id"]: r["text"] for r in object_stream.blobs(read).collect()} == {"a": "one\ntwo", "d": "�("}
    wanted = spark.createDataFrame([("a",), ("c",), ("z",), ("z",)], "id string")
    assert sorted(r["id"] for r in object_stream.missing(read, wanted).collect()) == ["c", "z"]
    (tmp_path / "stream" / "shard-x").write_bytes(FRAMES[:7])
    with pytest.raises(Exception, match="DamagedStream"):
        object_stream.read_objects(spark, folder).count()
    (tmp_path / "none").mkdir()
    assert object_stream.read_objects(spark, f"{tmp_path}/none").count() == 0
    content = spark.createDataFrame([(bytearray(b"hello\n"),)], "c binary").select(object_stream.object_id(F.col("c"))).first()[0]
    assert content == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_readers_see_finished_snapshots_only(spark, tmp_path):
    at = store.SnapshotStore(spark, f"file://{tmp_path}/store")
    one = spark.createDataFrame([("f", "x" * 900)], "name string, signature string")
    assert at.load("symbols").columns == ["snapshot"] and at.finished() == {}
    run = at.save("a/1 é", {"symbols": one, "files": one})
    # A run that fails half-way is seen by nobody, and the next one takes its place.
    broken = one.withColumn("signature", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        at.save("b", {"files": one, "symbols": broken})
    assert {r["snapshot"] for r in at.load("files").collect()} == {"a/1 é"} and at.load("files", ["b"]).count() == 0
    at.save("b", {"files": one.unionByName(one)})
    assert at.load("files", ["b"]).count() == 2 and len(list((tmp_path / "store/files/snapshot=b").iterdir())) == 1
    assert [(r["snapshot"], len(r["signature"])) for r in at.load("symbols").collect()] == [("a/1 é", 500)]
    # A second run of a finished snapshot gives way.
    assert at.save("a/1 é", {"symbols": one.unionByName(one)}) == run and at.load("symbols").count() == 1
    at.delete("a/1 é")
    assert {r["snapshot"] for r in at.load("files").collect()} == {"b"} and at.load("symbols").columns == ["snapshot"]


def test_two_runs_of_one_snapshot(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    at, other, inside = store.SnapshotStore(spark, root), store.SnapshotStore(spark, root), {}
    rows = spark.createDataFrame([(1,)], "x int")

    class Late(dict):
        """Tables between whose writes another run of the snapshot ends."""

        def items(self):
            yield "files", rows
            inside["won"] = other.save("s", {"files": rows.unionByName(rows)})
            yield "more", rows

    assert at.save("s", Late()) == inside["won"]
    assert at.load("files").count() == 2 and at.load("more").columns == ["snapshot"]


def test_signals_know_the_function_around_them(spark):
    symbols = spark.createDataFrame([("o", "a", "function", 1, 20), ("i", "a", "function", 5, 9), ("c", "a", "class", 6, 7)], "id string, path string, kind string, start int, end int")
    signals = spark.createDataFrame([("a", 6, "x"), ("a", 6, "y"), ("a", 2, "z"), ("a", 30, "w"), ("b", 6, "v")], "path string, start int, kind string")
    assert {r["kind"]: r["symbol_id"] for r in store.with_enclosing(signals, symbols).collect()} == {"x": "i", "y": "i", "z": "o", "w": None, "v": None}


def test_the_document_of_a_pack(spark, tmp_path):
    snapshot = spark.createDataFrame([("o/r", "c0")], "repo string, commit string")
    cards = spark.createDataFrame([(1, "STOP", "Keep the delay", "spin", "d/fan.c", 3, 9)], "place int, verdict string, title string, function string, path string, start int, end int")
    components = spark.createDataFrame([("fan", "high", 1, 2, ["spin"]), ("lid", "low", 2, 1, [])], "name string, level string, place int, files int, functions array<string>")
    order = spark.createDataFrame([(1, "d/fan.h", "All use it."), (2, "d/lid.c", "It's long.")], "place int, path string, why string")
    questions = spark.createDataFrame([(None, "3 ends are open."), (7, "Why?")], "place long, text string")
    links = spark.createDataFrame([("x", 2, 5), ("y", 4, 4), ("z", 2, 9)], "name string, files long, count long")
    lines = pack.markdown(F.lit("d"), snapshot, cards, components, order, questions, links, links.limit(0))
    pack.write_document(lines, f"file://{tmp_path}/pack")
    text = "\n".join(line for f in sorted((tmp_path / "pack").glob("part-*")) for line in f.read_text().split("\n")[:-1])
    assert text == (
        "# o/r / d — onboarding pack\nSnapshot `c0`. Every statement is labelled Verified / Inferred / Unknown and cites code or commits at this commit.\n\n"
        "## System at a glance\n**Used by:** y (4), z (2), x (2).\n\n**Depends on:** nothing outside the scope.\n\n"
        "## What not to break\n### STOP if changed: Keep the delay\n`spin`, [fan.c:3–9](https://github.com/o/r/blob/c0/d/fan.c#L3-L9)\n\n"
        "## Components\n- 🔴 **fan** (2 files) — `spin`\n- ⚪ **lid** (1 files) — no scored functions\n\n"
        "## Open questions / unknowns\n- **UNKNOWN** Why?\n- **UNKNOWN** 3 ends are open.\n\n"
        "## Where to start reading\n1. `d/fan.h` — All use it.\n2. `d/lid.c` — It's long."
    )


def test_modules_and_reach_in(spark):
    paths = spark.createDataFrame([("a/b/c.c",), ("a/b.c",), ("b.c",)], "p string")
    assert [r[0] for r in paths.select(pack.module_of(F.col("p"), 2)).collect()] == ["a/b", "a", "b.c"]
    couplings = spark.createDataFrame([("d/x_r.h", "d/x.c"), ("d/y_r.h", "d/y.c")], "header string, owner string")
    includers = spark.createDataFrame([("d/x_r.h", "app/one/a.c"), ("d/x_r.h", "app/one/b.c"), ("d/y_r.h", "t.c")], "header string, path string")
    found = pack.reach_in(couplings, includers, spark.createDataFrame([("cx", "d/x.c")], "component string, path string"), 1)
    assert sorted(map(tuple, found.collect()), key=str) == [("app", "d/x_r.h", "cx"), ("t.c", "d/y_r.h", None)]
