"""What a Python worker holds of its texts, within a task and after it."""

import os
import re
from pathlib import Path

import pyarrow as pa

from lodestone.llm import common


def test_texts_are_taken_up_in_parts():
    texts = ["a" * 30, None, "", "é" * 20, "b" * 500, "c", "d" * 60, "e" * 41, None]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["id", "text"])] * 2
    batches.append(batches[0].slice(0, 0))
    found = [x.to_pydict() for x in common.text_parts(batches, 1, 100)]
    assert [t for x in found for t in x["text"]] == texts * 2 and [i for x in found for i in x["id"]] == [*range(9)] * 2
    sizes = [[len((t or "").encode()) for t in x["text"]] for x in found]
    assert all(sum(s) <= 100 or len(s) == 1 for s in sizes) and len(found) < 2 * 9


def test_a_task_gives_its_memory_back(spark):
    """A worker that is kept for later tasks holds little of what a task before it used."""

    def held():
        return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) >> 10

    def use(batches):
        for batch in batches:
            used = [bytes(1000) for _ in range(300_000)]
            os.lodestone_last = bytes(1000)  # above the others, so that these aren't freed by themselves
            del used
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()] * batch.num_rows, pa.int64()), pa.array([held()] * batch.num_rows, pa.int64())], ["pid", "mb"])

    def look(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()] * batch.num_rows, pa.int64()), pa.array([held()] * batch.num_rows, pa.int64())], ["pid", "mb"])

    one = spark.range(1).repartition(1)
    (used,) = common.map_batches(one, use, "pid long, mb long").collect()
    (later,) = one.mapInArrow(look, "pid long, mb long").collect()
    assert used["mb"] > 250
    assert later["pid"] == used["pid"] and later["mb"] < used["mb"] - 200
