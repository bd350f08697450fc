"""Objects of a repository in a framed stream, as a data source that Spark reads and writes.

A frame is ``id kind size``, a line end, that many bytes and a line end; an
object that the repository lacks is ``id missing`` and a line end. A stream is a
folder of shards; a shard is read in pieces, whatever the sizes of its objects.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "id string, kind string, size long, content binary, missing boolean"
PIECE = 1 << 20  # bytes that are read at a time
BATCH_BYTES = 1 << 24  # of contents that leave in one batch
LONGEST_HEAD = 4096  # bytes of a frame's first line
_DONE = "_finished"


class DamagedStream(ValueError):
    """A stream that ends inside a frame, or whose frames don't follow one another."""


class _Pieces:
    """Lines and runs of bytes of a stream that is read in pieces."""

    def __init__(self, stream, name: str):
        self.stream, self.name, self.held, self.at = stream, name, b"", 0

    def _more(self) -> bool:
        piece = self.stream.read(PIECE)
        self.held, self.at = self.held[self.at :] + piece, 0
        return bool(piece)

    def line(self) -> bytes | None:
        """The next line without its end; null where the stream ends."""
        while (end := self.held.find(b"\n", self.at)) < 0:
            if len(self.held) - self.at > LONGEST_HEAD:
                raise DamagedStream(f"{self.name}: no head of an object where one should begin")
            if not self._more():
                if self.at < len(self.held):
                    raise DamagedStream(f"{self.name}: it ends inside the head of an object")
                return None
        line, self.at = self.held[self.at : end], end + 1
        return line

    def take(self, n: int) -> bytes:
        parts, left = [], n
        while left:
            piece = self.held[self.at : self.at + left]
            if piece:
                parts.append(piece)
                self.at += len(piece)
                left -= len(piece)
            elif not self._more():
                raise DamagedStream(f"{self.name}: it ends inside an object")
        return b"".join(parts)


def frames(stream, name: str = "stream") -> Iterator[tuple[str, str | None, int | None, bytes | None, bool]]:
    """(id, kind, size, content, missing) of every frame of a stream of bytes."""
    pieces = _Pieces(stream, name)
    while (head := pieces.line()) is not None:
        words = head.decode("utf-8", "replace").split(" ")
        if len(words) == 2 and words[1] == "missing":
            yield words[0], None, None, None, True
        elif len(words) == 3 and words[2].isdecimal():
            content = pieces.take(int(words[2]))
            if pieces.take(1) != b"\n":
                raise DamagedStream(f"{name}: an object is longer than its head says")
            yield words[0], words[1], len(content), content, False
        else:
            raise DamagedStream(f"{name}: {head[:80]!r} is no head of an object")


@dataclass
class _Shard(InputPartition):
    path: str


def _folder(options: dict) -> tuple[fs.FileSystem, str]:
    path = options["path"]
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        files, folder = _folder(self.options)
        found = files.get_file_info(fs.FileSelector(folder))
        return [_Shard(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition):
        if partition is None:  # no shards
            return
        files, _ = _folder(self.options)
        names = ["id", "kind", "size", "content", "missing"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        with files.open_input_stream(partition.path) as stream:
            held, size = [], 0
            for frame in frames(stream, partition.path):
                held.append(frame)
                size += frame[2] or 0
                if size >= BATCH_BYTES or len(held) >= 10_000:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _Writer(DataSourceWriter):
    """Each task writes a hidden file; the driver gives those of tasks that counted their names, so that a lost task leaves none."""

    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator):
        files, folder = _folder(self.options)
        files.create_dir(folder, recursive=True)
        name = f"shard-{uuid.uuid4().hex}"
        with files.open_output_stream(f"{folder}/.{name}") as out:
            for row in iterator:
                if row["missing"]:
                    out.write(f"{row['id']} missing\n".encode())
                else:
                    content = bytes(row["content"] or b"")
                    out.write(f"{row['id']} {row['kind']} {len(content)}\n".encode())
                    out.write(content)
                    out.write(b"\n")
        return _Written(name)

    def commit(self, messages):
        files, folder = _folder(self.options)
        for message in messages:
            if message is not None:
                files.move(f"{folder}/.{message.name}", f"{folder}/{message.name}")
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/{_DONE}") as out:
            out.write(b"")

    def abort(self, messages):
        files, folder = _folder(self.options)
        for message in messages:
            if message is not None:
                files.delete_file(f"{folder}/.{message.name}")


class ObjectStream(DataSource):
    """``spark.read.format("object_stream").load(folder)`` and ``df.write.format("object_stream").mode("append").save(folder)``."""

    @classmethod
    def name(cls):
        return "object_stream"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def write_objects(objects: DataFrame, folder: str) -> None:
    """Writes objects (id, kind, content and missing) as a stream of as many shards as there are partitions."""
    objects.sparkSession.dataSource.register(ObjectStream)
    objects.select("id", "kind", F.octet_length("content").cast("long").alias("size"), "content", "missing").write.format("object_stream").mode("append").save(folder)


def read_objects(spark: SparkSession, folder: str) -> DataFrame:
    """All frames of a stream: id, kind, size, content and missing; what is missing has nulls. A damaged stream raises."""
    spark.dataSource.register(ObjectStream)
    return spark.read.format("object_stream").load(folder)


def object_id(content: F.Column, kind: str = "blob") -> F.Column:
    """The id of an object: the SHA-1 of its kind, size and content."""
    head = F.concat(F.lit(kind + " "), F.octet_length(content).cast("string"), F.lit("\0")).cast("binary")
    return F.sha1(F.concat(head, content))


def blobs(objects: DataFrame) -> DataFrame:
    """(id, text) of the blobs that are there, equal objects once; their bytes are read as UTF-8, with marks for what isn't."""
    return objects.where("kind = 'blob' AND NOT missing").dropDuplicates(["id"]).select("id", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def missing(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids of ``wanted`` that no frame holds, those of frames that say so included, each once."""
    there = objects.where("NOT missing").select("id").distinct()
    return wanted.select("id").distinct().join(there, "id", "left_anti")
