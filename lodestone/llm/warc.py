"""WARC archives: one gzip member per record, read back in sequence.

Executors write the archives into the folder that all of them share, each under
a name of its own attempt, which a rename then makes final. The reader takes an
archive as a stream: it inflates member after member incrementally, frames the
block by the content length and verifies the digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import fresh_path, stash

# Fixed values of the WARC 1.1 standard.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: All records carry one date: archives of the same pages are then the same bytes.
DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 16
SALTS = 64  # ways that the pages of one payload are dealt out


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(text: str) -> str:
    """A value that fits on one header line: anything else is percent-encoded."""
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], text.encode("utf-8")).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit leaves its payload out but says its size."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {header_value(url or '')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    raw = VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    def page(self, name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", self.headers.get(name, ""))
        return int(found[1]) if found else None

    def http(self) -> tuple[bytes, bytes]:
        head, _, payload = self.block.partition(b"\r\n\r\n")
        return head, payload


class Damaged(ValueError):
    """An archive that is cut off, wrongly framed or fails a digest."""


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The inflated bytes of each gzip member, read chunk by chunk."""
    pending = b""
    while True:
        pending = pending or stream.read(CHUNK)
        if not pending:
            return
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if not pending and not (pending := stream.read(CHUNK)):
                raise Damaged("the archive ends within a record")
            try:
                out.append(inflate.decompress(pending))
            except zlib.error as e:
                raise Damaged(f"a record can't be inflated: {e}") from e
            pending = inflate.unused_data
        yield b"".join(out)


def parse(raw: bytes) -> Record:
    """One record: version line, headers, the block framed by its length, two line ends."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise Damaged("no WARC record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header without a colon")
        headers[name.decode().strip()] = value.decode().strip()
    try:
        size = int(headers["Content-Length"])
    except (KeyError, ValueError) as e:
        raise Damaged("no content length") from e
    if size < 0 or rest[size:] != b"\r\n\r\n":
        raise Damaged("the block doesn't end where its content length says")
    return Record(headers, rest[:size])


def verified(record: Record) -> Record:
    """Checks the block's digest and, where it holds the payload, the payload's."""
    if record.headers.get("WARC-Block-Digest") != f"sha1:{digest(record.block)}":
        raise Damaged("the block digest differs")
    if record.headers.get("WARC-Type") == "response" and record.headers.get("WARC-Payload-Digest") != f"sha1:{digest(record.http()[1])}":
        raise Damaged("the payload digest differs")
    return record


def read_archive(stream: BinaryIO) -> Iterator[Record]:
    return (verified(parse(raw)) for raw in members(stream))


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds payload, its SHA-1 and, for revisits, the page they refer to.

    Of equal payloads of at least ``min_bytes`` the largest page_id is the
    response. Rows that repeat this page_id and payload are responses too. A
    null page_id is a response by itself and nothing refers to it.
    """
    sized = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    groups = (
        sized.where((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull())
        .groupBy("sha1")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
        .where("n > 1")
        .select("sha1", "kept")
    )
    # Payloads don't move by their digest, which a third of all pages may share: ids alone meet the
    # groups, dealt out by a salt, and what they refer to then joins the pages by their ids.
    groups = stash(groups, "payload-groups").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    ids = sized.where("page_id IS NOT NULL").select("page_id", "sha1", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt"))
    refers = ids.join(groups, ["sha1", "salt"]).where("page_id <> kept").select("page_id", "sha1", F.col("kept").alias("refers_to")).distinct()
    return sized.join(refers, ["page_id", "sha1"], "left").select("page_id", "url", "payload", "sha1", "refers_to")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per partition; returns (path, records) of each.

    ``pages`` comes from ``with_revisits``. A task writes under a name of its
    own and renames at its end, so a task that is run again or twice leaves one
    archive whose path is the one returned.
    """

    def run(batches):
        filesystem, base = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        path, out, n = f"{base}/{name}.warc.gz", None, 0
        for batch in batches:
            if out is None and batch.num_rows:
                out = filesystem.open_output_stream(f"{base}/{name}.part", compression=None)
            for page_id, url, payload, sha1, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to")), strict=True):
                out.write(record(page_id, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to))
                n += 1
        if out is not None:
            out.close()
            filesystem.move(f"{base}/{name}.part", path)
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.gz"]), pa.array([n], pa.int64())], ["name", "records"])

    return pages.select("page_id", "url", "payload", "sha1", "refers_to").mapInArrow(run, "name string, records long")


def read_archives(archives: DataFrame, folder: str, keep_payload: bool = False) -> DataFrame:
    """The records of archives listed by ``name``, in their sequence.

    Raises ``Damaged`` where an archive is cut off, wrongly framed or altered.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * keep_payload
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def row(r: Record) -> tuple:
        head, payload = r.http()
        size = re.search(rb"(?im)^content-length: *(\d+)", head)
        found = (r.page("WARC-Record-ID"), int(size[1]), r.headers["WARC-Payload-Digest"].removeprefix("sha1:"), r.headers["WARC-Type"], r.page("WARC-Refers-To"))
        return found + (r.headers["WARC-Target-URI"], payload) * keep_payload

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, types[x.split()[1]]) for c, x in zip(zip(*rows, strict=True), schema.split(", "), strict=True)], names)

    def run(batches):
        filesystem, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with filesystem.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for r in read_archive(stream):
                        rows.append(row(r))
                        held += len(r.block) if keep_payload else 100
                        if held > 1 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return archives.select("name").mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes all pages into archives and reads them back; one row per page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to. A
    null html is an empty payload and a null url an empty target; characters
    that no header line can hold are percent-encoded. Repeated rows make a
    record each, an empty table none, and other columns are ignored. A payload
    of any length is written and read in pieces.
    """
    folder = fresh_path(spark, "warc")
    written = stash(write_archives(with_revisits(pages, min_bytes), folder), "archives")
    n = written.count()
    # One archive a task: the list holds a row for each partition written, dealt out by ranges of their names.
    spread = written.repartitionByRange(n, "name") if n else written
    return read_archives(spread, folder)
