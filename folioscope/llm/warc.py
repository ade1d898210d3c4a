"""Dictionary-compressed web archives, written and read back.

An archive is a leading skippable frame that holds a Zstandard dictionary, built
from the archive's first records, then one Zstandard frame per WARC record, each
readable alone with that dictionary. A payload met before becomes a revisit
record that names the first page that had it.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import fresh_path, written

#: Skippable frame that holds a dictionary.
SKIPPABLE = 0x184D2A5D
DICTIONARY, SAMPLE = 32 << 10, 1 << 20
#: Bytes of records, before compression, after which the next archive begins.
ARCHIVE = 64 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
MIN_REVISIT = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:page:(-?\d+)>")


def _name(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: bytes, refers_to: int | None) -> bytes:
    """One WARC record. A revisit has the HTTP head and no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; their beginnings as they are where those are too
    few or too alike to train on."""
    try:
        if len(samples) >= 16:
            return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, k=256, d=8)
    except zstandard.ZstdError:
        pass
    raw = b"".join(s[: size // 8] for s in samples[:8])[:size]
    return zstandard.ZstdCompressionDict(raw or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    """Records to one archive. The first SAMPLE bytes wait for the dictionary."""

    def __init__(self, out: BinaryIO) -> None:
        self.out, self.waiting, self.size, self.count, self.packer = out, [], 0, 0, None

    def add(self, data: bytes) -> None:
        self.size += len(data)
        self.count += 1
        if self.packer:
            self.out.write(self.packer.compress(data))
            return
        self.waiting.append(data)
        if self.size >= SAMPLE:
            self._begin()

    def _begin(self) -> None:
        own = dictionary(self.waiting)
        held = own.as_bytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(held)) + held)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=own)
        for data in self.waiting:
            self.out.write(self.packer.compress(data))
        self.waiting = []

    def close(self) -> None:
        if not self.packer:
            self._begin()
        self.out.close()


def records(source: BinaryIO, step: int = 1 << 18, piece: int = 1 << 12) -> Iterator[bytes]:
    """The records of an archive, read in steps. A frame is fed small pieces, as
    what it leaves of its last one is copied."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary")
    held = source.read(size)
    trained = held[:4] == struct.pack("<I", 0xEC30A437)
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held, dict_type=kind))
    frame, parts = reader.decompressobj(), []
    while data := memoryview(source.read(step)):
        at = 0
        while at < len(data):
            part = data[at : at + piece]
            parts.append(frame.decompress(part))
            at += len(part)
            if frame.eof:
                at -= len(frame.unused_data)
                yield b"".join(parts)
                frame, parts = reader.decompressobj(), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Archives of ``page_id, url, html`` under ``folder``, a URI that all
    executors reach; returns ``path, records, bytes`` of each.

    Of pages with equal payloads of ``min_revisit`` bytes or more, the one with
    the smallest page_id is a response, the others revisit it. A null html is an
    empty payload, a null url none. A null page_id is never revisited, and is a
    response if all its equals have none; rows that repeat the smallest page_id
    are responses too. An archive gets its name when it is complete, the same one
    if the task is run again. An empty table has no archives.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    first = rows.groupBy("sha1").agg(F.min("page_id").alias("first"))
    target = F.when((F.col("size") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    planned = rows.join(first, "sha1").select("page_id", "url", "payload", F.unhex("sha1").alias("sha1"), "size", target.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, number, writer, paths, counts, sizes = TaskContext.get().partitionId(), 0, None, [], [], []

        def finish() -> None:
            writer.close()
            name = f"{base}/part-{part:06d}-{number:04d}.warc.zst"
            store.move(draft, name)
            paths.append(name)
            counts.append(writer.count)
            sizes.append(writer.size)

        for b in batches:
            for i in range(b.num_rows):
                page, url, body, sha1, size, refers = (b.column(k)[i].as_py() for k in range(6))
                if writer is None:
                    draft = f"{base}/.draft-{uuid.uuid4().hex}"
                    writer = Writer(store.open_output_stream(draft, compression=None))
                writer.add(record(page, url, body, size, sha1, refers))
                if writer.size >= ARCHIVE:
                    finish()
                    writer, number = None, number + 1
        if writer:
            finish()
        if paths:
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"]
            )

    return written(planned.mapInArrow(run, "path string, records bigint, bytes bigint"), "archives")


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    payload`` of every record; ``archives`` has the column ``path``. Records are
    read one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
        ])
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for data in records(source):
                        fields, http, payload = parse(data)
                        kind = fields["WARC-Type"]
                        own, other = _ID.match(fields["WARC-Record-ID"]), _ID.match(fields.get("WARC-Refers-To", ""))
                        rows.append({
                            "page_id": int(own[1]) if own else None, "url": fields["WARC-Target-URI"],
                            "payload_bytes": int(http["Content-Length"]), "record_type": kind,
                            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                            "refers_to": int(other[1]) if other else None, "payload": payload if kind == "response" else None,
                        })
                        size += len(data)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # an archive is a task's work: small next to it, so one row may be a task
    spread = archives.select("path").repartition(F.col("path"))
    return spread.mapInArrow(
        run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    )


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Pages written to archives, by default in the shared folder, and read back."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
