"""WARC archives as seekable Zstandard bundles.

Records are packed into frames that decompress on their own; a bundle ends in a skippable frame with a seek table, the
sizes of all frames, in the public Zstandard seekable format. The index gives for every record its bundle, the place
and size of its frame, and its offset and length inside the decompressed frame, so one record costs one ranged read.

Bundles are written by the tasks to a folder that all executors and readers share (any folder that Arrow's filesystems
open: local shared mounts, HDFS, object stores). A bundle's name holds the task attempt; the index, which names the
bundles, comes only from attempts that Spark has accepted, so lost executors and repeated attempts leave nothing wrong.

Of records with equal payloads of at least ``least`` bytes, the one with the largest page_id is the response and the
others are revisits that refer to it. A null html is an empty payload. A null page_id is smaller than any other; rows
that repeat the largest page_id of their payload are responses as well. Line breaks in a url become %0D and %0A; a
null url is left out. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 128 << 20
LEVEL = 3
#: Fixed values of the seekable format and of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

INDEX = "page_id long, record_id string, bundle string, frame_start long, frame_bytes long, record_start long, record_bytes long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}:{payload_digest}'.encode()).digest())}"


def encode(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[str, bytes]:
    """One record: its identifier and its bytes. With ``refers_to`` it is a revisit, whose block holds no payload."""
    sha1, revisit = digest(payload), refers_to is not None
    name = record_id(page_id, sha1)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{sha1}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Refers-To: <{record_id(refers_to, sha1)}>", f"WARC-Profile: {REVISIT_PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode(record: bytes) -> dict:
    """The fields of one record; a revisit's payload is null and its size and digest are those of the full payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not the start of a record")
    field = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    sha1, revisit = field["WARC-Payload-Digest"].removeprefix("sha1:"), field["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != declared or digest(payload) != sha1):
        raise ValueError(f"payload of {field['WARC-Record-ID']} is damaged")
    number = lambda name: int(field[name]) if name in field else None
    return {
        "page_id": number("X-Page-Id"),
        "payload_bytes": declared,
        "payload_digest": sha1,
        "record_type": field["WARC-Type"],
        "refers_to": number("X-Refers-To-Page-Id"),
        "url": field.get("WARC-Target-URI"),
        "payload": None if revisit else payload,
    }


class Bundle:
    """Writes one bundle: records gather into frames, ``close`` appends the seek table."""

    def __init__(self, uri: str):
        system, path = pafs.FileSystem.from_uri(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.out, self.press = uri, system.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.at, self.frames, self.open, self.pending = 0, [], bytearray(), []

    def add(self, key: tuple, record: bytes) -> Iterator[tuple]:
        self.pending.append((*key, len(self.open), len(record)))
        self.open += record
        if len(self.open) >= FRAME_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if self.pending:
            packed = self.press.compress(bytes(self.open))
            self.out.write(packed)
            self.frames.append((len(packed), len(self.open)))
            for page_id, name, start, size in self.pending:
                yield page_id, name, self.uri, self.at, len(packed), start, size
            self.at += len(packed)
            self.open, self.pending = bytearray(), []

    def close(self) -> Iterator[tuple]:
        yield from self.flush()
        table = b"".join(struct.pack("<II", *sizes) for sizes in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


def seek_table(source) -> list[tuple[int, int, int]]:
    """(start, packed size, size) of the frames of an open bundle, read from its end."""
    end = source.size()
    source.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    source.seek(end - 9 - count * width)
    entries, out, at = source.read(count * width), [], 0
    for i in range(count):
        packed, size = struct.unpack_from("<II", entries, i * width)
        out.append((at, packed, size))
        at += packed
    return out


def dedupe(pages: DataFrame, least: int = 0) -> DataFrame:
    """Adds ``refers_to``: the page that holds the payload, null where the page itself does.

    Only payloads that occur twice get a row to join with; a payload of a third of all pages is pre-aggregated in the
    map tasks, and its pages are split over tasks by the adaptive skew join.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("_sha"), F.octet_length(body).alias("_size"))
    shared = (
        keyed.filter(F.col("_size") >= least).groupBy("_sha").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
        .filter((F.col("_n") > 1) & F.col("_first").isNotNull()).select("_sha", "_first")
    )
    other = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return keyed.join(shared, "_sha", "left").select("page_id", "url", "html", other.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``page_id, url, html, refers_to`` as bundles below ``folder``; returns the index, to be written once."""

    def run(batches):
        bundle, kind = None, None
        task = TaskContext.get()

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind, strict=True)], NAMES)

        NAMES = ["page_id", "record_id", "bundle", "frame_start", "frame_bytes", "record_start", "record_bytes"]
        kind = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        number = 0
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*[batch.column(c) for c in ("page_id", "url", "html", "refers_to")], strict=True):
                if bundle is None:
                    bundle = Bundle(f"{folder}/bundle-{task.partitionId():05d}-{task.taskAttemptId()}-{number}.warc.zst")
                    number += 1
                payload = html.as_py() if html.is_valid else b""
                name, record = encode(page_id.as_py(), url.as_py(), payload, refers_to.as_py())
                rows += bundle.add((page_id.as_py(), name), record)
                if bundle.at >= BUNDLE_BYTES:
                    rows += bundle.close()
                    bundle = None
            if rows:
                yield out(rows)
        if bundle is not None:
            if rows := list(bundle.close()):
                yield out(rows)

    given = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string").cast("binary").alias("html"), F.col("refers_to").cast("long"))
    return given.mapInArrow(run, INDEX)


def read_archives(index: DataFrame) -> DataFrame:
    """Read the indexed records back. Records of a bundle stay together, sorted by frame; a frame is unpacked once."""

    def run(batches):
        bundle = frame = source = table = None
        data, press = b"", zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                if x["bundle"] != bundle:
                    bundle, frame = x["bundle"], None
                    system, path = pafs.FileSystem.from_uri(bundle)
                    source = system.open_input_file(path)
                    table = {start: (packed, size) for start, packed, size in seek_table(source)}
                if x["frame_start"] != frame:
                    frame = x["frame_start"]
                    packed, size = table[frame]
                    source.seek(frame)
                    data = press.decompress(source.read(packed), max_output_size=size)
                rows.append(decode(data[x["record_start"] : x["record_start"] + x["record_bytes"]]))
                if len(rows) >= 200:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

    def made(rows):
        return pa.RecordBatch.from_pylist(
            rows,
            pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]),
        )

    return index.repartition("bundle").sortWithinPartitions("bundle", "frame_start", "record_start").mapInArrow(run, RECORDS)
