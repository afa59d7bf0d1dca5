"""Files of framed records: a header with a checksum before each, as logs on plain disks have them.

A frame is magic, version, sequence number, milliseconds since 1970, length and CRC-32
of its body, and the body, a compressed JSON object.  A file is read up to its first frame
that isn't whole.  Files come through Spark's own reader, from whatever store it knows;
each is read by one task, so writers begin a new one now and then.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

MAGIC, VERSION = b"SQFR", 1
HEAD = struct.Struct(">4sBQqII")
#: Neither a body nor what it says it expands to may be larger.
MOST = 64 << 20
#: A writer begins a new file before one gets larger; readers pass rows on after so many, or so many characters of payloads.
FILE, ROWS, CHARS = 1 << 20, 10_000, 4 << 20
FRAMES = "path string, seq long, at_ms long, family string, id string, payload string"
KINDS = {"path": pa.string(), "seq": pa.int64(), "at_ms": pa.int64(), "family": pa.string(), "id": pa.string(), "payload": pa.string()}
#: json.dumps makes an encoder for each call.
JSON = json.JSONEncoder(sort_keys=True).encode


def deflated(plain: bytes) -> bytes:
    """A zlib stream whose window is no larger than the record needs: to set up a full one takes longer than to compress a short record."""
    bits = min(15, max(9, len(plain).bit_length()))
    packer = zlib.compressobj(wbits=bits, memLevel=min(8, bits - 6))
    return packer.compress(plain) + packer.flush()


def encode(seq: int, at_ms: int, record: dict) -> bytes:
    """One frame of a record (family, id, payload)."""
    plain = JSON(record).encode()
    if len(plain) > MOST:
        raise ValueError("a record is larger than a frame may be")
    body = struct.pack(">I", len(plain)) + deflated(plain)
    return HEAD.pack(MAGIC, VERSION, seq, at_ms, len(body), zlib.crc32(body)) + body


def decode(data: bytes | memoryview) -> Iterator[tuple[int, int, dict]]:
    """(seq, milliseconds, record) of all whole frames at the beginning of some bytes."""
    at = 0
    while at + HEAD.size <= len(data):
        magic, version, seq, ms, size, crc = HEAD.unpack_from(data, at)
        body = data[at + HEAD.size : at + HEAD.size + size]
        if magic != MAGIC or version != VERSION or size > MOST or len(body) < size or size < 4 or zlib.crc32(body) != crc:
            return
        (plain_size,) = struct.unpack_from(">I", body)
        if plain_size > MOST:
            return
        try:
            plain = zlib.decompressobj().decompress(body[4:], plain_size + 1)
            record = json.loads(plain)
        except (zlib.error, ValueError):
            return
        if len(plain) != plain_size or not isinstance(record, dict):
            return
        yield seq, ms, record
        at += HEAD.size + size


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """path, seq, at_ms, family, id and payload (JSON) of all whole frames of the files under a path."""
    return frames_of(spark.read.format("binaryFile").load(path).select("path", "content"))


def small_batches(spark: SparkSession) -> None:
    """Has Spark hand Python about 8 MB at once, unless the session sets a number of its own: files and long payloads would fill the default's 64 MB, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).removesuffix("b") == str(64 << 20):
        spark.conf.set(name, str(8 << 20))


def frames_of(files: DataFrame) -> DataFrame:
    """The whole frames of rows with a file's bytes (content) and perhaps its path."""
    small_batches(files.sparkSession)
    files = files if "path" in files.columns else files.withColumn("path", F.lit(None).cast("string"))
    return files.select("path", "content").mapInArrow(unframed, FRAMES)


def unframed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frames of batches of files (path, content); their rows leave in batches of a size of their own, however large a file is."""
    rows, chars = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS.values(), strict=True)], list(KINDS))

    for b in batches:
        for path, content in zip(b.column(0), b.column(1), strict=True):
            name = path.as_py()
            for seq, ms, r in decode(memoryview(content.as_buffer())):
                payload = JSON(r.get("payload"))
                rows.append((name, seq, ms, r.get("family"), None if r.get("id") is None else str(r["id"]), payload))
                chars += len(payload)
                if len(rows) >= ROWS or chars >= CHARS:
                    yield batch()
                    rows, chars = [], 0
    if rows:
        yield batch()


def framed(rows: DataFrame, most: int = FILE) -> DataFrame:
    """(part, place, content) with the bytes of the files that each partition of rows (seq, at_ms, family, id, payload) makes, in order of seq.

    A task holds one file at a time: the next one begins before a file gets larger than ``most``,
    so only one of a single frame can be larger.  A partition without rows makes no file.
    """

    small_batches(rows.sparkSession)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        out = bytearray()
        for b in batches:
            for seq, ms, family, name, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                frame = encode(seq, ms, {"family": family, "id": name, "payload": json.loads(payload)})
                if out and len(out) + len(frame) > most:
                    yield bytes(out)
                    out.clear()
                out += frame
        if out:
            yield bytes(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, content in enumerate(files(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([content], pa.binary())], ["place", "content"])

    return rows.select("seq", "at_ms", "family", "id", "payload").sortWithinPartitions("seq").mapInArrow(run, "place long, content binary").withColumn("part", F.spark_partition_id())


def last_seq(frames: DataFrame) -> int:
    """The greatest sequence number, -1 if there is none: a writer goes on behind it."""
    found = frames.agg(F.max("seq")).first()[0]
    return -1 if found is None else found


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, place, family, id and payload of JSON lines; a line that isn't JSON ends its file, as a torn write would."""
    schema = "path string, place long, family string, id string, payload string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, line in enumerate(data.split(b"\n")):
                    try:
                        r = json.loads(line)
                    except ValueError:
                        break
                    rows.append((name, i, r.get("family"), str(r.get("id")), json.dumps(r.get("payload"), sort_keys=True)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)
