"""The framed log: little-endian ``length, crc32, op, key length, key, value length, value``.

``length`` counts the checksum's four bytes and the payload; the checksum is of
the payload. Replay takes the valid prefix: the first frame that is torn, has a
wrong checksum, or a length under 4 or over the cap ends it. The cap holds on
writing, too.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import ship
from tidemark.schema import DELETE, MAX_RECORD, PUT


def encode(op: int, key: bytes, value: bytes | None) -> bytes:
    value = value or b""
    payload = struct.pack("<BI", op, len(key)) + key + struct.pack("<I", len(value)) + value
    if len(payload) + 4 > MAX_RECORD:
        raise ValueError(f"a record of {len(payload)} bytes is over the cap of {MAX_RECORD}")
    return struct.pack("<II", len(payload) + 4, zlib.crc32(payload)) + payload


def decode(data: bytes) -> Iterator[tuple[int, bytes, bytes | None, int]]:
    """(op, key, value, end of the frame) of each frame of the valid prefix; a delete has no value, an empty put an empty one."""
    at = 0
    while at + 8 <= len(data):
        length, crc = struct.unpack_from("<II", data, at)
        end = at + 4 + length
        if length < 4 or length > MAX_RECORD or end > len(data):
            return
        payload = data[at + 8 : end]
        if zlib.crc32(payload) != crc or len(payload) < 9:
            return
        op, n = struct.unpack_from("<BI", payload)
        if 9 + n > len(payload):
            return
        (m,) = struct.unpack_from("<I", payload, 5 + n)
        if 9 + n + m != len(payload):
            return
        yield op, payload[5 : 5 + n], None if op == DELETE else payload[9 + n :], end
        at = end


def little_endian(n: Column) -> Column:
    """Four bytes of a number."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(n, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4))))


def payload(op: Column, key: Column, value: Column) -> Column:
    """The payload of a frame, from columns."""
    k, v = F.encode(key, "UTF-8"), F.coalesce(F.encode(value, "UTF-8"), F.unhex(F.lit("")))
    return F.concat(F.unhex(F.lpad(F.hex(op), 2, "0")), little_endian(F.octet_length(k)), k, little_endian(F.octet_length(v)), v)


def frame(op: Column, key: Column, value: Column) -> Column:
    p = payload(op, key, value)
    return F.concat(little_endian(F.octet_length(p) + 4), little_endian(F.crc32(p)), p)


def replay(files: DataFrame) -> DataFrame:
    """path, frame_no, op, key, value and end of the valid prefix of each log in (path, content). A log is one row."""
    ship(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(path, i, op, key.decode("utf-8", "replace"), value, end) for i, (op, key, value, end) in enumerate(decode(content.as_py() or b""))]
                if rows:
                    p, i, op, key, value, end = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(i, pa.int64()), pa.array(op, pa.int32()), pa.array(key), pa.array(value, pa.binary()), pa.array(end, pa.int64())], ["path", "frame_no", "op", "key", "value", "end"])

    return files.select("path", "content").mapInArrow(read, "path string, frame_no long, op int, key string, value binary, end long")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Frames of log files; operations other than put and delete are passed over."""
    return replay(spark.read.format("binaryFile").load(path)).where(F.col("op").isin(PUT, DELETE))
