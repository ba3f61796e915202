"""Sorted segment files: entries, a sparse index, a Bloom filter and a footer, all little-endian.

An entry is key length, key, value length (all ones: a tombstone), value. The
index is a count, then key length, key and offset of every 16th entry. The
footer has offset and size of index and filter, the filter's hash count, and the
number of entries. Files have no filter size in bits: a filter that was built
with another size than eight times its bytes cannot be probed once reopened
(``filter_fits``), so an import builds its own filters.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.store import python_positions
from tidemark.runtime import ship
from tidemark.schema import BITS_PER_KEY, DELETE, INDEX_EVERY, PUT

#: The footer's layout, and the length that marks a tombstone.
FOOTER, TOMBSTONE = "<qqqqII", 0xFFFFFFFF
FOOTER_SIZE = struct.calcsize(FOOTER)


class SegmentError(ValueError):
    pass


def encode(entries: list[tuple[bytes, bytes | None]]) -> bytes:
    """A file of entries that are sorted by key."""
    if any(a[0] >= b[0] for a, b in zip(entries, entries[1:])):
        raise SegmentError("keys are not in ascending order")
    out, index = bytearray(), []
    bits, hashes = max(64, BITS_PER_KEY * max(1, len(entries))), 6
    filter_ = bytearray(-(-bits // 8))
    for i, (key, value) in enumerate(entries):
        if i % INDEX_EVERY == 0:
            index.append((key, len(out)))
        out += struct.pack("<I", len(key)) + key + struct.pack("<I", TOMBSTONE if value is None else len(value)) + (value or b"")
        for p in python_positions(key, bits, hashes):
            filter_[p // 8] |= 1 << p % 8
    at = len(out)
    block = struct.pack("<I", len(index)) + b"".join(struct.pack("<I", len(k)) + k + struct.pack("<q", o) for k, o in index)
    return bytes(out + block + filter_ + struct.pack(FOOTER, at, len(block), at + len(block), len(filter_), hashes, len(entries)))


def footer(data: bytes) -> tuple[int, int, int, int, int, int]:
    if len(data) < FOOTER_SIZE:
        raise SegmentError("no footer")
    f = struct.unpack(FOOTER, data[-FOOTER_SIZE:])
    if not (0 <= f[0] and f[0] + f[1] <= f[2] and f[2] + f[3] <= len(data) - FOOTER_SIZE and min(f[:4]) >= 0):
        raise SegmentError("the footer points outside the file")
    return f


def entries(data: bytes) -> Iterator[tuple[bytes, bytes | None]]:
    end, at, n = footer(data)[0], 0, 0

    def take(size: int) -> bytes:
        nonlocal at
        if at + size > end:
            raise SegmentError("an entry is cut")
        at += size
        return data[at - size : at]

    while at < end:
        key = take(struct.unpack("<I", take(4))[0])
        (size,) = struct.unpack("<I", take(4))
        yield key, None if size == TOMBSTONE else take(size)
        n += 1
    if n != footer(data)[5]:
        raise SegmentError(f"{n} entries; the footer says {footer(data)[5]}")


def index(data: bytes) -> list[tuple[bytes, int]]:
    at = footer(data)[0]
    (n,) = struct.unpack_from("<I", data, at)
    out, at = [], at + 4
    for _ in range(n):
        (size,) = struct.unpack_from("<I", data, at)
        key = data[at + 4 : at + 4 + size]
        out.append((key, struct.unpack_from("<q", data, at + 4 + size)[0]))
        at += 12 + size
    return out


def filter_fits(data: bytes) -> bool:
    """Does the stored filter still have every key when it is probed with eight times its bytes?"""
    f = footer(data)
    bits = data[f[2] : f[2] + f[3]]
    return all(bits[p // 8] >> p % 8 & 1 for key, _ in entries(data) for p in python_positions(key, 8 * len(bits), f[4]))


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, key, op, value of all entries under ``path``; one file is one row of a task. A bad file fails the read."""
    ship(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(name, k.decode("utf-8", "replace"), DELETE if v is None else PUT, v) for k, v in entries(content.as_py())]
                if rows:
                    names, keys, ops, values = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(keys), pa.array(ops, pa.int32()), pa.array(values, pa.binary())], ["path", "key", "op", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(path).select("path", "content")
    return files.mapInArrow(decode, "path string, key string, op int, value binary")


def round_trip(rows: DataFrame) -> DataFrame:
    """segment, place, key, op, value of entries (segment, key, op, value as text) that were written as one file for each segment and read back. A file, which a flush bounds, is made in one task."""
    ship(rows.sparkSession)

    def through(group: pa.Table) -> pa.Table:
        pairs = [(k.encode(), None if op == DELETE else (v or "").encode()) for k, op, v in zip(*(group.column(c).to_pylist() for c in ("key", "op", "value")))]
        back = list(entries(encode(sorted(pairs))))
        segment = group.column("segment")[0].as_py()
        names = ["segment", "place", "key", "op", "value"]
        columns = [[segment] * len(back), list(range(len(back))), [k.decode() for k, _ in back], [DELETE if v is None else PUT for _, v in back], [None if v is None else v.decode() for _, v in back]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string()))], names=names)

    return rows.select("segment", "key", "op", "value").groupBy("segment").applyInArrow(through, "segment long, place long, key string, op int, value string")
