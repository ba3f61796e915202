"""Training-order materialisation: every sequence gets a global slot, and fixed-stride shards hold the slots in order.

Documents become sequences of ``seq_len`` token ids, each a record with the id of
its document and its number in it. Records are numbered by their content (hash
buckets, and the place in a bucket by hash, see ``ranks``), so that key and data
decide the order, whatever the files, the partitions and the cluster are. A keyed
Feistel network over the smallest grid of about sqrt(N) by sqrt(N) permutes the
numbers; values past the end are walked on until they fall inside, so the slots
are exactly 0..N-1. The slots are computed once, by integer expressions, and
written with the records. Range partitions of slots are the shards, written in
slot order as records of one length: slot s lies in shard s // per_shard at byte
(s % per_shard) * stride. Shards are written in waves, so that only a part of all
records lies in shuffle files at any time. A reader seeks to any slot and reads on
in sequence; a writer whose executor is lost writes that shard again and nothing
else.

A record: id of the document (int64; the least value for null), number of the
sequence in it (uint32), ids used (uint32), then seq_len ids (uint16, padded),
then a line feed, all little-endian. A vocabulary whose ids do not fit is refused.

Defined results: a null or empty text gives one sequence without ids; repeated
rows get slots of their own, and may take each other's; an empty table gives no
shard; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, spread, table
from tidemark.llm.ranks import COPIES, apart, content_hash, in_buckets
from tidemark.llm.token_ids import default_files, encoder
from tidemark.runtime import Scratch, remove, shared_path, ship

HEAD = "<qII"
HEAD_SIZE = struct.calcsize(HEAD)
NULL_ID = -(1 << 63)
#: Rounds of the network go in pairs; walks past the end are shorter than ``WALK`` but for a chance of under 1e-48.
PAIRS, WALK, WAVES = 3, 32, 4
#: Records of one outgoing batch, and of one bucket, about.
RECORDS, BUCKET_ROWS = 4096, 1 << 15
#: Lets go of a write's shuffle files when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SHARD = re.compile(r"from-(\d+)/part-(\d+)")


@dataclass
class Shards:
    path: str
    sequences: int
    per_shard: int
    stride: int
    seq_len: int


def grid(n: int) -> tuple[int, int]:
    """Sides of the smallest grid of at least ``n`` cells that is as square as can be; less than one row is too much."""
    side = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return side, -(-max(n, 1) // side)


def round_keys(key: int) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(struct.pack("<qI", key, r), digest_size=8).digest(), "little", signed=True) for r in range(2 * PAIRS)]


def permuted(x: Column, n: int, key: int) -> Column:
    """The keyed permutation of 0..n-1 at ``x``: a Feistel network on the sides of a grid, walked on while it falls outside."""
    a, b = grid(n)
    keys = round_keys(key)
    pairs = F.array(*(F.struct(F.lit(keys[i]).alias("k"), F.lit(keys[i + 1]).alias("m")) for i in range(0, len(keys), 2)))

    def mixed(s: Column, k: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(F.xxhash64(k["k"], s["r"]), F.lit(a)), F.lit(a))
        right = F.pmod(s["r"] + F.pmod(F.xxhash64(k["m"], left), F.lit(b)), F.lit(b))
        return F.struct(left.alias("l"), right.alias("r"))

    def once(v: Column) -> Column:
        begin = F.struct(F.call_function("div", v, F.lit(b)).alias("l"), F.pmod(v, F.lit(b)).alias("r"))
        return F.aggregate(pairs, begin, mixed, lambda s: s["l"] * b + s["r"])

    steps = min(a * b - n, WALK)
    if not steps:
        return once(x)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), once(x), lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(F.assert_true(walked < n).isNull(), walked)


def _xxhash64(*values: np.ndarray) -> np.ndarray:
    """What the SQL function gives for columns of 64-bit integers."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda v, r: v << np.uint64(r) | v >> np.uint64(64 - r)
    h = np.uint64(42)
    with np.errstate(over="ignore"):
        for v in values:
            h = h + p5 + np.uint64(8) ^ turn(v.astype(np.uint64) * p2, 31) * p1
            h = turn(h, 27) * p1 + p4
            h = (h ^ h >> np.uint64(33)) * p2
            h = (h ^ h >> np.uint64(29)) * p3
            h = h ^ h >> np.uint64(32)
    return h.astype(np.int64)


def feistel(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """``permuted`` for an array: where a sequence's number leads to, for whoever asks outside a job."""
    a, b = grid(n)
    keys = [np.full(1, k, np.int64) for k in round_keys(key)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v // b, v % b
        for i in range(0, len(keys), 2):
            left = (left + _xxhash64(keys[i], right) % a) % a
            right = (right + _xxhash64(keys[i + 1], left) % b) % b
        return left * b + right

    out = once(x.astype(np.int64))
    while len(outside := np.flatnonzero(out >= n)):
        out[outside] = once(out[outside])
    return out


def sequences(df: DataFrame, seq_len: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """task, ordinal in the task (which tell equal records apart), and record (without padding) of every sequence."""
    ship(df.sparkSession)
    files = default_files()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task, at = encoder(files), TaskContext.get().partitionId(), 0

        def flush(records: list[bytes]) -> pa.RecordBatch:
            numbers = np.arange(at, at + len(records), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(records), task, np.int64)), pa.array(numbers), pa.array(records, pa.binary())], ["task", "ordinal", "record"])

        for batch in batches:
            records: list[bytes] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                wide = enc.array(text.as_py() or "")
                if len(wide) and wide.max() > 0xFFFF:
                    raise ValueError(f"id {wide.max()} does not fit 16 bits")
                ids = wide.astype("<u2")
                for no, first in enumerate(range(0, max(1, len(ids)), seq_len)):
                    part = ids[first : first + seq_len]
                    records.append(struct.pack(HEAD, NULL_ID if doc is None else doc, no, len(part)) + part.tobytes())
                if len(records) >= RECORDS:
                    yield flush(records)
                    at += len(records)
                    records = []
            yield flush(records)
            at += len(records)

    return id_text(df, id_col, text_col).mapInArrow(make, "task long, ordinal long, record binary")


def slotted(made: DataFrame, n: int, key: int, bucket_rows: int = BUCKET_ROWS, copies: int = COPIES) -> DataFrame:
    """slot and record of ``made`` (task, ordinal and record), which has ``n`` rows and is read more than once."""
    hashed = made.select("record", content_hash([F.col("record")], 10).alias("_h"), F.xxhash64("task", "ordinal").alias("_place"))
    rows, counts = in_buckets(apart(hashed, n, "_place", copies).drop("_place"), max(1, -(-n // bucket_rows)), 10)
    number = F.col("before") + F.col("_r") - 1
    return rows.join(counts.select("bucket", "before"), "bucket").select(permuted(number, n, key).alias("slot"), "record")


def write_shards(df: DataFrame, path: str, seq_len: int = 256, key: int = 20_240_607, shard_bytes: int = 32 << 20, pad: int = 0, waves: int = WAVES, id_col: str = "doc_id", text_col: str = "text", copies: int = COPIES) -> Shards:
    """Write the shards of ``df`` to ``path``, a folder of the shared store."""
    spark = df.sparkSession
    stride = HEAD_SIZE + 2 * seq_len + 1
    per_shard = max(1, shard_bytes // stride)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        with Scratch(spark) as placed_in:
            with Scratch(spark) as scratch:
                made = scratch.table(sequences(df, seq_len, id_col, text_col), "sequences")
                n = made.count()
                out = Shards(path, n, per_shard, stride, seq_len)
                if not n:
                    return out
                shards = -(-n // per_shard)
                step = -(-shards // waves)
                home = shared_path(spark, "placed")
                placed_in.paths.append(home)
                slotted(made, n, key, copies=copies).withColumn("wave", F.expr(f"slot div {step * per_shard}")).write.option("compression", "zstd").partitionBy("wave").parquet(home)
            used = F.octet_length("record")
            filler = F.unhex(F.lit(struct.pack("<H", pad).hex() * seq_len))
            full = F.concat("record", F.substring(filler, F.lit(1), F.lit(HEAD_SIZE + 2 * seq_len) - used))
            for i, first in enumerate(range(0, shards, step)):
                end = min(shards, first + step)
                wave = spark.read.schema("slot long, record binary").parquet(f"{home}/wave={i}")
                dealt = wave.repartitionById(end - first, F.expr(f"cast(slot div {per_shard} as int) - {first}")).sortWithinPartitions("slot")
                dealt.select(full.cast("string").alias("value")).write.option("compression", "none").text(f"{path}/from-{first:08d}")
                remove(spark, f"{home}/wave={i}")
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return out


def read_shards(spark: SparkSession, shards: Shards, first_slot: int = 0) -> DataFrame:
    """slot, shard, byte_offset, doc_id, seq_no, n_ids, ids of what the files hold from ``first_slot`` on, in sequence inside a shard.

    Shards before that slot are not read, which is how a training run resumes.
    """
    ship(spark)
    schema = "slot long, shard long, byte_offset long, doc_id long, seq_no long, n_ids long, ids binary"
    if first_slot >= shards.sequences:
        return spark.createDataFrame([], schema)
    stride, per_shard = shards.stride, shards.per_shard

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard, data = sum(map(int, _SHARD.search(path).groups())), content.as_buffer()
                view = memoryview(data)
                for first in range(max(0, first_slot - shard * per_shard) * stride, len(view), stride * RECORDS):
                    rows = []
                    for at in range(first, min(len(view), first + stride * RECORDS), stride):
                        doc, no, n = struct.unpack_from(HEAD, view, at)
                        ids = bytes(view[at + HEAD_SIZE : at + HEAD_SIZE + 2 * n])
                        rows.append((shard * per_shard + at // stride, shard, at, None if doc == NULL_ID else doc, no, n, ids))
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], ["slot", "shard", "byte_offset", "doc_id", "seq_no", "n_ids", "ids"])

    number = F.regexp_extract("path", r"from-(\d+)/part-", 1).cast("long") + F.regexp_extract("path", r"/part-(\d+)", 1).cast("long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{shards.path}/*").select("path", "content")
    wanted = files.where(number >= first_slot // per_shard) if first_slot else files
    return wanted.mapInArrow(records, schema)


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = write_shards(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), shared_path(spark, "training-order"))
    return read_shards(spark, shards).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
