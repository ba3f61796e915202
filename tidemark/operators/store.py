"""A versioned key-value store on Parquet segments.

Mutations get dense sequence numbers and are appended as log tables; a flush
resolves the log's tail into a sorted level-0 segment; a compaction merges all
segments into level 1. Segments are written first and then published by a new
manifest version, which lists everything a reader needs: paths, levels, key and
seq bounds, counts, and a Bloom filter with its size. Readers hold a version and
never see a half-written segment. One writer at a time is assumed; publishing
relies on a rename that fails if the version is there already.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bloom
from tidemark.operators import layers, lww
from tidemark.schema import DELETE, L0_TABLES, MEMTABLE_BYTES, PUT

LOG = "seq long, key string, op int, value binary"


@dataclass
class Segment:
    segment_id: int
    level: int
    path: str
    min_key: str
    max_key: str
    min_seq: int
    max_seq: int
    n_entries: int
    n_tombstones: int
    bytes: int
    num_bits: int
    num_hash: int
    bits: str | None = None  # the filter, num_bits bits from the lowest of each byte, in base64


@dataclass
class Manifest:
    version: int = 0
    next_seq: int = 1
    flushed_seq: int = 0
    next_segment: int = 1
    segments: list[dict] = field(default_factory=list)
    logs: list[list] = field(default_factory=list)  # path, first seq, last seq, bytes


class Store:
    """put, get, delete, batch reads, scans, flush, compact, vacuum and status."""

    def __init__(self, spark: SparkSession, path: str, memtable_bytes: int = MEMTABLE_BYTES, l0_tables: int = L0_TABLES, bloom_keys: int = 100_000, partitions: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.memtable_bytes, self.l0_tables, self.bloom_keys, self.partitions = memtable_bytes, l0_tables, bloom_keys, partitions
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(f"{self.path}/_manifest"))
        self.manifest = self._latest()

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(f"{self.path}/_manifest"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _latest(self) -> Manifest:
        versions = self._versions()
        return self.read_manifest(versions[-1]) if versions else Manifest()

    def read_manifest(self, version: int) -> Manifest:
        stream = self.fs.open(self._path(f"{self.path}/_manifest/v{version:020d}.json"))
        try:
            return Manifest(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def _publish(self, m: Manifest) -> None:
        m.version = self.manifest.version + 1
        draft = self._path(f"{self.path}/_manifest/.draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()
        final = self._path(f"{self.path}/_manifest/v{m.version:020d}.json")
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise RuntimeError(f"another writer has published version {m.version}")
        self.manifest = m

    def _copy(self) -> Manifest:
        return Manifest(**json.loads(json.dumps(asdict(self.manifest))))

    # Writes.

    def put(self, key: str, value: bytes | str, compat: str | None = None) -> int:
        raw = value.encode() if isinstance(value, str) else bytes(value)
        if compat == "empty_is_delete" and not raw:
            return self.delete(key)
        return self.write([(PUT, key, raw)])

    def delete(self, key: str) -> int:
        return self.write([(DELETE, key, None)])

    def write(self, mutations: list[tuple[int, str, bytes | None]]) -> int:
        """Append mutations in this order; the seq of the last. It returns when the batch is committed."""
        if any(not key for _, key, _ in mutations):
            raise ValueError("a key is empty")
        first = self.manifest.next_seq
        rows = [(first + i, key, op, bytearray(value) if value is not None else None) for i, (op, key, value) in enumerate(mutations)]
        return self._append(self.spark.createDataFrame(rows, LOG), first, first + len(rows) - 1)

    def ingest(self, rows: DataFrame) -> None:
        """Resolved mutations that have their seq already, as a segment of level 0."""
        resolved = lww.resolve(rows.select(F.col("seq").cast("long"), "key", F.col("op").cast("int"), F.col("value").cast("binary")).where(F.length("key") > 0))
        self._write_segments(resolved, self._copy(), 0)

    def _append(self, rows: DataFrame, first: int, last: int) -> int:
        path = f"{self.path}/log/{first:020d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(path)
        size = self.spark.read.schema(LOG).parquet(path).agg(F.coalesce(F.sum(layers.entry_bytes()), F.lit(0))).first()[0]
        m = self._copy()
        m.logs.append([path, first, last, size])
        m.next_seq = last + 1
        self._publish(m)
        if sum(x[3] for x in m.logs) >= self.memtable_bytes:
            self.flush()
        return last

    # Layers.

    def _tail(self, m: Manifest) -> DataFrame:
        paths = [x[0] for x in m.logs]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def _segments(self, m: Manifest, keep=lambda s: True) -> DataFrame:
        paths = [s["path"] for s in m.segments if keep(s)]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def log(self, version: int | None = None, keep=lambda s: True) -> DataFrame:
        """The union of all layers of a version; the newest seq of a key is its state."""
        m = self.manifest if version is None else self.read_manifest(version)
        return self._tail(m).unionByName(self._segments(m, keep))

    # Reads.

    def get(self, key: str) -> tuple[bytes | None, bool]:
        """(value, True) of a live key, (None, True) of a deleted one, (None, False) of one that was never written."""
        row = lww.get(self.log(keep=lambda s: self._may_hold(s, key)), key).select("op", "value").first()
        if row is None:
            return None, False
        return (bytes(row["value"]) if row["op"] == PUT else None), True

    def _may_hold(self, s: dict, key: str) -> bool:
        if not s["min_key"].encode() <= key.encode() <= s["max_key"].encode():
            return False
        if s["bits"] is None:
            return True
        bits = base64.b64decode(s["bits"])
        return all(bits[p >> 3] >> (p & 7) & 1 for p in python_positions(key.encode(), s["num_bits"], s["num_hash"]))

    def snapshot(self, version: int | None = None) -> DataFrame:
        return lww.snapshot(self.log(version)).select("key", "value", "seq")

    def batch_get(self, keys: DataFrame) -> DataFrame:
        return lww.batch_get(self.log(), keys)

    def scan(self, low: str, high: str) -> DataFrame:
        inside = lambda s: s["min_key"].encode() <= high.encode() and low.encode() <= s["max_key"].encode()
        return lww.scan(self.log(keep=inside), low, high).select("key", "value", "seq")

    # Maintenance.

    def _write_segments(self, rows: DataFrame, m: Manifest, level: int) -> Manifest:
        """Write a sorted segment and publish ``m`` with it."""
        segment = m.next_segment
        path = f"{self.path}/segments/{segment:020d}-{uuid.uuid4().hex[:8]}"
        parts = [self.partitions] if self.partitions else []
        rows.select("seq", "key", "op", "value").repartitionByRange(*parts, "key").sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)
        made = self.spark.read.schema(LOG).parquet(path)
        f = made.agg(F.min("key").alias("a"), F.max("key").alias("b"), F.min("seq").alias("c"), F.max("seq").alias("d"), F.count("*").alias("n"), F.sum((F.col("op") == DELETE).cast("long")).alias("t"), F.sum(layers.entry_bytes()).alias("s")).first()
        if f["n"]:
            bits = None
            if f["n"] <= self.bloom_keys:  # a larger segment relies on its files' own filters
                bits = packed(bloom.build_words(made.select(F.lit(segment).cast("long").alias("segment"), "key")).select("word", "mask").collect(), 10 * f["n"])
            num_bits = max(64, 10 * f["n"])
            m.segments.append(asdict(Segment(segment, level, path, f["a"], f["b"], f["c"], f["d"], f["n"], f["t"], f["s"], num_bits, 6, bits)))
            m.next_segment += 1
            m.next_seq = max(m.next_seq, f["d"] + 1)
        self._publish(m)
        return m

    def flush(self) -> None:
        """The log's tail becomes a level-0 segment; the log is let go only with the version that has the segment."""
        if not self.manifest.logs:
            return
        m = self._copy()
        rows = lww.resolve(self._tail(m))
        m.flushed_seq = max(x[2] for x in m.logs)
        m.logs = []
        self._write_segments(rows, m, 0)
        if sum(s["level"] == 0 for s in self.manifest.segments) >= self.l0_tables:
            self.compact()

    def compact(self, compat: str | None = None) -> None:
        """All segments of levels 0 and 1 become one sorted level-1 segment without tombstones."""
        m = self._copy()
        if not m.segments:
            return
        parts = [self.spark.read.schema(LOG).parquet(s["path"]).withColumn("segment", F.lit(s["segment_id"]).cast("long")) for s in m.segments]
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        m.segments = []
        self._write_segments(layers.compact(union, compat), m, 1)

    def vacuum(self, keep_versions: int = 2) -> int:
        """Delete manifests before the last ``keep_versions`` and the tables that only they name."""
        versions = self._versions()
        kept = [self.read_manifest(v) for v in versions[-keep_versions:]]
        live = {s["path"] for m in kept for s in m.segments} | {x[0] for m in kept for x in m.logs}
        gone = 0
        for folder in ("log", "segments"):
            p = self._path(f"{self.path}/{folder}")
            for s in self.fs.listStatus(p) if self.fs.exists(p) else []:
                if not any(os.path.basename(x) == s.getPath().getName() for x in live):
                    self.fs.delete(s.getPath(), True)
                    gone += 1
        for v in versions[:-keep_versions]:
            self.fs.delete(self._path(f"{self.path}/_manifest/v{v:020d}.json"), False)
        return gone

    def manifest_df(self) -> DataFrame:
        rows = [tuple(s[k] for k in ("segment_id", "level", "path", "min_key", "max_key", "min_seq", "max_seq", "n_entries", "n_tombstones", "bytes", "num_bits", "num_hash")) for s in self.manifest.segments]
        return self.spark.createDataFrame(rows, "segment_id long, level int, path string, min_key string, max_key string, min_seq long, max_seq long, n_entries long, n_tombstones long, bytes long, num_bits long, num_hash int")

    def status(self) -> dict:
        m = self.manifest
        return {
            "version": m.version, "last_seq": m.next_seq - 1, "flushed_seq": m.flushed_seq, "memtable_batches": len(m.logs), "memtable_bytes": sum(x[3] for x in m.logs),
            "memtable_entries": sum(x[2] - x[1] + 1 for x in m.logs), "segments": len(m.segments), "l0_segments": sum(s["level"] == 0 for s in m.segments), "l1_segments": sum(s["level"] == 1 for s in m.segments), "segment_entries": sum(s["n_entries"] for s in m.segments), "tombstones": sum(s["n_tombstones"] for s in m.segments),
        }

    def close(self) -> None:
        self.flush()


def packed(words: list, bits: int) -> str:
    """Words of a filter (word, mask) as base64; a manifest's filters have a bounded number of keys."""
    out = bytearray(8 * (max(64, bits) // 64 + 1))
    for word, mask in words:
        out[8 * word : 8 * word + 8] = (mask & (1 << 64) - 1).to_bytes(8, "little")
    return base64.b64encode(out).decode()


def python_positions(key: bytes, num_bits: int, num_hash: int) -> list[int]:
    """The same bits as ``bloom.positions``, for one key on the driver."""
    h = bloom.START_HIGH << 32 | bloom.START_LOW
    for b in key:
        h = (h ^ b) * ((1 << 40) + bloom.PRIME_LOW) & (1 << 64) - 1
    low, odd = h & bloom.MASK, (h >> 32) | 1
    return [((low + i * odd) & bloom.MASK) % num_bits for i in range(num_hash)]
