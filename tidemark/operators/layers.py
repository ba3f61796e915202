"""Segments in levels: reads in order of precedence, compaction, and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.lww import resolve
from tidemark.schema import DELETE, INDEX_EVERY, PUT


#: Blocks whose sums are summed together.
GROUP = 4096


def segments(log: DataFrame) -> DataFrame:
    """What a flush writes for each segment: its newest mutation of each key."""
    return resolve(log, "segment")


def read_order(entries: DataFrame) -> DataFrame:
    """The entry that a layered read stops at: lowest level first, newest segment first inside it."""
    w = W.partitionBy("key").orderBy("level", F.col("segment").desc())
    return entries.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def compact(entries: DataFrame, compat: str | None = None, full: bool = True) -> DataFrame:
    """Merge segments into one sorted run of distinct keys.

    The newest seq wins. ``compat='oldest_l0'`` keeps the entry of the oldest
    segment instead. Tombstones go only if the merge covers all lower data (``full``).
    """
    rest = [c for c in entries.columns if c != "key"]
    pick = F.min_by if compat == "oldest_l0" else F.max_by
    by = F.col("segment") if compat == "oldest_l0" else F.col("seq")
    out = entries.groupBy("key").agg(pick(F.struct(*rest), by).alias("m")).select("key", *(F.col(f"m.{c}").alias(c) for c in rest))
    return out.where(F.col("op") == PUT) if full else out


def entry_bytes(key: str = "key", value: str = "value"):
    return (F.octet_length(F.col(key).cast("string")) + F.coalesce(F.octet_length(F.col(value).cast("string")), F.lit(0))).cast("long")


def stats(entries: DataFrame) -> DataFrame:
    """segment, n_entries, n_tombstones, bytes, and one row of totals with segment -1."""
    each = entries.groupBy("segment").agg(F.count("*").alias("n_entries"), F.sum((F.col("op") == DELETE).cast("long")).alias("n_tombstones"), F.sum(entry_bytes()).alias("bytes"))
    total = each.agg(F.lit(-1).cast("long").alias("segment"), *(F.sum(c).alias(c) for c in ("n_entries", "n_tombstones", "bytes")))
    return each.unionByName(total)


def flush_boundaries(log: DataFrame, threshold: int, block: int = 1000) -> DataFrame:
    """flush, first_seq, last_seq, n_records, bytes: cuts of the running byte sum in seq order.

    Sums run inside blocks of seq and are shifted by the sums of earlier blocks,
    which are summed in the same way by groups of blocks, so no task sees the whole
    log or all of its blocks.
    """
    sized = log.withColumn("_b", entry_bytes()).withColumn("_block", F.expr(f"seq div {block}"))
    totals = sized.groupBy("_block").agg(F.sum("_b").alias("_t"))
    grouped = totals.withColumn("_group", F.expr(f"_block div {GROUP}"))
    groups = grouped.groupBy("_group").agg(F.sum("_t").alias("_gt"))
    before = groups.select("_group", (F.sum("_gt").over(W.orderBy("_group")) - F.col("_gt")).alias("_gs"))
    inside = F.sum("_t").over(W.partitionBy("_group").orderBy("_block")) - F.col("_t")
    shift = grouped.withColumn("_i", inside).join(before, "_group").select("_block", (F.col("_i") + F.col("_gs")).alias("_s"))
    run = F.sum("_b").over(W.partitionBy("_block").orderBy("seq"))
    placed = sized.withColumn("_run", run).join(shift, "_block").withColumn("flush", F.floor((F.col("_run") + F.col("_s") - F.col("_b")) / threshold))
    return placed.groupBy("flush").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n_records"), F.sum("_b").alias("bytes"))


def sparse_index(entries: DataFrame, every: int = INDEX_EVERY) -> DataFrame:
    """Every ``every``-th key of a segment, from the first, and its place."""
    w = W.partitionBy("segment").orderBy("key")
    placed = entries.select("segment", "key", (F.row_number().over(w) - 1).alias("place"))
    return placed.where(F.col("place") % every == 0)


def index_seek(index: DataFrame, probes: DataFrame) -> DataFrame:
    """probe, segment, and the last indexed key that is not after the probe (null: before the segment)."""
    asked = probes.select("segment", F.col("probe").alias("key"), F.lit(True).alias("_asks")).distinct()
    both = asked.unionByName(index.select("segment", "key", F.lit(False).alias("_asks")).distinct())
    # One pass over both in order of the key; an index entry comes before a probe of the same key.
    before = W.partitionBy("segment").orderBy("key", "_asks").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("first_key", F.last(F.when(~F.col("_asks"), F.col("key")), ignorenulls=True).over(before))
    return found.where("_asks").select("segment", F.col("key").alias("probe"), "first_key")


def space(log: DataFrame) -> DataFrame:
    """Live keys, tombstones and shadowed versions of a log, and versions per live key."""
    newest = resolve(log).agg(F.sum((F.col("op") == PUT).cast("long")).alias("live"), F.sum((F.col("op") == DELETE).cast("long")).alias("tombstones"), F.count("*").alias("_keys"))
    total = log.agg(F.count("*").alias("versions"))
    joined = newest.join(F.broadcast(total))  # one row each
    return joined.select("live", "tombstones", (F.col("versions") - F.col("_keys")).alias("shadowed"), "versions", F.round(F.col("versions") / F.col("live"), 6).alias("amplification"))


def exact_flushes(log: DataFrame, threshold: int) -> DataFrame:
    """store, flush, first_seq, last_seq, n_keys, bytes of memtables that are cut when their own bytes reach the threshold.

    Bytes follow overwrites and start anew after each cut, so a memtable is a
    sequential fold: one task for each ``store``, streaming its log in order.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        store, flush, first, last, size, held = None, 0, None, None, 0, {}

        def end() -> None:
            if held:
                rows.append((store, flush, first, last, len(held), size))

        for batch in batches:
            for s, seq, key, n in zip(*(c.to_pylist() for c in batch.columns)):
                if s != store:
                    end()
                    store, flush, first, size, held = s, 0, None, 0, {}
                first = seq if first is None else first
                size += n - held.get(key, 0)
                held[key], last = n, seq
                if size >= threshold:
                    end()
                    flush, first, size, held = flush + 1, None, 0, {}
        end()
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["store", "flush", "first_seq", "last_seq", "n_keys", "bytes"])

    ordered = log.select(F.col("store").cast("long"), F.col("seq").cast("long"), "key", entry_bytes().alias("b")).repartition("store").sortWithinPartitions("store", "seq")
    return ordered.mapInArrow(fold, "store long, flush long, first_seq long, last_seq long, n_keys long, bytes long")
