"""Sharding by an external shuffle in two passes.

First pass: a seeded hash of a record's content scatters the records uniformly
over buckets that fit in memory. Second pass: each bucket is put in order by that
hash, its rows are moved by a Fisher-Yates shuffle of their places, and the
buckets follow each other. A global slot is a place in that sequence; the shards
are equal ranges of it, so their row counts differ by one at most. Every draw of
the shuffle is a hash of seed, bucket and step, so seed and data decide the
order, whatever the files and partitions are.

The shuffle moves each record once. Of a row that has very many copies, the copies
are numbered and scattered by their number; ``place`` (anything that differs
between them) spreads that work and decides nothing, and without it they stay together. Of a bucket only
the permutation of its row numbers is held in one row. Everything is DataFrame
functions.

Defined results: a null text has size 1 and the checksum of the empty text;
null ids and repeated rows are placed like others; an empty table gives no
rows; shards may be empty if there are fewer rows than shards; the columns of
the input are kept before those added here (shard, slot),
whose names must be free (``ValueError`` else).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.ranks import COPIES, apart, content_hash, in_buckets
from tidemark.runtime import Scratch, shared_path

BUCKET_BYTES, BUCKET_ROWS = 4 << 20, 2048


def sized(text: Column) -> Column:
    """Bytes of a text in UTF-8 plus one."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def fisher_yates(n: Column, seed: int, bucket: Column) -> Column:
    """The numbers 0 to n-1 after swaps of each place from the last to the second with one not after it, drawn by hash.

    They are packed, four bytes each, since a swap of bytes is a copy of memory; ``drawn`` reads one.
    """
    last = F.when(n > 1, F.sequence(n.cast("int") - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    swaps = F.transform(last, lambda i: F.struct((4 * i).alias("i"), (4 * F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1).cast("int")).alias("j")))
    begin = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.lpad(F.hex(i), 8, "0")), ""))

    def swap(a: Column, s: Column) -> Column:
        i, j = s["i"], s["j"]
        part = lambda first, length: F.substring(a, first + 1, length)
        moved = F.concat(part(F.lit(0), j), part(i, F.lit(4)), part(j + 4, i - j - 4), part(j, F.lit(4)), part(i + 4, F.octet_length(a)))
        return F.when(i == j, a).otherwise(moved)

    return F.aggregate(swaps, begin, swap)


def drawn(packed: Column, place: Column) -> Column:
    """The number at a place, from 0."""
    return F.conv(F.hex(F.substring(packed, 4 * place + 1, F.lit(4))), 16, 10).cast("long")


def two_pass_shuffle(df: DataFrame, shards: int = 8, seed: int = 17, text_col: str = "text", place: Column | None = None, keep: list[str] | None = None, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, copies: int = COPIES) -> DataFrame:
    """The columns ``keep`` of ``df`` (all, if none are named) with ``shard`` (0 to shards-1) and ``slot`` (0, 1, ... inside each shard)."""
    names = df.columns if keep is None else keep
    if {"shard", "slot"} & {c.lower() for c in names}:
        raise ValueError("the columns shard and slot are added here")
    size = df.select(sized(df[text_col].cast("string")).alias("b")).agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    n, buckets = size["n"], max(1, -(-size["b"] // bucket_bytes), -(-size["n"] // bucket_rows))
    h = content_hash([df[c] for c in names], seed)
    hashed = df.select(F.struct(*(df[c] for c in names)).alias("_row"), h.alias("_h"), *([place.alias("_place")] if place is not None else []))
    if place is not None:
        hashed = apart(hashed, n, "_place", copies).drop("_place")
    ordered, counts = in_buckets(hashed, buckets, seed)
    moved = counts.select("bucket", "before", fisher_yates(F.col("n"), seed, F.col("bucket")).alias("moved"))
    at = ordered.join(moved, "bucket").select("_row", (F.col("before") + drawn(F.col("moved"), F.col("_r") - 1)).alias("_at"))
    small, more = divmod(n, shards)
    edge = more * (small + 1)  # rows in the first shards, which have one more
    shard = F.when(F.col("_at") < edge, F.expr(f"_at div {small + 1}")).otherwise(F.lit(more) + F.expr(f"(_at - {edge}) div {max(small, 1)}"))
    slot = F.when(F.col("_at") < edge, F.expr(f"_at % {small + 1}")).otherwise(F.expr(f"(_at - {edge}) % {max(small, 1)}"))
    return at.select("_row.*", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write(shuffled: DataFrame, path: str, shards: int = 8, files: int = 16) -> None:
    """The records in slot order, in a folder for each shard and about ``files`` files in each."""
    spread = shuffled.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot")
    spread.write.partitionBy("shard").parquet(path)


def write_buckets(shuffled: DataFrame, path: str) -> DataFrame:
    """The records in a folder for each shard, without another shuffle: a file has its task's buckets in slot order. What was written is returned."""
    shuffled.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return shuffled.sparkSession.read.schema(shuffled.schema).parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    with Scratch(spark):
        out = write_buckets(two_pass_shuffle(table(spark, sf_dir, "documents"), 8, place=place, keep=["doc_id", "text"]), shared_path(spark, "shards"))
    return out.select(
        "doc_id", sized(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
