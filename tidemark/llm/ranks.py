"""Places of rows in an order that only their content decides.

A row is known by a 64-bit hash of its content. Hashes fall into buckets of about
equal size, buckets follow each other by number, and rows lie in a bucket by
hash. So neither the files nor the partitions of an input, nor those of a shuffle,
nor a task that runs twice, decide where a row comes to lie. Equal rows have equal
hashes and may take each other's place, which nobody can tell.

Copies of one row would meet in one bucket. Where there are more than ``COPIES``
of them, they are numbered (by salted groups, whichever copy is first), and each
is placed by the hash of its number. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import materialise

#: Copies of a row that stay together at least.
COPIES = 1024
#: Hashes with more copies than that, at most: the number of copies that stay together grows beyond it.
MAX_HEAVY = 500_000
#: Buckets whose counts are summed together, in the prefix sum over buckets.
GROUP = 4096


def content_hash(columns: list[Column], seed: int) -> Column:
    """A hash of all columns that tells nulls from values beside them."""
    return F.xxhash64(F.lit(seed), *columns, *(F.isnull(c) for c in columns))


def prefix(counts: DataFrame, *within: str, bucket: str = "bucket") -> DataFrame:
    """``counts`` (bucket, n and ``within``) with ``before``: the rows in earlier buckets. Two levels, so that no task sums all buckets."""
    grouped = counts.withColumn("_g", F.expr(f"`{bucket}` div {GROUP}"))
    totals = grouped.groupBy(*within, "_g").agg(F.sum("n").alias("_t"))
    shifts = totals.select(*within, "_g", (F.sum("_t").over(W.partitionBy(*within).orderBy("_g")) - F.col("_t")).alias("_s"))
    inside = F.sum("n").over(W.partitionBy(*within, "_g").orderBy(bucket)) - F.col("n")
    return grouped.withColumn("_i", inside).join(shifts, [*within, "_g"]).select(*within, bucket, "n", (F.col("_i") + F.col("_s")).alias("before"))


def apart(rows: DataFrame, n: int, place: str, copies: int = COPIES) -> DataFrame:
    """``rows`` with ``_h`` made another one for each copy of a row that has very many. ``place`` spreads the copies; it is in no result."""
    most = max(copies, n // MAX_HEAVY)
    heavy = materialise(rows.groupBy("_h").agg(F.count("*").alias("_n")).where(F.col("_n") > most), "copies")
    if not heavy.head(1):
        return rows
    tagged = rows.join(F.broadcast(heavy), "_h", "left")  # at most MAX_HEAVY rows, since each stands for more than n / MAX_HEAVY
    some = tagged.where("_n is not null").withColumn("_salt", F.pmod(F.xxhash64(place), F.ceil(F.col("_n") / most)))
    counts = some.groupBy("_h", "_salt").agg(F.count("*").alias("n"))
    shifts = prefix(counts, "_h", bucket="_salt").select("_h", "_salt", "before")  # again at most about MAX_HEAVY rows
    number = F.row_number().over(W.partitionBy("_h", "_salt").orderBy(place)) + F.col("before")
    numbered = some.join(F.broadcast(shifts), ["_h", "_salt"]).withColumn("_h", F.xxhash64("_h", number))
    return tagged.where("_n is null").select(*rows.columns).unionByName(numbered.select(*rows.columns))


def in_buckets(rows: DataFrame, buckets: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with ``bucket`` and ``_r``, the place in it from 1; bucket, n and before)."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("_h", F.lit(seed)), F.lit(buckets)))
    counts = prefix(dealt.groupBy("bucket").agg(F.count("*").alias("n")))
    return dealt.withColumn("_r", F.row_number().over(W.partitionBy("bucket").orderBy("_h"))), counts
