"""Logs of put and delete mutations: columns seq, key, op (1 put, 2 delete), value, segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import DELETE, PUT


def number_keys(column: Column, low: str, high: str) -> Column | None:
    """Which numbers have a text from ``low`` to ``high`` in byte order: one range for each count of digits, which scans can skip by.

    Nothing is told (None) of bounds that are not digits.
    """
    if not (low.isascii() and low.isdigit() and high.isascii() and high.isdigit()):
        return None
    out = F.lit(False)
    for n in range(1, 19):
        first = int(low.ljust(n, "0")) if len(low) <= n else int(low[:n]) + 1
        last = int(high[:n]) if len(high) >= n else int(high.ljust(n, "0")) - 1
        first, last = max(first, 10 ** (n - 1) if n > 1 else 0), min(last, 10**n - 1)
        if first <= last:
            out = out | (column == first if first == last else column.between(first, last))
    return out


def events_log(spark: SparkSession, sf_dir: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """One mutation for each event, by user; an error deletes. With bounds, only keys from ``low`` to ``high``; the condition reaches the scan."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_type") == "error", DELETE).otherwise(PUT)
    if low is not None and high is not None:
        key, numbers = F.col("user_id").cast("string"), number_keys(F.col("user_id"), low, high)
        e = e.where(key.between(low, high) if numbers is None else numbers)
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), op.alias("op"), F.when(op == PUT, F.col("props")).alias("value"), F.expr("event_id div 1000").alias("segment"))


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mutation for each order, by customer; a finished order deletes."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    op = F.when(F.col("o_orderstatus") == "F", DELETE).otherwise(PUT)
    return o.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("key"), op.alias("op"), F.when(op == PUT, F.col("o_orderpriority")).alias("value"), F.expr("o_orderkey div 4096").alias("segment"))


def lineitem_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mutation for each line, by order; a returned line deletes. seq orders the lines of one order."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    op = F.when(F.col("l_returnflag") == "R", DELETE).otherwise(PUT)
    seq = (F.col("l_linenumber").cast("long") * 10_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")
    return line.select(seq.alias("seq"), F.col("l_orderkey").alias("key"), op.alias("op"), F.when(op == PUT, F.col("l_partkey")).alias("value"), F.expr("l_orderkey div 65536").alias("segment"))
