"""Last-writer-wins resolution of mutation logs under one explicit order, ``seq``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import PUT


def resolve(log: DataFrame, *within: str, order: str = "seq") -> DataFrame:
    """The newest mutation of each key (within other columns, if named), tombstones included.

    One shuffle on the key with map-side combining; replaying a log twice gives the same.
    Columns of fixed size are aggregated one by one, which needs no sort (all
    take the same row, seq being unique); others go together as one struct.
    """
    rest = [c for c in log.columns if c not in ("key", *within)]
    if all(isinstance(log.schema[c].dataType, T.NumericType | T.BooleanType | T.DateType | T.TimestampType | T.TimestampNTZType) and not isinstance(log.schema[c].dataType, T.DecimalType) for c in rest):
        return log.groupBy(*within, "key").agg(*(F.max_by(c, order).alias(c) for c in rest)).select(*within, "key", *rest)
    best = F.max_by(F.struct(*rest), F.col(order)).alias("m")
    return log.groupBy(*within, "key").agg(best).select(*within, "key", *(F.col(f"m.{c}").alias(c) for c in rest))


def snapshot(log: DataFrame) -> DataFrame:
    """The live keys."""
    return resolve(log).where(F.col("op") == PUT)


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The live keys after the mutations up to ``seq``."""
    return snapshot(log.where(F.col("seq") <= seq))


def history(log: DataFrame) -> DataFrame:
    """Every mutation with the seq that ends it (null: still in force)."""
    w = W.partitionBy("key").orderBy("seq")
    return log.withColumn("next_seq", F.lead("seq").over(w)).withColumn("version", F.row_number().over(w))


def state(rows: DataFrame) -> DataFrame:
    """Adds ``state``: hit, deleted or absent, by ``op`` (null: no mutation)."""
    return rows.withColumn("state", F.when(F.col("op").isNull(), "absent").when(F.col("op") == PUT, "hit").otherwise("deleted"))


def get(log: DataFrame, key: str) -> DataFrame:
    """The newest mutation of one key; the condition reaches the scan."""
    return resolve(log.where(F.col("key") == key))


def batch_get(log: DataFrame, keys: DataFrame, few: bool = False) -> DataFrame:
    """key, state, value for each row of ``keys``. With ``few`` the caller vouches that they fit a broadcast."""
    wanted = F.broadcast(keys.distinct()) if few else keys.distinct()
    found = resolve(log.join(wanted, "key", "left_semi")).select("key", "op", "value")
    return state(keys.join(found, "key", "left")).select("key", "state", F.when(F.col("state") == "hit", F.col("value")).alias("value"))


def scan(log: DataFrame, low: str, high: str) -> DataFrame:
    """Live keys from ``low`` to ``high``, both included, in byte order."""
    return snapshot(log.where(F.col("key").between(low, high)))


def missing(log: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.join(log.select("key"), "key", "left_anti")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows are in only one of two states."""
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("n_different"))
