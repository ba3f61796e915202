"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000


#: Bytes of a table for each core, up to which its rows are dealt anew if it has fewer files than there are cores.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores if it is a small table in few files: a row group is one task, however many cores wait.

    Larger tables are read as they lie, so what is moved here is at most ``SPREAD_BYTES`` a core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES * cores and len(df.inputFiles()) < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` and ``text``, whatever else ``df`` has; a null text stays null."""
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))


def residue(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def bounded(small: DataFrame) -> DataFrame:
    """A hint to broadcast, if the rows are few. ``small`` should be a table, since its rows are counted here."""
    return F.broadcast(small) if small.count() <= MAX_BROADCAST else small
