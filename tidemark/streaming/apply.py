"""Applying a log as a stream. Order comes from ``seq``, so batches may come late, twice or out of order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.operators.lww import resolve

STATE = "key string, seq long, op int, value string"


def start_state(stream: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """All keys' newest mutations in the memory table ``name``, once the log so far is read."""
    return resolve(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Newest(StatefulProcessor):
    """Keeps seq, op and value of a key, and emits it when it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "seq long, op int, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        best = old
        for batch in rows:
            row = batch.loc[batch["seq"].idxmax()]
            if best is None or int(row["seq"]) > best[0]:
                best = (int(row["seq"]), int(row["op"]), None if pd.isna(row["value"]) else str(row["value"]))
        if best is not None and best != old:
            self.state.update(best)
            yield pd.DataFrame({"key": [key[0]], "seq": [best[0]], "op": [best[1]], "value": [best[2]]})

    def close(self) -> None:
        pass


def changes(stream: DataFrame) -> DataFrame:
    """The changes of state, key by key, for update mode. Needs the RocksDB state store."""
    return stream.select("key", "seq", "op", "value").groupBy("key").transformWithStateInPandas(Newest(), STATE, "update", "none")


def apply_to(stream: DataFrame, store, checkpoint: str) -> StreamingQuery:
    """Each micro-batch, resolved, becomes one level-0 segment of a store. A batch that is replayed changes nothing."""

    def batch(rows: DataFrame, epoch: int) -> None:
        store.ingest(rows)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files of the mutation columns."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
