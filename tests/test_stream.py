from pyspark.sql import functions as F

from tidemark.operators import lww
from tidemark.operators.store import Store
from tidemark.sources.changelog import events_log
from tidemark.streaming import apply


def test_changes_end_in_the_batch_state(spark, sf, tmp_path):
    events_log(spark, sf).repartition(3).write.parquet(str(tmp_path / "log"))
    out: dict = {}

    def batch(rows, epoch):
        for r in rows.collect():
            assert r["key"] not in out or out[r["key"]][0] < r["seq"]
            out[r["key"]] = (r["seq"], r["op"], r["value"])

    stream = apply.changes(apply.events_stream(spark, str(tmp_path / "log")))
    stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want = {r["key"]: (r["seq"], r["op"], r["value"]) for r in lww.resolve(events_log(spark, sf)).collect()}
    assert out == want


def test_stream_into_a_store(spark, sf, tmp_path):
    events_log(spark, sf).repartition(3).write.parquet(str(tmp_path / "log"))
    store = Store(spark, str(tmp_path / "store"))
    apply.apply_to(apply.events_stream(spark, str(tmp_path / "log")), store, str(tmp_path / "cp")).awaitTermination()
    got = {(r["key"], r["seq"]) for r in store.snapshot().collect()}
    assert got == {(r["key"], r["seq"]) for r in lww.snapshot(events_log(spark, sf)).collect()}
    assert store.snapshot().where(F.col("value").isNull()).count() == 0
