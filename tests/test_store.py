import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import layers, lww
from tidemark.operators.store import Store


def live(store, version=None):
    return {r["key"]: bytes(r["value"]) for r in store.snapshot(version).collect()}


def test_tri_state_and_blind_delete(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.put("a", "1")
    s.delete("never")
    s.put("empty", "")
    assert s.get("a") == (b"1", True) and s.get("never") == (None, True) and s.get("absent") == (None, False) and s.get("empty") == (b"", True)
    s.put("a", "", compat="empty_is_delete")
    s.flush()
    assert s.get("a") == (None, True)


def test_empty_keys_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path)).put("", "x")


def test_model_of_random_operations(spark, tmp_path):
    rng, model = random.Random(11), {}
    s = Store(spark, str(tmp_path), l0_tables=3)
    for _ in range(14):
        what = rng.choice(["write", "write", "write", "flush", "compact", "reopen"])
        if what == "write":
            batch = []
            for _ in range(rng.randint(1, 12)):
                key = rng.choice(["a", "b/c", "é", "😀", "Z", "key with space"])
                if rng.random() < 0.35:
                    batch.append((2, key, None))
                    model.pop(key, None)
                else:
                    value = rng.randbytes(rng.randint(0, 5))
                    batch.append((1, key, value))
                    model[key] = value
            s.write(batch)
        elif what == "flush":
            s.flush()
        elif what == "compact":
            s.compact()
        else:
            s = Store(spark, str(tmp_path), l0_tables=3)
        assert live(s) == model
    s.close()
    s.compact()
    assert live(s) == model and s.status()["tombstones"] == 0 and s.status()["l0_segments"] == 0


def test_flush_and_compaction_triggers(spark, tmp_path):
    s = Store(spark, str(tmp_path), memtable_bytes=10, l0_tables=2)
    s.put("a", "123456789")
    assert s.status()["l0_segments"] == 1 and s.status()["memtable_batches"] == 0
    s.put("b", "123456789")
    assert s.status()["l0_segments"] == 0 and s.status()["l1_segments"] == 1


def test_readers_keep_their_version_and_vacuum_keeps_recent_ones(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.put("a", "1")
    s.flush()
    v = s.status()["version"]
    s.put("a", "2")
    s.flush()
    s.compact()
    assert live(s, v) == {"a": b"1"} and live(s) == {"a": b"2"}
    assert s.vacuum(1) > 0 and live(s) == {"a": b"2"}


def test_a_second_writer_is_refused(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    a.put("x", "1")
    with pytest.raises(RuntimeError):
        b.put("x", "2")


def test_scan_and_batch_get_prune_segments(spark, tmp_path):
    s = Store(spark, str(tmp_path), l0_tables=9)
    for k in "abcdef":
        s.put(k, k.upper())
        s.flush()
    assert [r["key"] for r in s.scan("b", "d").orderBy("key").collect()] == ["b", "c", "d"]
    assert len(s.log(keep=lambda x: s._may_hold(x, "c")).inputFiles()) < 6
    got = {r["key"]: r["state"] for r in s.batch_get(spark.createDataFrame([("a",), ("zz",)], "key string")).collect()}
    assert got == {"a": "hit", "zz": "absent"}


def test_compaction_keeps_the_newest_and_compat_the_oldest(spark):
    rows = [(1, "a", 1, "old", 0), (2, "a", 2, None, 1), (3, "b", 2, None, 0), (4, "b", 1, "new", 1)]
    entries = spark.createDataFrame(rows, "seq long, key string, op int, value string, segment long")
    assert [(r["key"], r["value"]) for r in layers.compact(entries).collect()] == [("b", "new")]
    assert [(r["key"], r["value"]) for r in layers.compact(entries, "oldest_l0").collect()] == [("a", "old")]
    assert layers.compact(entries, full=False).count() == 2


def test_replay_twice_changes_nothing(spark, sf):
    from tidemark.sources.changelog import events_log

    c = events_log(spark, sf)
    assert lww.difference(lww.snapshot(c.unionByName(c)), lww.snapshot(c)).first()[0] == 0


def test_byte_order_of_keys(spark):
    keys = ["Z", "a", "z", "é", "￮", "😀"]
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "key string")
    assert [r[0] for r in df.orderBy("key").collect()] == keys


def test_ingest_is_idempotent(spark, tmp_path, sf):
    from tidemark.sources.changelog import events_log

    s = Store(spark, str(tmp_path))
    s.ingest(events_log(spark, sf))
    first = live(s)
    s.ingest(events_log(spark, sf))
    assert live(s) == first and s.manifest_df().count() == 2
    assert s.get("42")[1] == (events_log(spark, sf).where(F.col("key") == "42").count() > 0)
