import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.schema import DELETE, PUT
from tidemark.sources import wal

GOLDEN = [
    (PUT, b"k1", b"v1", "11000000d26c3fd801020000006b31020000007631"),
    (PUT, b"k2", b"v2", "11000000f527de7001020000006b32020000007632"),
    (DELETE, b"k1", None, "0f000000bfb66cc902020000006b3100000000"),
]


def frames(data):
    return [x[:3] for x in wal.decode(data)]


@pytest.mark.parametrize("op,key,value,hexed", GOLDEN)
def test_golden_frames(op, key, value, hexed):
    assert wal.encode(op, key, value).hex() == hexed


def test_write_and_replay_in_order():
    assert frames(b"".join(wal.encode(*g[:3]) for g in GOLDEN)) == [g[:3] for g in GOLDEN]


def test_every_cut_gives_a_prefix():
    data = b"".join(wal.encode(*g[:3]) for g in GOLDEN)
    for cut in range(len(data) + 1):
        got = frames(data[:cut])
        assert got == [g[:3] for g in GOLDEN][: len(got)]
        assert len(got) == sum(cut >= e for e in (21, 42, 61))


@pytest.mark.parametrize("tail", [b"\x11\0\0\0", b"\0" * 16, b"\3\0\0\0abcdefgh", struct.pack("<I", (64 << 20) + 1) + b"x" * 20, b"\xff" * 12])
def test_bad_tails_end_the_prefix(tail):
    assert frames(wal.encode(PUT, b"a", b"1") + tail + wal.encode(PUT, b"b", b"2")) == [(PUT, b"a", b"1")]


def test_flipped_byte_ends_the_prefix():
    a, b = wal.encode(PUT, b"a", b"1"), bytearray(wal.encode(PUT, b"b", b"2"))
    b[-1] ^= 1
    assert frames(a + bytes(b) + a) == [(PUT, b"a", b"1")]


def test_checked_frame_with_wrong_inner_lengths_ends_the_prefix():
    payload = struct.pack("<BI", PUT, 100) + b"abcd"
    bad = struct.pack("<II", len(payload) + 4, zlib.crc32(payload)) + payload
    assert frames(bad) == []


def test_cap_on_write():
    with pytest.raises(ValueError):
        wal.encode(PUT, b"a", b"x" * (64 << 20))


def test_empty_value_stays_a_put():
    assert frames(wal.encode(PUT, b"a", b"")) == [(PUT, b"a", b"")]


def test_frame_column_equals_the_codec(spark):
    rng = random.Random(3)
    rows = [(rng.choice([PUT, DELETE]), "".join(rng.choice("aé/ 😀b") for _ in range(rng.randint(1, 6))), rng.choice(["", "x", "é" * 200, None])) for _ in range(40)]
    df = spark.createDataFrame(rows, "op int, key string, value string")
    got = df.select("op", "key", "value", wal.frame(F.col("op"), F.col("key"), F.col("value")).alias("f")).collect()
    for r in got:
        assert bytes(r["f"]) == wal.encode(r["op"], r["key"].encode(), (r["value"] or "").encode())


def test_replay_of_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"".join(wal.encode(*g[:3]) for g in GOLDEN) + b"torn")
    (tmp_path / "b.log").write_bytes(b"")
    (tmp_path / "c.log").write_bytes(wal.encode(9, b"odd", b"") + wal.encode(PUT, b"z", b"1"))
    got = {(r["path"][-5:], r["frame_no"], r["op"], r["key"]) for r in wal.read_logs(spark, str(tmp_path)).collect()}
    assert got == {("a.log", 0, 1, "k1"), ("a.log", 1, 1, "k2"), ("a.log", 2, 2, "k1"), ("c.log", 1, 1, "z")}
