import random

from pyspark.sql import functions as F

from tidemark.functions import bloom
from tidemark.operators.store import python_positions


def test_golden_hashes_and_positions(spark):
    df = spark.createDataFrame([("hello",), ("world",), ("missing",)], "key string")
    h, low = bloom.fnv1a(F.col("key"))
    got = {r["key"]: (int(r["h"]) << 32 | int(r["l"]), list(r["p"])) for r in df.select("key", h.alias("h"), low.alias("l"), bloom.positions(F.col("key"), F.lit(300), F.lit(2)).alias("p")).collect()}
    assert got["hello"] == (11831194018420276491, [63, 186])
    assert got["world"] == (5717881983045765875, [43, 186])
    assert got["missing"] == (9968340405350681031, [179, 96])


def test_small_filter_finds_what_was_added(spark):
    built = bloom.build(spark.createDataFrame([(1, "hello"), (1, "world")], "segment long, key string"), 150)
    probes = spark.createDataFrame([(1, "hello"), (1, "world"), (1, "missing")], "segment long, key string")
    assert {r["key"]: r["maybe"] for r in bloom.probe(built, probes).collect()} == {"hello": True, "world": True, "missing": False}


def test_sizing(spark):
    row = spark.range(1).select(*(bloom.num_hashes(b).alias(f"k{b}") for b in (3, 5, 10, 15, 0, 100)), bloom.num_bits(F.lit(3)).alias("small"), bloom.num_bits(F.lit(101)).alias("m"), bloom.false_positive_rate(F.lit(1000), F.lit(10000), F.lit(6)).alias("p")).first()
    assert (row["k3"], row["k5"], row["k10"], row["k15"], row["k0"], row["k100"]) == (2, 3, 6, 10, 6, 30)
    assert (row["small"], row["m"]) == (64, 1010) and abs(row["p"] - 0.008436) < 1e-6


def test_no_false_negatives_for_any_bytes(spark):
    rng = random.Random(5)
    keys = sorted({"".join(rng.choice("aZ9/é中😀 ") for _ in range(rng.randint(1, 9))) for _ in range(101)})
    entries = spark.createDataFrame([(1, k) for k in keys], "segment long, key string")
    built = bloom.build(entries)
    assert bloom.probe(built, entries).where("not maybe").count() == 0
    row = built.first()
    bits = set(row["bits"])
    assert all(set(python_positions(k.encode(), row["num_bits"], row["num_hash"])) <= bits for k in keys)


def test_false_positive_rate_is_near_the_formula(spark):
    entries = spark.range(2000).select(F.lit(1).cast("long").alias("segment"), F.format_string("key-%08d", F.col("id")).alias("key"))
    probes = spark.range(10_000, 14_000).select(F.lit(1).cast("long").alias("segment"), F.format_string("key-%08d", F.col("id")).alias("key"))
    assert bloom.probe(bloom.build(entries), probes).where("maybe").count() < 4000 * 0.03


def test_words_are_those_of_the_positions(spark):
    entries = spark.range(3000).select((F.col("id") % 3).alias("segment"), F.format_string("key-%d", F.col("id")).alias("key"))
    words = bloom.build_words(entries)
    got = {(r["segment"], p) for r in words.select("segment", bloom.set_places(F.col("word"), F.col("mask")).alias("at")).collect() for p in r["at"]}
    want = {(i % 3, p) for i in range(3000) for p in python_positions(f"key-{i}".encode(), 10_000, 6)}
    assert got == want
    probes = spark.range(2000, 5000).select((F.col("id") % 3).alias("segment"), F.format_string("key-%d", F.col("id")).alias("key"))
    answers = {r["key"]: r["maybe"] for r in bloom.probe_words(words, probes).collect()}
    for i in range(2000, 5000):
        assert answers[f"key-{i}"] == all((i % 3, p) in want for p in python_positions(f"key-{i}".encode(), 10_000, 6))


def test_all_keys_against_all_filters(spark, monkeypatch):
    """Blocks, groups, filters of one row and larger ones by words; a null segment has no filter, a null key is hashed as no bytes."""
    rows = [(s, f"key-{i}") for s in range(40) for i in range(s, 7 * s + 3, 2)] + [(5, None), (None, "key-1")]
    keys = [f"key-{i}" for i in range(300)] + ["key-7", "é", "", None]
    monkeypatch.setattr(bloom, "BLOCK_KEYS", 64)
    monkeypatch.setattr(bloom, "GROUP_BITS", 1000)
    filters: dict = {s: set(keys) for s, keys in ((s, [k for t, k in rows if t == s]) for s in {r[0] for r in rows})}
    bits = {s: max(64, 10 * len(held)) for s, held in filters.items()}
    at = lambda k, s: set(python_positions((k or "").encode(), bits[s], 6))
    ones = {s: set().union(*(at(k, s) for k in held)) if s is not None else set() for s, held in filters.items()}
    want = {(s, k): at(k, s) <= ones[s] for s in filters for k in set(keys)}
    entries, asked = spark.createDataFrame(rows, "segment long, key string"), spark.createDataFrame([(k,) for k in keys], "key string")
    for most in (bloom.PACKED_BITS, 600):
        monkeypatch.setattr(bloom, "PACKED_BITS", most)
        got = bloom.probe_all(entries, asked).collect()
        assert len(got) == len(want) and {(r["segment"], r["key"]): r["maybe"] for r in got} == want
    assert bloom.probe_all(entries.where("false"), asked).count() == bloom.probe_all(entries, asked.where("false")).count() == 0
