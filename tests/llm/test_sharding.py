import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding


def check(rows, shards):
    slots: dict = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(i, ())) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))


def test_query(spark, sf, documents):
    rows = sharding.op2_sharding(spark, sf).collect()
    check(rows, 8)
    want = {r["doc_id"]: r["text"].encode() for r in documents.collect()}
    assert len(rows) == len(want)
    for r in rows:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(want[r["doc_id"]]) + 1, zlib.crc32(want[r["doc_id"]]), "rows", None)


def test_odd_rows_and_other_columns(odd, none):
    out = sharding.two_pass_shuffle(odd, 4, bucket_rows=2)
    rows = out.collect()
    check(rows, 4)
    assert out.columns == [*odd.columns, "shard", "slot"] and Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.collect())
    assert sharding.two_pass_shuffle(none, 4).count() == 0
    with pytest.raises(ValueError):
        sharding.two_pass_shuffle(odd.withColumn("slot", F.lit(1)))


def test_many_equal_rows_are_spread_by_place(spark):
    df = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.col("id").alias("place"))
    rows = sharding.two_pass_shuffle(df, 8, place=F.col("place"), bucket_rows=100).collect()
    check(rows, 8)


def test_it_is_a_shuffle_that_the_seed_decides(documents):
    order = lambda seed: [r["doc_id"] for r in sharding.two_pass_shuffle(documents, 1, seed, bucket_rows=50).orderBy("slot").collect()]
    a = order(1)
    assert a == order(1) and a != order(2) and a != sorted(a)


def test_no_python(spark, sf):
    text = sharding.op2_sharding(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in text for x in ("Python", "Arrow", "Pandas"))


def test_written_shards(spark, documents, tmp_path):
    shuffled = sharding.two_pass_shuffle(documents, 3)
    sharding.write(shuffled, str(tmp_path / "out"), 3, 2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == documents.count() and {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2}


def all_ways(spark, df, f):
    """What ``f`` gives for ``df`` in 1, 3 and 7 partitions, 4 and 7 shuffle partitions, with and without adaptive execution."""
    names = "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"
    before = [spark.conf.get(n) for n in names]
    try:
        for n, p, adaptive in ((1, "4", "true"), (3, "7", "false"), (7, "4", "false"), (3, "4", "true")):
            spark.conf.set(names[0], p), spark.conf.set(names[1], adaptive)
            yield f(df.repartition(n))
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def test_partitions_do_not_decide_the_order(spark, documents):
    some = documents.select("doc_id", "text").unionByName(spark.range(500).select(F.lit(9).cast("long").alias("doc_id"), F.lit("many copies").alias("text")))
    order = lambda df: [r["doc_id"] for r in sharding.two_pass_shuffle(df, 3, place=F.monotonically_increasing_id(), bucket_rows=50, copies=20).orderBy("shard", "slot").collect()]
    first, *others = all_ways(spark, some, order)
    assert len(first) == documents.count() + 500 and all(o == first for o in others)
    copies = [i for i, d in enumerate(first) if d == 9]
    assert max(copies) - min(copies) > 500 and len({i * 10 // len(first) for i in copies}) == 10


def test_the_query_does_not_depend_on_partitions(spark, sf, documents, tmp_path):
    def rows(df):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        df.write.parquet(f"{path}/documents.parquet")
        return sorted(map(tuple, sharding.op2_sharding(spark, path).drop("grown_shard").collect()))

    first, *others = all_ways(spark, documents, rows)
    assert all(o == first for o in others) and len(first) == documents.count()


def test_the_permutation_equals_a_fisher_yates_in_python(spark):
    r = spark.range(6).select("id", F.expr("cast(id * 7 + 1 as long)").alias("n")).select("id", "n", sharding.fisher_yates(F.col("n"), 5, F.col("id")).alias("p"))
    draws = {(x["id"], x["i"]): x["j"] for x in spark.range(6).select("id", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("i")).select("id", "i", F.pmod(F.xxhash64(F.lit(5), "id", "i"), F.col("i") + 1).alias("j")).collect()}
    for row in r.collect():
        want = list(range(row["n"]))
        for i in range(row["n"] - 1, 0, -1):
            j = draws[row["id"], i]
            want[i], want[j] = want[j], want[i]
        assert [int.from_bytes(row["p"][4 * k : 4 * k + 4], "big") for k in range(row["n"])] == want


def test_all_orders_are_as_likely(spark):
    r = spark.range(6000).select(F.hex(sharding.fisher_yates(F.lit(3).cast("long"), 1, F.col("id"))).alias("p")).groupBy("p").count().collect()
    assert len(r) == 6 and all(850 < x["count"] < 1150 for x in r)
