from pyspark.sql import functions as F

from tidemark.operators import lww
from tidemark.plans import registry
from tidemark.sources.changelog import lineitem_log, orders_log


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_point_get_reaches_the_scan(spark, sf):
    text = plan(lww.get(lineitem_log(spark, sf), 5))
    assert "EqualTo(l_orderkey,5)" in text


def test_snapshot_reads_only_its_columns_and_shuffles_once(spark, sf):
    text = plan(lww.snapshot(orders_log(spark, sf)).select("key", "value", "seq"))
    assert "o_totalprice" not in text and sum(" Exchange (" in line for line in text.split("\n\n")[0].splitlines()) <= 1


def test_layered_read_limits_groups_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(registry.queries()["q06b_read_order"](spark, sf))


def test_hot_queries_have_no_python(spark, sf):
    for name, f in registry.queries().items():
        if name not in ("q07c_exact_flushes", "q13_wal_replay", "q25_stream_apply", "q29_store_roundtrip", "q39_store_writes", "q40_segment_codec"):
            text = plan(f(spark, sf))
            assert "Python" not in text and "Arrow" not in text and "Pandas" not in text, name


def test_point_get_and_scan_of_the_queries_reach_the_scan(spark, sf):
    text = plan(registry.queries()["q02_point_get"](spark, sf))
    assert "EqualTo(user_id,42)" in text
    text = plan(registry.queries()["q04_range_scan"](spark, sf))
    assert "GreaterThanOrEqual(user_id,10)" in text and "LessThanOrEqual(user_id,18999)" in text


def test_number_ranges_are_those_of_the_texts(spark):
    from tidemark.sources.changelog import number_keys

    df = spark.range(12_000)
    for low, high in (("10", "19"), ("42", "42"), ("0", "0"), ("7", "70"), ("099", "2"), ("1", "1000"), ("9", "11"), ("", "5")):
        got = number_keys(F.col("id"), low, high)
        want = [str(n) for n in range(12_000) if low <= str(n) <= high]
        assert (got is None and not low) or [str(r[0]) for r in df.where(got).orderBy("id").collect()] == sorted(want, key=int)


def test_a_key_is_hashed_once(spark, sf):
    text = registry.queries()["q10_bloom_build"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("conv(") == 1
