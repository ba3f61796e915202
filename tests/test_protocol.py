import pytest
from pyspark.sql import functions as F

from tidemark.functions import protocol


@pytest.mark.parametrize("body,ok,value", [('{"value":"x"}', True, "x"), ('{"value":3}', False, None), ("{", False, None), ("null", True, ""), ("{}", True, ""), ('{"value":null}', True, ""), ("[1]", False, None), ('"x"', False, None), ('{"value":{"a":1}}', False, None), (None, False, None)])
def test_bodies(spark, body, ok, value):
    df = spark.createDataFrame([(body,)], "body string")
    good, v = protocol.body_value(F.col("body"))
    row = df.select(good.alias("ok"), v.alias("v")).first()
    assert row["ok"] is ok and (not ok or row["v"] == value)


def test_codes(spark):
    rows = [("GET", "", True, True, True, 400), ("GET", "a", True, True, False, 200), ("GET", "a", False, True, True, 404), ("PUT", "a", False, False, False, 400), ("PUT", "a", False, True, False, 503), ("PUT", "a", False, True, True, 200), ("DELETE", "a", False, True, False, 503), ("DELETE", "a", False, True, True, 200), ("POST", "a", True, True, True, 405), ("POST", None, True, True, True, 400)]
    df = spark.createDataFrame(rows, "m string, k string, f boolean, b boolean, l boolean, want int")
    got = df.select(protocol.status_code(F.col("m"), F.col("k"), F.col("f"), F.col("b"), F.col("l")).alias("c"), "want").collect()
    assert all(r["c"] == r["want"] for r in got)
    assert df.limit(1).select(protocol.status_code(F.lit("GET"), F.lit("a"), F.lit(True), F.lit(True), F.lit(True), F.lit(False))).first()[0] == 500


def test_commands(spark):
    rows = [(1, "k1", "v1"), (2, "k1", None), (1, "k1", "")]
    df = spark.createDataFrame(rows, "op int, key string, value string")
    enc = [r[0] for r in df.select(protocol.encode_command(F.col("op"), F.col("key"), F.col("value"))).collect()]
    assert enc[:2] == ['{"type":1,"key":"k1","value":"djE="}', '{"type":2,"key":"k1"}']
    for compat, want in ((None, (1, "")), ("empty_is_delete", (2, None))):
        c = protocol.decode_command(protocol.encode_command(F.col("op"), F.col("key"), F.col("value"), compat), compat)
        row = df.where("value = ''").select(c["op"].alias("op"), c["value"].alias("v")).first()
        assert (row["op"], row["v"]) == want
    bad = spark.createDataFrame([("nonsense",), ('{"type":7,"key":"a"}',)], "t string")
    assert bad.select(protocol.decode_command(F.col("t")).alias("c")).where("c is not null").count() == 0


def test_keys_of_paths(spark):
    df = spark.createDataFrame([("/api/kv/a/b c",), ("/api/kv/",), ("/other",)], "p string")
    assert [r[0] for r in df.select(protocol.path_key(F.col("p"))).collect()] == ["a/b c", "", None]


def test_lines(spark):
    df = spark.createDataFrame([("  put k v w ",), ("GET k",), ("quit",), ("put k",), ("",), ("Delete k",)], "line string")
    got = [(r["command"], r["key"], r["value"], r["usage_ok"]) for r in protocol.parse_line(df).collect()]
    assert got == [("put", "k", "v w", True), ("get", "k", None, True), ("exit", None, None, True), ("put", "k", None, False), ("", None, None, False), ("del", "k", None, True)]
