import pytest
from pyspark.errors import AnalysisException

from tidemark import runtime


def test_tables_in_the_shared_folder(spark):
    df = spark.range(5)
    back = runtime.materialise(df, "t")
    assert back.schema.simpleString() == df.schema.simpleString() and back.count() == 5
    with runtime.Scratch(spark) as scratch:
        held = scratch.table(df.where("id > 2"))
        assert held.count() == 2
        path = scratch.paths[0]
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)


def test_batches_are_bounded_unless_the_session_says_otherwise(spark):
    session = spark.newSession()
    runtime.ship(session)
    assert session.conf.get(runtime.BATCH_SETTING) == runtime.BATCH_BYTES
    other = spark.newSession()
    other.conf.set(runtime.BATCH_SETTING, "3m")
    runtime.ship(other)
    assert other.conf.get(runtime.BATCH_SETTING) == "3m"
