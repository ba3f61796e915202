import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, an empty text, white space, a very long text, repeated rows, ties, and columns whose names the operators use inside."""
    long = " ".join(f"word{i % 997} the, of" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "A short text."), (5, "A short text."), (None, "no id at all here, friend"), (6, "a <|endoftext|> b\x00c é 中文 😀"), (7, "x" * 5000)]
    return spark.createDataFrame([(i, t, "en", "s", 0, 1.0, b"k", 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, node binary, length int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
