import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_dedup import brute
from tests.llm.test_tokens import check_packed


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    from tidemark.llm.token_counts import default_vocabulary

    return Tokenizer.from_file(default_vocabulary())


def test_stages_equal_brute_force(spark, sf, documents, library):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "benchmark_leaks", "packing"]
    docs, columns = documents, documents.columns
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), "test")
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    all_ = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert set(kept[0]) == {i for i, t in all_.items() if any(map(str.isalpha, t))}
    groups = brute(list(kept[0].items()), 80)
    assert set(kept[1]) == {i for i, (_, c) in groups.items() if i == c}
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {i for i, t in kept[1].items() if any(x.lower() in t.lower() for x in items)}
    assert leaks and not leaks & set(kept[2]) and len(kept[1]) - len(kept[2]) <= len(leaks) + 1
    rows = corpus_pipeline.run(spark, sf).collect()
    assert check_packed(rows, kept[2], library, 1024) > 0.9 and {r["doc_id"] for r in rows} == set(kept[2])


def test_odd_rows(spark, odd, none, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, "Some question of ten words that nobody has ever asked before")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), name)
        assert docs.columns == odd.columns
    assert Counter(r["doc_id"] for r in docs.collect()) == Counter(i for i in (4, 5, 5, None, 6, 7) if i in {r["doc_id"] for r in docs.collect()})
    assert {4, 5, None} <= {r["doc_id"] for r in docs.collect()} and not {1, 2, 3} & {r["doc_id"] for r in docs.collect()}
    packed = corpus_pipeline.packing(spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    zero = zlib.crc32(np.zeros(1, "<u4").tobytes())
    assert all(r["length"] > 1 or r["ids_crc32"] == zero for r in packed)
    empty = none
    for name, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.materialise(stage(spark, empty, sf), name)
    assert empty.count() == 0


def test_columns_may_be_called_like_those_of_the_operators(spark, documents, sf):
    names = ["_gone", "gone", "score", "page", "node", "row_key", "lang_pred", "_0", "key"]
    docs = documents.where("doc_id < 60")
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(i))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), "test")
        assert docs.columns == [*documents.columns, *names]
    rows = docs.collect()
    assert len(rows) > 20 and all([r[n] for n in names] == list(range(len(names))) for r in rows)


def test_nothing_is_left_between_the_stages(spark, sf):
    import os

    from tidemark.runtime import Scratch, shared_dir

    home = shared_dir(spark).replace("file://", "")
    before = set(os.listdir(home))
    out = corpus_pipeline.run(spark, sf)
    left = {x for x in set(os.listdir(home)) - before if "-" in x and not x.startswith("rdd")}
    assert {x.rsplit("-", 1)[0] for x in left if os.listdir(os.path.join(home, x))} == {"packed"} and out.count() > 0 and not Scratch.stack
