import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import language_id as li
from tidemark.llm.common import residue


def test_held_out_accuracy(spark, sf):
    big = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang")
    rows = li.op9_language_id(spark, big).join(docs, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_only_text_decides(spark, documents):
    model = li.train(documents.where(residue(F.col("doc_id"), 5) != 0))
    a = {r["doc_id"]: r["lang_pred"] for r in li.predict(documents, model, ("doc_id",)).collect()}
    changed = documents.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    assert a == {r["doc_id"]: r["lang_pred"] for r in li.predict(changed, model, ("doc_id",)).collect()}


def test_odd_rows(spark, odd, none, documents):
    model = li.train(documents)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in li.predict(odd, model, ("doc_id",)).collect()]
    assert len(got) == odd.count()
    for doc, lang, score in got:
        assert (lang, score) == ("und", 0.0) if doc in (1, 2, 3) else lang in model.languages and 0 <= score <= 1
    assert li.predict(none, model, ("doc_id",)).count() == 0
    nothing = li.train(none)
    assert {r["lang_pred"] for r in li.predict(odd, nothing, ("doc_id",)).collect()} == {"und"}
    digits = spark.createDataFrame([(1, "123 ... 456")], "doc_id long, text string")
    assert li.predict(digits, model).first()["lang_pred"] == "und"
    assert li.train(odd.withColumn("lang", F.lit(None).cast("string"))).languages == []


def test_filters_have_every_trained_gram():
    texts = {"aa": "the cat sat on the mat", "bb": "der hund liegt auf der matte"}
    masks = np.zeros(li.SLOTS, np.uint64)
    for i, t in enumerate(texts.values()):
        for row in li.picks(t):
            masks[row] |= np.uint64(1 << i)
    m = li.Model(list(texts), masks)
    for lang, t in texts.items():
        best, score = m.judge(t)
        assert best == lang and score > 0.99


def test_votes_are_corrected_for_chance():
    """A filter that accepts nearly everything must not win over one that fits."""
    rng = np.random.default_rng(2)
    masks = (rng.random(li.SLOTS) < 0.9).astype(np.uint64)
    for row in li.picks("some words of a known language in this text"):
        masks[row] |= np.uint64(2)
    assert li.Model(["noise", "real"], masks).judge("some words of a known language")[0] == "real"


def test_blocks_cover_the_whole_text():
    text = "ab" * 700_000
    assert "".join(li.blocks(text)) == text
