import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import packing, token_counts, training_order
from tidemark.llm.token_ids import default_files, encoder

ALPHABET = [*" \n\t''''srtvmldeLl19²½é　  a中😀!.,<|>", "\r", "\x85", "​", "  ", "<|endoftext|>", " '", "'re", "'ll", "word", " the"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.default_vocabulary())


def count(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join), st.sampled_from([2, 3, 7]))
def test_transducer_equals_the_library(library, text, chunk):
    machine = token_counts.transducer(token_counts.default_vocabulary())
    assert machine.count(text) == count(library, text)
    plain = text.replace("<|endoftext|>", "+")
    assert machine.scanned(plain, chunk) == count(library, plain)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert token_counts.transducer(token_counts.default_vocabulary()).count(text) == count(library, text)
    assert encoder(default_files()).ids(text) == library.encode(text, add_special_tokens=False).ids


def test_chunk_maps_compose_in_any_grouping():
    machine = token_counts.transducer(token_counts.default_vocabulary())
    rng = random.Random(2)
    text = "".join(rng.choice(ALPHABET) for _ in range(400)).replace("<|endoftext|>", "")
    maps = [machine.chunk_map(text[i : i + 9]) for i in range(0, len(text), 9)]
    one = maps[0]
    for m in maps[1:]:
        one = machine.compose(one, m)
    other = machine.compose(machine.scan(maps[:7])[-1], machine.scan(maps[7:])[-1])
    assert one[:2] == other[:2] and machine.scan(maps)[-1][:2] == one[:2]


def test_few_states_are_kept():
    machine = token_counts.Transducer(token_counts.default_vocabulary(), max_states=50)
    text = "Any words that need more than fifty states, 123 of them; don't they? " * 3
    assert machine.count(text) == token_counts.transducer(token_counts.default_vocabulary()).count(text)
    assert len(machine.states) <= 50


def test_counts_of_documents(spark, sf, documents, library):
    got = {r["doc_id"]: r for r in token_counts.op1_token_counts(spark, sf).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["n_tokens"], g["over_limit"]) == (len(r["text"].encode()), count(library, r["text"]), count(library, r["text"]) > 512)


def test_counts_of_odd_rows(odd, none, library):
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(odd).collect())
    want = sorted((r["doc_id"] or 0, len((r["text"] or "").encode()), count(library, r["text"] or "")) for r in odd.collect())
    assert got == want and token_counts.count_tokens(none).count() == 0


def check_packed(rows, texts, library, max_len):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= max_len
    for doc, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        seen = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == seen and r["doc_tokens"] == len(ids)
            part = ids[seen : seen + r["length"]]
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
            seen += r["length"]
        assert seen == len(ids)
    used = sum(r["length"] for r in rows)
    return used / (max_len * max(1, len(by_sequence)))


def test_packing_of_documents(spark, sf, documents, library):
    rows = packing.op7_packing(spark, sf).collect()
    assert check_packed(rows, {r["doc_id"]: r["text"] for r in documents.collect()}, library, 1024) > 0.95


def test_packing_of_odd_rows(odd, none, library):
    rows = packing.pack(odd.where("doc_id is null or doc_id <> 5"), 64, keep_ids=True).collect()
    check_packed(rows, {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] != 5}, library, 64)
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    twice = packing.pack(odd.where("doc_id = 5"), 64).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in twice}) == 2
    assert packing.pack(none).count() == 0


def test_patterns_hold_each_piece_once():
    rng = random.Random(4)
    histogram = Counter(rng.randint(1, 100) for _ in range(5000))
    patterns = packing.shortest_pack_first(histogram, 100)
    used = Counter()
    for n, pattern in patterns:
        assert sum(pattern) <= 100 and pattern == sorted(pattern, reverse=True)
        for length in pattern:
            used[length] += n
    assert used == histogram
    assert sum(n for n, _ in patterns) * 100 <= 1.03 * sum(k * v for k, v in histogram.items())


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    a, b = (training_order.feistel(np.arange(n), n, key) for key in (1, 2))
    assert sorted(a) == list(range(n)) and (n < 64 or (a != b).any()) and (n < 64 or (a != np.arange(n)).any())


def test_training_order_of_documents(spark, documents, library, tmp_path):
    shards = training_order.write_shards(documents, str(tmp_path / "shards"), seq_len=32, shard_bytes=3000)
    rows = training_order.read_shards(spark, shards).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(shards.sequences))
    ids: dict = {}
    for r in rows:
        assert r["shard"] == r["slot"] // shards.per_shard and r["byte_offset"] == r["slot"] % shards.per_shard * shards.stride
        ids.setdefault(r["doc_id"], {})[r["seq_no"]] = np.frombuffer(r["ids"], "<u2").tolist()
    for r in documents.collect():
        parts = ids[r["doc_id"]]
        assert sum((parts[i] for i in range(len(parts))), []) == library.encode(r["text"], add_special_tokens=False).ids
    order = [r["doc_id"] for r in rows]
    assert order != sorted(order)


def test_a_slot_is_found_by_seeking(spark, documents, tmp_path):
    shards = training_order.write_shards(documents, str(tmp_path / "shards"), seq_len=32, shard_bytes=3000)
    want = {r["slot"]: r for r in training_order.read_shards(spark, shards).collect()}
    files = {sum(map(int, training_order._SHARD.search(str(p)).groups())): p for p in (tmp_path / "shards").glob("from-*/part-*")}
    for slot in (0, 1, shards.per_shard, shards.sequences - 1):
        shard, at = divmod(slot, shards.per_shard)
        with open(files[shard], "rb") as f:
            f.seek(at * shards.stride)
            record = f.read(shards.stride)
        doc, no, n = training_order.struct.unpack_from(training_order.HEAD, record)
        assert (doc, no, n) == (want[slot]["doc_id"], want[slot]["seq_no"], want[slot]["n_ids"]) and record[-1:] == b"\n"


def test_training_order_of_odd_rows(spark, odd, none, tmp_path):
    shards = training_order.write_shards(odd, str(tmp_path / "a"), seq_len=512)
    rows = training_order.read_shards(spark, shards).collect()
    assert sorted(r["slot"] for r in rows) == list(range(shards.sequences))
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd.collect()} and sum(r["doc_id"] == 5 for r in rows) == 2
    assert training_order.read_shards(spark, training_order.write_shards(none, str(tmp_path / "b"))).count() == 0


def test_training_order_is_keyed_by_data_alone(spark, documents, tmp_path):
    from tests.llm.test_sharding import all_ways

    same = spark.range(300).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))

    def order(df, key=3):
        path = str(tmp_path / f"s{len(list(tmp_path.iterdir()))}")
        shards = training_order.write_shards(df, path, seq_len=32, shard_bytes=6000, key=key, copies=20)
        return [(r["slot"], r["doc_id"], r["seq_no"], bytes(r["ids"])) for r in training_order.read_shards(spark, shards).orderBy("slot").collect()]

    some = documents.select("doc_id", "text").unionByName(same)
    first, *others = all_ways(spark, some, order)
    assert [r[0] for r in first] == list(range(len(first))) and all(o == first for o in others)
    other = order(some, key=4)
    assert sum(a != b for a, b in zip(first, other)) > len(first) // 2 and sorted(r[1:] for r in first) == sorted(r[1:] for r in other)
    assert len({i * 10 // len(first) for i, r in enumerate(first) if r[1] == 5}) == 10


def test_training_order_query(spark, sf, documents, library, tmp_path):
    from tests.llm.test_sharding import all_ways

    def rows(df):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        df.write.parquet(f"{path}/documents.parquet")
        return sorted(map(tuple, training_order.op10_training_order(spark, path).collect()))

    first, *others = all_ways(spark, documents, rows)
    assert all(o == first for o in others) and [r[0] for r in first] == list(range(len(first)))
    parts = {(doc, no): crc for _, _, _, doc, no, _, crc in first}
    for r in documents.collect():
        ids = np.array(library.encode(r["text"], add_special_tokens=False).ids, "<u2")
        for no, at in enumerate(range(0, max(1, len(ids)), 256)):
            assert parts.pop((r["doc_id"], no)) == zlib.crc32(ids[at : at + 256].tobytes())
    assert not parts


@pytest.mark.parametrize("n", [1, 2, 7, 50, 4097])
def test_slots_in_sql_are_those_of_the_array_form(spark, n):
    got = [r[0] for r in spark.range(n).select(training_order.permuted(F.col("id"), n, 11)).collect()]
    assert got == training_order.feistel(np.arange(n), n, 11).tolist()


def test_reading_resumes_at_a_slot(spark, documents, tmp_path):
    shards = training_order.write_shards(documents, str(tmp_path / "shards"), seq_len=32, shard_bytes=3000)
    want = sorted(map(tuple, training_order.read_shards(spark, shards).collect()))
    for first in (0, 1, shards.per_shard - 1, shards.per_shard * 3 + 5, shards.sequences - 1, shards.sequences):
        assert sorted(map(tuple, training_order.read_shards(spark, shards, first).collect())) == [w for w in want if w[0] >= first]
