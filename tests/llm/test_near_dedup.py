import random
import re

import numpy as np
import pytest

from tidemark.llm import components as components_module
from tidemark.llm import near_dedup
from tidemark.llm.components import components


def shingle_set(text):
    raw = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return frozenset([tuple(raw[i : i + 5]) for i in range(len(raw) - 4)] if len(raw) >= 5 else [tuple(raw)] if raw else [])


def brute(rows, percent):
    """doc_id to (set size, component), by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            inter = len(sets[a][1] & sets[b][1])
            if inter and 100 * inter >= percent * (len(sets[a][1]) + len(sets[b][1]) - inter):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least: dict = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (len(s), least[find(k)]) for k, (i, s) in enumerate(sets)}


def check(df, percent):
    got = near_dedup.near_groups(df, percent).collect()
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()], percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_query_equals_brute_force(spark, sf, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.op3_near_dedup(spark, sf).collect()}
    want = brute([(r["doc_id"], r["text"]) for r in documents.collect()], 85)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


@pytest.mark.parametrize("percent", [80, 85])
def test_chains_stars_and_crowds(spark, percent, monkeypatch):
    """Copies of copies, copies of one text, texts that share a passage, and equal texts; lists are split into small blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, passage, texts = [word() for _ in range(150)], [word() for _ in range(60)], []
    chain = list(base)
    for _ in range(50):
        chain = list(chain)
        for _ in range(2):
            chain[rng.randrange(150)] = word()
        texts.append(" ".join(chain))
    for _ in range(60):
        star = list(base)
        star[rng.randrange(150)] = word()
        texts.append(" ".join(star))
    texts += [" ".join(passage + [word() for _ in range(rng.choice([10, 15, 60]))]) for _ in range(60)]
    texts += ["Equal  TEXT of a few words here", "equal text of a few words\nhere", "two words", "Two words", "one", "", "  "] + texts[:5]
    order = list(range(len(texts)))
    rng.shuffle(order)
    check(spark.createDataFrame([(i * 3, texts[k]) for i, k in enumerate(order)], "doc_id long, text string"), percent)


def test_odd_rows(odd, none):
    got = near_dedup.near_groups(odd).collect()
    assert len(got) == odd.count() and near_dedup.near_groups(none).count() == 0
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == r["doc_id"] and r["kept"]
    assert {r["doc_id"]: r["n_shingles"] for r in got}[3] == 0


def test_words_are_cut_at_ascii_white_space_only():
    a, b = near_dedup.shingles("É b c d e\x0bf"), near_dedup.shingles("É B C D E F")
    assert len(a) == 2 and (a == b).all() and not np.array_equal(a, near_dedup.shingles("é b c d e f"))
    assert len(near_dedup.shingles("a b\xa0c d e f")) == 1


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = near_dedup.signature(np.unique(x[:2700])), near_dedup.signature(np.unique(x[300:]))
    assert abs((a == b).mean() - 2400 / 3000) < 0.12


def test_components_of_paths_and_stars(spark):
    path = [(i * 7919 % 1000, (i + 1) * 7919 % 1000) for i in range(300)]
    star = [(5000, 6000 + i) for i in range(400)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(path + star + [(9, 9)], "u long, v long").repartition(3)).collect()}
    least = min(x for p in path for x in p)
    assert all(got[x] == least for p in path for x in p if x != least) and all(got[6000 + i] == 5000 for i in range(400)) and least not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_meet_across_partitions(spark, monkeypatch):
    """Edges of one component in many partitions, with more edges at its centre than make a node hot."""
    monkeypatch.setattr(components_module, "CHUNK", 100)
    rng = random.Random(4)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1400)] + [(7001, 8000 + i) for i in range(500)] + [(9000 + i, 9999) for i in range(500)] + [(-i, -i - 1) for i in range(1, 200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "u long, v long").repartition(40)
    got = [(r["node"], r["root"]) for r in components(df).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in parent if find(x) != x)
    with pytest.raises(RuntimeError):
        components(df, rounds=1)


def test_a_crowd_of_alike_texts_makes_few_pairs(spark):
    """In a group where all are alike, the pairs to confirm follow the number of texts, not its square."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(200):
        t = list(base)
        t[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(t)))
    made = near_dedup.sketches(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").cache()
    counts = spark.sparkContext.broadcast(near_dedup.frequencies(made).astype(np.uint32))
    lists = near_dedup.placed(made, near_dedup.POST - near_dedup.least_equal(near_dedup.POST, 85) + 1, counts).withColumn("label", near_dedup.F.col("node"))
    assert near_dedup.compared(lists, 85, True, counts).count() < 200 * 15 < near_dedup.compared(lists, 85, False, counts).count()
