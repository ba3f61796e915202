import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import lm_scoring as lm
from tidemark.llm.common import residue


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower()), None]


def learned(rows):
    """Counts of words, pairs and trigrams, and of texts, of the rows that are not held out."""
    uni, pairs, threes, texts = Counter(), Counter(), Counter(), 0
    for doc, text in rows:
        if zlib.crc32(str(doc if doc is not None else "").encode()) % 10:
            t = tokens(text)
            uni.update(t)
            pairs.update(zip([0, *t[:-1]], t))
            threes.update(zip([0, *t[:-2]], t[:-1], t[1:]))
            texts += 1
    return uni, pairs, threes, texts


def brute(rows, prior=lm.PRIOR, prior_pair=lm.PRIOR_PAIR):
    """An automaton walked token by token: a state is a tuple of known tokens, failure arcs drop its first one."""
    uni, pairs, threes, texts = learned(rows)
    n, v = sum(uni.values()), len(uni)
    left = {(w,): c for w, c in uni.items()} | {(0,): texts} | dict(pairs)
    seen = {1: pairs, 2: threes}
    known = {0: prior, 1: prior, 2: prior_pair}

    def p(state, w):
        if not state:
            return (uni.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))
        return (seen[len(state)].get((*state, w), 0) + known[len(state)] * p(state[1:], w)) / (left[state] + known[len(state)])

    def weight(state, w):
        """Down the failure arcs until there is an arc for w."""
        total = 0.0
        while state and not seen[len(state)].get((*state, w)):
            total += math.log10(known[len(state)] / (left[state] + known[len(state)]))
            state = state[1:]
        return total + math.log10(p(state, w))

    def onward(state, w):
        state = (*state, w)[-2:]
        while state and not left.get(state):
            state = state[1:]
        return state

    out = []
    for doc, text in rows:
        t, state, model = tokens(text), (0,) if texts else (), 0.0
        for w in t:
            model += weight(state, w)
            state = onward(state, w)
        base = sum(math.log10((uni.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        out.append((doc, zlib.crc32(str(doc if doc is not None else "").encode()) % 10 == 0, len(t), sum(uni.get(w, 0) > 0 for w in t), n, base, model))
    return out


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9, abs_tol=1e-9)


def test_query_equals_brute_force(spark, sf, documents):
    close(lm.op8_lm_scoring(spark, sf).collect(), brute([(r["doc_id"], r["text"]) for r in documents.collect()]))


def test_small_blocks_give_the_same(documents):
    close(lm.score(documents, residue(F.col("doc_id"), 10) == 0, block_tokens=500).collect(), brute([(r["doc_id"], r["text"]) for r in documents.collect()]))


def test_odd_rows(odd, none):
    held = residue(F.col("doc_id"), 10) == 0
    close(lm.score(odd, held).collect(), brute([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert lm.score(none, held).count() == 0
    row = lm.score(odd.where("doc_id = 2"), F.lit(True)).first()
    assert (row["train_tokens"], row["n_tokens"], row["n_known"], row["score"]) == (0, 1, 0, 0.0)


def test_weights_out_of_every_state_are_a_distribution():
    n, v, prior = 20, 4, 7.0
    c_word = np.array([8.0, 6, 5, 1])
    p = (c_word + 0.1) / (n + 0.1 * (v + 1))
    unknown = 0.1 / (n + 0.1 * (v + 1))
    pairs = np.array([3.0, 0, 2, 1])  # after a state that was left six times
    total = ((pairs + prior * p) / (6 + prior)).sum() + prior * unknown / (6 + prior)
    assert math.isclose(p.sum() + unknown, 1) and math.isclose(total, 1)


def test_held_out_texts_are_told_better_than_by_the_base(spark, sf):
    r = lm.op8_lm_scoring(spark, sf.replace("0.001", "0.01")).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > r[0]


def test_trigrams_tell_held_out_texts_better_than_pairs(spark, sf):
    """With very many imaginary counts beside a pair's own, a trigram says no more than the pair that ends it."""
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    held = residue(F.col("doc_id"), 10) == 0
    total = lambda **k: lm.score(docs, held, **k).where("held_out").agg(F.sum("score")).first()[0]
    assert total() > total(prior_pair=1e12)


def test_weights_of_a_pair_state_are_a_distribution():
    p2 = np.array([0.4, 0.3, 0.2, 0.1])  # of three tokens and the unknown one
    threes = np.array([2.0, 0, 1, 0])  # after a pair that was left three times
    assert math.isclose(((threes + lm.PRIOR_PAIR * p2) / (3 + lm.PRIOR_PAIR)).sum(), 1)


def test_planes_are_lossless():
    for x in ([], [0], [1, 255, 256, 2**40, 2**64 - 1]):
        assert lm.numbers(lm.planes(np.array(x, np.uint64))).tolist() == x
