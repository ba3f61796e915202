"""Language-model scores by a weighted backoff automaton over trigrams of all training texts.

The model. Tokens are lower-cased words and one end per text. The empty state
gives token w the weight log10 of p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). A word v
seen in training is a state: for a pair seen c(v w) times there is an arc with
weight log10 of p(w|v) = (c(v w) + K p(w)) / (c(v) + K), and a failure arc with
weight log10(K / (c(v) + K)) leads to the empty state, which then reads w. A pair
(u v) seen in training is a state, too: an arc for each seen trigram has weight
log10((c(u v w) + L p(w|v)) / (c(u v) + L)), and the failure arc with weight
log10(L / (c(u v) + L)) leads to the state v, and on from there. The weights out of
any state are the logarithms of a distribution over the V tokens and one unknown.
Reading w from any of them leads to the state (v w) if that pair is known, else to
w, else to the empty state: the longest known end of what was read. A text starts
in a state of its own, the one before any word.

So the state that a traversal carries is known from the last two tokens, and the
states of all tokens of a block are found at once; each token's weight is that of
its chain of failure arcs and the arc at its end.

The counts. No machine holds all of them. Tasks read the texts in blocks and keep
each block as word numbers with its own word list. A block asks for the totals
of its distinct words, pairs and trigrams, giving its own training counts along: one row for
each block and hash bucket, so a frequent word weighs no more than a rare one.
Buckets add up and answer in the order of the question. A block then has the
part of the automaton that its own texts can reach, whole and exact but for
collisions of 56-bit hashes, and one traversal from left to right adds up weights.

Defined results: a null or empty text has the single token of its end; a null id
counts as the empty id (held out) and stays null; repeated rows are counted and
scored each; without training rows all weights are 0 (of one unknown token); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import residue, spread, table
from tidemark.llm.near_dedup import constants, mix, powers
from tidemark.runtime import Scratch, ship

BLOCK_TOKENS, BUCKET_BITS, KEYS_PER_BUCKET = 1_000_000, 10, 1 << 20
#: K and L: how many times a shorter context counts beside what was seen.
PRIOR, PRIOR_PAIR = 30.0, 4.0
END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def planes(x: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, without those that are all zero, compressed."""
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([used]) + zlib.compress(raw[:used].tobytes(), 1)


def numbers(data: bytes) -> np.ndarray:
    used = data[0]
    raw = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(used, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :used] = raw.T
    return out.view("<u8").ravel()


def words(text: str | None) -> np.ndarray:
    """The 64-bit hashes of a text's lower-cased words, and the end."""
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    values, _, _, space = constants()
    edges = np.flatnonzero(np.diff(np.concatenate([[False], ~space[raw], [False]]).astype(np.int8)))
    first, end = edges[::2], edges[1::2]
    up, down = powers(1 << max(12, int(len(raw)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw] * up[: len(raw)], dtype=np.uint64)])
    return np.append(mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64)), END)


BLOCK = "block long, doc_ids array<long>, held array<boolean>, lengths binary, words binary, trained binary, ids binary, tokens long"


def blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Columns doc_id, held_out and text as blocks of word numbers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, no = TaskContext.get().partitionId(), 0
        ids, held, texts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            tokens, lengths = np.concatenate(texts), np.array([len(t) for t in texts], np.int64)
            known, place, n = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            place = back[place]
            learn = np.repeat(~np.array(held, bool), lengths)
            trained = np.bincount(place[learn], minlength=len(known)).astype(np.uint64)
            row = [(task << 32) + no, ids, held, planes(lengths.astype(np.uint64)), known[order].tobytes(), planes(trained), planes(place.astype(np.uint64)), len(tokens)]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 4, pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], ["block", "doc_ids", "held", "lengths", "words", "trained", "ids", "tokens"])

        for batch in batches:
            for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                texts.append(words(text.as_py()))
                ids.append(doc), held.append(out)
                size += len(texts[-1])
                if size >= block_tokens:
                    yield flush()
                    ids, held, texts, size, no = [], [], [], 0, no + 1
        if texts:
            yield flush()

    return docs.select("doc_id", "held_out", "text").mapInArrow(encode, BLOCK)


class Block:
    """A block's tokens with their pairs and trigrams, in the order in which it asks for totals."""

    def __init__(self, row: dict):
        self.lengths = numbers(row["lengths"]).astype(np.int64)
        self.words = np.frombuffer(row["words"], np.uint64)
        self.ids = numbers(row["ids"]).astype(np.int64)
        self.learn = np.repeat(~np.array(row["held"], bool), self.lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[self.first] = len(self.words)  # the state before a text
        codes, self.pair = np.unique(before * (len(self.words) + 1) + self.ids, return_inverse=True)
        self.state, self.read = np.divmod(codes, len(self.words) + 1)
        # A trigram is a pair and the token after it; the first token of a text has none.
        context = np.empty_like(self.pair)
        context[1:] = self.pair[:-1]
        context[self.first] = len(codes)
        threes, self.three = np.unique(context * (len(self.words) + 1) + self.ids, return_inverse=True)
        self.context, last = np.divmod(threes, len(self.words) + 1)
        self.short = np.empty(len(threes), np.int64)  # the pair that ends a trigram
        self.short[self.three] = self.pair
        both = np.append(self.words, BEGIN)
        pair_mix = mix(mix(both[self.state] * _STEP + np.uint64(1)) + self.words[self.read])
        three_mix = mix(mix(np.append(pair_mix, np.uint64(0))[self.context] * _STEP + np.uint64(3)) + self.words[last])
        self.keys = {"w": mix(self.words + np.uint64(7)) >> np.uint64(8), "p": pair_mix >> np.uint64(8), "t": three_mix >> np.uint64(8)}
        self.order = {kind: np.argsort(keys, kind="stable") for kind, keys in self.keys.items()}
        real = self.context < len(codes)
        self.order["t"] = self.order["t"][real[self.order["t"]]]  # nobody is asked for what starts a text

    def counts(self, kind: str) -> np.ndarray:
        """Training counts of the block's own tokens, in the order of its keys."""
        of = {"w": self.ids, "p": self.pair, "t": self.three}[kind]
        return np.bincount(of[self.learn], minlength=len(self.keys[kind])).astype(np.uint64)[self.order[kind]]


def asked(made: DataFrame, bits: int, kinds: str = "pwt") -> DataFrame:
    """kind, bucket, block, keys, counts: what blocks ask for, sorted by key."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                for kind in kinds:
                    keys, counts = b.keys[kind][b.order[kind]], b.counts(kind)
                    cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(56 - bits))
                    k, c = np.split(keys, cuts), np.split(counts, cuts)
                    some = [i for i in range(1 << bits) if len(k[i])]
                    packed = [planes(np.diff(k[i], prepend=np.uint64(i << (56 - bits)))) for i in some]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array(some, pa.int32()), pa.array([row["block"]] * n, pa.int64()), pa.array(packed, pa.binary()), pa.array([planes(c[i]) for i in some], pa.binary())], ["kind", "bucket", "block", "keys", "counts"])

    return made.mapInArrow(ask, "kind string, bucket int, block long, keys binary, counts binary")


def answered(requests: DataFrame, bits: int) -> DataFrame:
    """kind, bucket, block, totals (in the order of the keys), and for the first block of a bucket its distinct and all training tokens."""

    def answer(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(numbers(k)) + np.uint64(b << (56 - bits)) for k, b in zip(group.column("keys").to_pylist(), group.column("bucket").to_pylist())]
        counts = np.concatenate([numbers(c) for c in group.column("counts").to_pylist()])
        known, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(known)).astype(np.uint64)
        out = np.split(total[place], np.cumsum([len(k) for k in keys])[:-1])
        is_word, n = group.column("kind")[0].as_py() == "w", group.num_rows
        seen, all_ = (int((total > 0).sum()), int(total.sum())) if is_word else (0, 0)
        return pa.table({
            "kind": group.column("kind"), "bucket": group.column("bucket"), "block": group.column("block"), "totals": pa.array([planes(x) for x in out], pa.binary()),
            "distinct_tokens": pa.array([seen] + [0] * (n - 1), pa.int64()), "all_tokens": pa.array([all_] + [0] * (n - 1), pa.int64()),
        })

    return requests.groupBy("kind", "bucket").applyInArrow(answer, "kind string, bucket int, block long, totals binary, distinct_tokens long, all_tokens long")


def traverse(b: Block, counts: dict[str, np.ndarray], n: int, v: int, prior: float, prior_pair: float, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(base weight, model weight) of every token of a block, in reading order.

    An arc that was never seen has the weight of the failure arc and what is read
    after it, which is what its formula gives for a count of zero; so does a state
    that was never seen, whose failure arc costs nothing.
    """
    empty = (counts["w"] + 0.1) / (n + 0.1 * (v + 1))
    left = np.append(counts["w"], texts)[b.state]  # the state before a text has been left once for each training text
    pair = (counts["p"] + prior * empty[b.read]) / (left + prior)
    left = np.append(counts["p"], 0)[b.context]
    three = (counts["t"] + prior_pair * pair[b.short]) / (left + prior_pair)
    return np.log10(empty)[b.ids], np.log10(three)[b.three]


def score(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR, prior_pair: float = PRIOR_PAIR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; rows that are not held out are learned from."""
    ship(df.sparkSession)
    rows = df.select(df[id_col].cast("long").alias("doc_id"), held_out.alias("held_out"), df[text_col].cast("string").alias("text"))
    with Scratch(df.sparkSession) as scratch:
        made = scratch.table(blocks(rows, block_tokens), "blocks")
        tokens = made.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        bits = max(BUCKET_BITS, min(30, (tokens // KEYS_PER_BUCKET).bit_length()))
        # In two rounds, so that only one round's questions lie in shuffle files at a time.
        replies = reduce(DataFrame.unionByName, (scratch.table(answered(asked(made, bits, kinds), bits), "totals") for kinds in ("pw", "t")))
        v, n = replies.agg(F.coalesce(F.sum("distinct_tokens"), F.lit(0)), F.coalesce(F.sum("all_tokens"), F.lit(0))).first()
        texts = made.select(F.explode("held").alias("h")).where("not h").count()
        # A block gets its answers, one for each bucket that it asked.
        per_block = replies.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("kind", "bucket", "totals"))).alias("totals"))
        return scratch.result(traversed(made.join(per_block, "block"), n, v, prior, prior_pair, texts), "scores")


def traversed(joined: DataFrame, n: int, v: int, prior: float, prior_pair: float, texts: int) -> DataFrame:
    """The scores of the texts of blocks that have their totals."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                got = {"p": [], "w": [], "t": []}
                for x in row["totals"]:
                    got[x["kind"]].append(numbers(x["totals"]))
                counts = {}
                for kind, parts in got.items():
                    counts[kind] = np.zeros(len(b.keys[kind]))
                    if parts:
                        counts[kind][b.order[kind]] = np.concatenate(parts)
                base, model = traverse(b, counts, n, v, prior, prior_pair, texts)
                c_word = counts["w"]
                add = lambda x, at=b.first: np.add.reduceat(x, at)
                size = len(b.lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(b.lengths), pa.array(add((c_word[b.ids] > 0).astype(np.int64))), pa.array(np.full(size, n, np.int64)), pa.array(add(base)), pa.array(add(model))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return joined.mapInArrow(read, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), residue(F.col("doc_id"), 10) == 0)
