"""Near-duplicate groups by an inverted join of MinHash signature coordinates.

1. A text's set of word shingles gets a signature. Texts with equal sets are one
   class from here on, however many there are.
2. Classes are posted under coordinate-value pairs. Two sets that are as similar
   as asked agree in at least ``t`` of ``POST`` posted coordinates (but for a
   chance of a few in a hundred thousand at the threshold itself), so they
   meet under one of each other's first POST - t + 1 pairs in any fixed order: the
   prefix. The order is rarest first, by a count sketch of fixed size, so that
   pairs that very many texts have are skipped.
3. Who meets under a pair is compared on the whole signature. Lists longer than
   ``BLOCK`` are split, and blocks are compared with blocks; only those with
   enough equal coordinates come out, and only under the first pair in the order
   that both have, so each once. First only a spanning forest of each block,
   most alike first, is checked on the full sets; then another one of what the
   links found so far leave apart; then all that is left apart. So a group of a
   thousand alike texts gives some thousand pairs.
4. Links are confirmed on full shingle sets; components of links are the groups.

Defined results: null and empty texts, and texts without words, have no shingles
and are linked with nothing; a text of fewer than ``SHINGLE`` words has one
shingle, its whole sequence; a null id gets a null component, is kept, and links
nothing; rows with one id count as one document, those with equal texts being in
one class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, id_text, spread, table
from tidemark.llm.components import components
from tidemark.runtime import Scratch, ship

SHINGLE, POST, MORE = 5, 48, 400
SKETCH = 1 << 19
BLOCK = 256
#: How many standard deviations below its mean the number of equal coordinates may lie.
DEVIATIONS = 4.25
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def constants() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    table_ = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    a = rng.integers(1, 1 << 63, POST + MORE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(1, 1 << 63, POST + MORE, dtype=np.uint64)
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return table_, a, b, space


@functools.cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and those of its inverse, for ``n`` places."""
    base = 0x9E3779B97F4A7C15
    step = np.full(n, base, np.uint64)
    step[0] = 1
    back = np.full(n, pow(base, -1, 1 << 64), np.uint64)
    back[0] = 1
    return np.cumprod(step, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a whole text."""
    raw = np.frombuffer((text or "").encode().lower(), np.uint8)
    values, _, _, space = constants()
    inside = ~space[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    first, end = edges[::2], edges[1::2]
    if not len(first):
        return np.zeros(0, np.uint64)
    up, down = powers(1 << max(12, int(len(raw)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values[raw] * up[: len(raw)], dtype=np.uint64)])
    words = mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))
    size = min(SHINGLE, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - size + 1 + i])
    return np.unique(h)


def signature(x: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set, 32 bits each."""
    _, a, b, _ = constants()
    out = np.full(POST + MORE, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(x), 2048):
        out = np.minimum(out, ((x[i : i + 2048] * a[:, None] + b[:, None]) >> np.uint64(32)).min(axis=1))
    return out.astype("<u4")


def least_equal(k: int, percent: int) -> int:
    s = percent / 100
    return max(1, math.floor(k * s - DEVIATIONS * math.sqrt(k * s * (1 - s))))


def sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, node (of equal sets; null without shingles), post (POST 32-bit values), sig (low bytes of the other values)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, nodes, posts, sigs = [], [], [], []
            for text in batch.column(1):
                x = shingles(text.as_py())
                counts.append(len(x))
                if not len(x):
                    nodes.append(None), posts.append(None), sigs.append(None)
                    continue
                s = signature(x)
                nodes.append(int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True))
                posts.append(s[:POST].tobytes())
                sigs.append(s[POST:].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(posts, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "node", "post", "sig"])

    return id_text(df, id_col, text_col).mapInArrow(make, "doc_id long, n_shingles long, node long, post binary, sig binary")


def matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def pair_hashes(posts: np.ndarray) -> np.ndarray:
    """One 64-bit number for each coordinate-value pair."""
    return mix(posts.astype(np.uint64) | (np.arange(1, POST + 1, dtype=np.uint64) << np.uint64(32)))


def frequencies(classes: DataFrame) -> np.ndarray:
    """How many pairs fall on each of SKETCH places."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount((pair_hashes(matrix(batch.column(0), "<u4", POST)) % np.uint64(SKETCH)).astype(np.int64).ravel(), minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["place", "n"])

    out = np.zeros(SKETCH, np.int64)
    # At most SKETCH rows of two numbers.
    got = classes.select("post").mapInArrow(count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("place").to_numpy()] = got.column("n").to_numpy()
    return out


def ranks(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The pairs of each row, as places, rarest first."""
    return np.lexsort((pairs, counts[pairs % np.uint64(SKETCH)]), axis=-1)


def postings(classes: DataFrame, prefix: int, counts) -> DataFrame:
    """pair, node: each class under its rarest pairs. ``counts``: a broadcast sketch of frequencies."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pairs = pair_hashes(matrix(batch.column(1), "<u4", POST))
            order = ranks(pairs, counts.value)[:, :prefix]
            nodes = np.repeat(batch.column(0).to_numpy(), prefix)
            yield pa.RecordBatch.from_arrays([pa.array(np.take_along_axis(pairs, order, 1).ravel().view(np.int64)), pa.array(nodes)], ["pair", "node"])

    return classes.select("node", "post").mapInArrow(post, "pair long, node long")


def placed(classes: DataFrame, prefix: int, counts) -> DataFrame:
    """pair, lo, hi, node, mine, n, post, sig: the lists with more than one class, in blocks; a block goes wherever it is compared."""
    posts = postings(classes, prefix, counts)
    lists = posts.groupBy("pair").agg(F.count("*").alias("size")).where("size > 1")
    rows = posts.join(lists, "pair").join(classes.select("node", F.col("n_shingles").alias("n"), "post", "sig"), "node")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node", "pair"), blocks).cast("int")
    other = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return other.select("pair", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "node", "mine", "n", "post", "sig")


def spanning(a: np.ndarray, b: np.ndarray, equal: np.ndarray, size: int) -> np.ndarray:
    """Which pairs of places make a spanning forest, most alike first."""
    parent = list(range(size))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    chosen = []
    for i in np.argsort(-equal, kind="stable"):
        x, y = find(int(a[i])), find(int(b[i]))
        if x != y:
            parent[x] = y
            chosen.append(i)
    return np.array(chosen, np.int64)


def compared(rows: DataFrame, percent: int, forest: bool, counts) -> DataFrame:
    """a, b: pairs of classes that meet in a block and agree in enough coordinates, and have different labels."""
    enough = least_equal(POST + MORE, percent)

    def group(nodes, label, mine, n, post, sig, pair, lo, hi) -> tuple[np.ndarray, np.ndarray]:
        left, right = (np.arange(len(nodes)),) * 2 if lo == hi else (np.flatnonzero(mine == lo), np.flatnonzero(mine == hi))
        found = []
        for k, i in enumerate(left):
            others = right[k + 1 :] if lo == hi else right
            others = others[(label[others] != label[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))]
            if len(others):
                common = post[others] == post[i]
                equal = common.sum(axis=1) + (sig[others] == sig[i]).sum(axis=1)
                some = equal >= enough
                if some.any():
                    own = pair_hashes(post[i])
                    order = np.empty(POST, np.int64)
                    order[ranks(own, counts.value)] = np.arange(POST)
                    some &= np.where(common, order, POST).min(axis=1) == order[own == np.int64(pair).view(np.uint64)][0]
                if some.any():
                    found.append((np.full(some.sum(), i), others[some], equal[some]))
        if not found:
            return nodes[:0], nodes[:0]
        a, b, equal = (np.concatenate(x) for x in zip(*found))
        if forest and len(a) > 1:
            chosen = spanning(a, b, equal, len(nodes))
            a, b = a[chosen], b[chosen]
        return np.minimum(nodes[a], nodes[b]), np.maximum(nodes[a], nodes[b])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def work(columns: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], pa.RecordBatch]:
            pair, lo, hi = columns[:3]
            new = np.flatnonzero((pair[1:] != pair[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            starts = np.concatenate([[0], new])
            ends = np.concatenate([new, [len(pair)]])
            full = len(starts) if last else len(starts) - 1
            out = [group(*(c[s:e] for c in columns[3:]), pair[s], lo[s], hi[s]) for s, e in zip(starts[:full], ends[:full]) if e - s > 1]
            a, b = (np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), ())))
            rest = [c[starts[-1] :] for c in columns]
            return rest, pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(7)] + [matrix(batch.column(7), "<u4", POST), matrix(batch.column(8), "u1", MORE)]
            columns = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
            held, out = work(columns, False)
            yield out
        if held is not None:
            yield work(held, True)[1]

    ordered = rows.select("pair", "lo", "hi", "node", "label", "mine", "n", "post", "sig").repartition("pair", "lo", "hi").sortWithinPartitions("pair", "lo", "hi")
    return ordered.mapInArrow(compare, "a long, b long").distinct()


def confirmed(pairs: DataFrame, classes: DataFrame, df: DataFrame, percent: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """u, v: the pairs whose full sets are as similar as asked."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = scratch.table(nodes.join(classes.select("node", "doc_id"), "node"), "candidates")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()).tobytes() for t in batch.column(1)]
            own = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in found]
            same = pa.array([a == b for a, b in zip(own, batch.column(0).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "x"]).filter(same)

    # A repeated id may bring other texts along; they are told apart by their node.
    texts = id_text(df, id_col, text_col).join(bounded(wanted), "doc_id").select("node", "text")
    full = scratch.table(texts.mapInArrow(sets, "node long, x binary").dropDuplicates(["node"]), "shingle-sets")

    @F.pandas_udf("boolean")
    def similar(x, y):
        import pandas as pd

        def one(p: bytes, q: bytes) -> bool:
            both = len(p) // 8 + len(q) // 8
            union = len(np.unique(np.concatenate([np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)])))
            return 100 * (both - union) >= percent * union

        return pd.Series([one(p, q) for p, q in zip(x, y)], dtype=bool)

    one, two = full.select(F.col("node").alias("a"), F.col("x").alias("xa")), full.select(F.col("node").alias("b"), F.col("x").alias("xb"))
    return pairs.join(one, "a").join(two, "b").where(similar("xa", "xb")).select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_groups(df: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id of the group), kept: one row for each row of ``df``."""
    ship(df.sparkSession)
    with Scratch(df.sparkSession) as scratch:
        made = scratch.table(sketches(df, id_col, text_col), "sketches")
        some = made.where("node is not null and doc_id is not null")
        classes = scratch.table(some.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("post").alias("post"), F.first("sig").alias("sig")), "classes")
        counts = df.sparkSession.sparkContext.broadcast(np.minimum(frequencies(classes), 0xFFFFFFFF).astype(np.uint32))
        lists = scratch.table(placed(classes, POST - least_equal(POST, percent) + 1, counts), "postings")
        tried = links = None
        for forest in (True, True, False):
            labels = lists.withColumn("label", F.col("node")) if links is None else lists.join(components(links), "node", "left").withColumn("label", F.coalesce("root", "node"))
            pairs = compared(labels, percent, forest, counts)
            pairs = scratch.table(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
            found = scratch.table(confirmed(pairs, classes, df, percent, id_col, text_col, scratch), "links")
            tried, links = (pairs, found) if tried is None else (tried.unionByName(pairs), links.unionByName(found))
        roots = components(links)
        linked = classes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        names = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        named = linked.join(names, "root").select("node", "component_id")
        out = made.select("doc_id", "n_shingles", "node").join(named, "node", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
        return scratch.result(out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept")), "near-groups")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), percent=85)
