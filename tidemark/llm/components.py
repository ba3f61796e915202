"""Connected components of an edge table: local forests, joined by large-star and small-star rounds.

The edges lie in as many partitions as they need at ``CHUNK`` edges each. Before
the first round and after each one, every partition replaces its edges by stars
of what they connect, in chunks of that size; rounds join what lies in different
chunks. No step adds edges, and each one that changes an edge lowers the sum of
the ends' ranks, so a round without change means that every component is one
star; so does a table that one chunk holds. A node with many edges is
pre-aggregated before the shuffle, and its edges learn its least neighbour from a
broadcast of at most ``MAX_HOT`` nodes instead of meeting in one task. Nothing
but a few numbers a round goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import Scratch, ship

MAX_ROUNDS = 60
#: Edges that a task holds at once.
CHUNK = 1 << 20
#: A node is hot with more edges than HOT and than would let over MAX_HOT nodes be so.
HOT, MAX_HOT = 64, 100_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node other than the least of its component to that one."""
    nodes, places = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = places[: len(u)], places[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _local(edges: DataFrame, n_edges: int) -> DataFrame:
    """u, v: the stars of each chunk of ``edges``, which are about ``n_edges``; ``chunk`` tells the chunks apart."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list, chunk: int) -> pa.RecordBatch:
            u, v = stars(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(np.full(len(u), chunk), pa.int64())], ["u", "v", "chunk"])

        held, n, chunk = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield out(held, chunk)
                held, n, chunk = [], 0, chunk + 1
        if n:
            yield out(held, chunk)

    return edges.coalesce(max(1, -(-n_edges // CHUNK))).mapInArrow(contract, "u long, v long, chunk long")


def _with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``edges`` with ``m`` of their ``u``. ``least``: u, m and the number ``d`` of edges that were seen of it, 2 ``n`` in all."""
    hot = max(HOT, 2 * n // MAX_HOT)
    near = edges.join(F.broadcast(least.where(F.col("d") > hot).select("u", "m")), "u", "left")
    far = near.where("m is null").drop("m").join(least.where(F.col("d") <= hot).select("u", "m"), "u")
    return near.where("m is not null").unionByName(far)


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).select("u", F.least("u", "m").alias("m"), "d")
    return _with_least(both.where("v > u"), least, n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
    moved = _with_least(down, least, n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """How many edges, a sum over them, and whether one chunk has them all."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.min("chunk") == F.max("chunk"), F.lit(True))).first())


def components(edges: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """node, root: for each node with an edge (columns u, v) other than the root, the least node that it reaches."""
    ship(edges.sparkSession)
    with Scratch(edges.sparkSession) as scratch:
        e = scratch.table(_local(edges.where("u <> v").select("u", "v"), edges.count()), "edges")
        mark = _mark(e)
        for _ in range(rounds):
            if mark[2]:
                break
            e = scratch.table(_local(_small(_large(e.select("u", "v"), mark[0]), mark[0]), mark[0]), "edges")
            new = _mark(e)
            if new[:2] == mark[:2]:
                break
            mark = new
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        return scratch.result(e.select(F.col("u").alias("node"), F.col("v").alias("root")), "roots")
