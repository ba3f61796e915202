"""Packing documents into fixed-length sequences, shortest pack first over the length histogram.

Every document's token ids, ended by one id 0, are cut into full pieces of
``max_len`` and one rest. Only the histogram of piece lengths (at most
``max_len`` rows, however large the input) goes to the driver. There lengths are
placed longest first, each into the pack with most room among those that it
fits, and whole groups of equal packs move at once: the outcome is a list of
patterns with repeat counts. Patterns go back to the pieces by rank: the r-th
piece of a length takes the r-th place for that length.

Ranks come from salted windows. Pieces of one length (full ones may be most of
all) are spread over groups of about ``GROUP`` pieces, as many as the histogram
asks for, ranked inside them, and shifted by the groups' counts (a row for each
``GROUP`` pieces and length).

The ids are those that ``tokenizers`` gives for ``byte_bpe_50k.json``; they are
made by a faster library from the same vocabulary (see ``token_ids``), and tests
hold both against each other.

Defined results: a null or empty text is one piece with the single id 0; null
ids and repeated rows are packed like others; an empty table gives no rows;
other columns are ignored. Ties in rank are broken by id, start and content.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import MAX_BROADCAST, id_text, spread, table
from tidemark.llm.token_ids import default_files, encoder
from tidemark.runtime import materialise, ship

GROUP = 1 << 10
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(df: DataFrame, max_len: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece; with ``keep_ids`` also its ids as little-endian unsigned 32-bit numbers."""
    ship(df.sparkSession)
    files = default_files()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(files)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.array(text.as_py() or "", 0)
                for at in range(0, len(ids), max_len):
                    raw = ids[at : at + max_len].tobytes()
                    rows.append((doc, at, len(raw) // 4, zlib.crc32(raw), len(ids), *([raw] if keep_ids else [])))
            columns = list(zip(*rows)) or [()] * (5 + keep_ids)
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.binary()) for c in columns[5:]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    return id_text(df, id_col, text_col).mapInArrow(pieces, PIECES + ", ids binary" * keep_ids)


def shortest_pack_first(histogram: dict[int, int], max_len: int) -> list[tuple[int, list[int]]]:
    """(repeats, lengths of the pattern) for all packs."""
    room: dict[int, list[tuple[int, list[int]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            most = max(room, default=-1)
            if most < length:
                room.setdefault(max_len - length, []).append((left, [length]))
                break
            repeats, pattern = room[most].pop()
            if not room[most]:
                del room[most]
            took = min(left, repeats)
            if repeats > took:
                room.setdefault(most, []).append((repeats - took, pattern))
            room.setdefault(most - length, []).append((took, [*pattern, length]))
            left -= took
    return [x for _, packs in sorted(room.items()) for x in packs]


def places(patterns: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) of every slot of every pattern."""
    rows, sequence, used = [], 0, {}
    for repeats, pattern in patterns:
        offset = 0
        for length in pattern:
            first = used.get(length, 0)
            rows.append((length, first, first + repeats, sequence, offset))
            used[length] = first + repeats
            offset += length
        sequence += repeats
    return rows


def ranked(pieces: DataFrame, histogram: dict[int, int], group: int = GROUP) -> DataFrame:
    """Adds ``rank``: 0, 1, ... among the pieces of one length."""
    salts = F.array(*(F.lit(-(-histogram.get(n, 1) // group)) for n in range(max(histogram, default=0) + 1)))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.get(salts, F.col("length").cast("int"))))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "start", "ids_crc32"))
    few = sum(-(-n // group) for n in histogram.values()) <= MAX_BROADCAST
    joined = salted.withColumn("_in", inside).join(F.broadcast(shifts) if few else shifts, ["length", "_salt"])
    return joined.withColumn("rank", F.col("_shift") + F.col("_in") - 1).drop("_salt", "_in", "_shift")


def pack(df: DataFrame, max_len: int = 1024, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """All pieces with ``sequence_id`` and ``offset``. The pieces are written to the shared folder once."""
    spark = df.sparkSession
    pieces = materialise(cut(df, max_len, id_col, text_col, keep_ids), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = places(shortest_pack_first(histogram, max_len))
    slots_df = spark.createDataFrame(slots, "length long, _first long, _end long, _sequence long, offset long")
    r, s = ranked(pieces, histogram), F.broadcast(slots_df)  # the slots are those of a histogram of max_len lengths
    found = r.join(s, (r["length"] == s["length"]) & (r["rank"] >= s["_first"]) & (r["rank"] < s["_end"]))
    sequence = (s["_sequence"] + r["rank"] - s["_first"]).alias("sequence_id")
    return found.select(*(r[c] for c in pieces.columns), sequence, s["offset"])


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
