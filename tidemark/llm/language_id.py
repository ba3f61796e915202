"""Language identification with language-bitmask n-gram filters.

One table of 64-bit words is a Bloom filter for every language at once: bit l of
a word belongs to language l. An n-gram picks ``HASHES`` words; the bits that all
of them share are the languages that may contain it. A text's n-grams vote for
all languages they return; a language's votes are corrected for the share of
foreign n-grams that its filter would accept by chance (its fill to the power
``HASHES``), and the largest corrected share wins.

Training counts the same picks on labelled texts: bit l of a word is set if
language l picked that word at least ``min_count`` times and, relative to the
size of its sample, at least ``floor`` times as often as the language that
picked it most. The sample is bounded: about ``per_language`` documents of each
language, chosen by a hash of the id (a documented parameter; all of a smaller
language). The table has a fixed size, 8 * SLOTS bytes, however large the
corpus, and that is all that is sent to the executors. Counts are added up and
settled on executors, ``SPAN`` words at a time; the driver gets the masks.

Defined results: a text that is null or has no letter is ``und`` with score 0;
a text whose n-grams are all unknown gets the first language with score 0; ties
go to the first language in alphabetic order; with nothing to learn from every
text is ``und``; a null id is kept and counts as the empty id; repeated rows are
judged each; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import id_text, residue, spread, table
from tidemark.runtime import Scratch, ship

SLOTS, HASHES, GRAMS = 1 << 21, 3, (3, 4)
PER_LANGUAGE, TASKS = 3000, 16
#: Slots that are settled together.
SPAN = 1 << 15
#: Characters that are worked on at once.
BLOCK = 1 << 20


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def picks(text: str) -> np.ndarray:
    """The table words of the n-grams of a text: one row for each hash, one column for each n-gram."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # one gap after each word
    keep[:1] = True
    codes = np.where(is_letter, codes, 0)[keep].astype(np.uint64)
    known = codes > 0
    out = []
    for n in GRAMS:
        size = len(codes) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint64)
        some = np.zeros(size, np.uint8)
        for i in range(n):
            h = (h + codes[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            some += known[i : i + size]
        out.append(h[some >= n - 1])
    h = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return np.stack([(h >> np.uint64(21 * i)) & np.uint64(SLOTS - 1) for i in range(HASHES)]).astype(np.int64)


def blocks(text: str) -> Iterator[str]:
    """The whole text, in blocks; n-grams do not span two blocks."""
    for i in range(0, len(text), BLOCK):
        yield text[i : i + BLOCK]


class Model:
    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        bits = [((masks >> np.uint64(i)) & np.uint64(1)).mean() for i in range(len(languages))]
        self.false_rate = np.minimum(np.array(bits, float) ** HASHES, 0.99)

    def judge(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        votes, n = np.zeros(len(self.languages)), 0
        for block in blocks(text):
            p = picks(block)
            found = self.masks[p[0]]
            for row in p[1:]:
                found &= self.masks[row]
            votes += [np.count_nonzero(found & np.uint64(1 << i)) for i in range(len(self.languages))]
            n += p.shape[1]
        share = np.clip((votes - n * self.false_rate) / max(n, 1) / (1 - self.false_rate), 0, 1)
        best = int(share.argmax())
        return self.languages[best], float(share[best])


def train(labelled: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE, min_count: int = 3, floor: float = 0.1) -> Model:
    """A model of the rows of ``labelled`` that have a text and a language."""
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.select(labelled[lang_col].cast("string").alias("lang"), labelled[id_col].alias("id"), labelled[text_col].alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if len(sizes) > 64:
        raise ValueError(f"{len(sizes)} languages; a mask has 64 bits")
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(SLOTS, np.uint64))
    place = {x: i for i, x in enumerate(languages)}
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang]))))
    draw = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share[F.col("lang")]).select("lang", "text").repartition(TASKS).sortWithinPartitions("lang")
    with Scratch(spark) as scratch:
        counts = scratch.table(counted(sample), "language-counts")
        sums = {r["lang"]: float(r["n"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        enough = [min(min_count, max(1, sizes[x] // 50)) for x in languages]

        def settle(group: pa.Table) -> pa.Table:
            totals = np.zeros((len(languages), SPAN))
            for lang, found in zip(group.column("lang").to_pylist(), group.column("counts").to_pylist()):
                totals[place[lang]] += np.frombuffer(zlib.decompress(found), np.uint32)
            rates = totals / np.array([[max(sums.get(x, 0.0), 1.0)] for x in languages])
            most = rates.max(axis=0)
            masks = np.zeros(SPAN, np.uint64)
            for i in range(len(languages)):
                masks |= ((totals[i] >= enough[i]) & (rates[i] >= floor * most)).astype(np.uint64) << np.uint64(i)
            return pa.table({"part": group.column("part")[:1], "masks": pa.array([zlib.compress(masks.tobytes(), 1)], pa.binary())})

        masks = np.zeros(SLOTS, np.uint64)
        # SLOTS words of 64 bits, however large the sample.
        for r in counts.groupBy("part").applyInArrow(settle, "part int, masks binary").collect():
            masks[r["part"] * SPAN : (r["part"] + 1) * SPAN] = np.frombuffer(zlib.decompress(r["masks"]), np.uint64)
    return Model(languages, masks)


def counted(sample: DataFrame) -> DataFrame:
    """part (of SPAN slots), lang, counts of its slots and their sum, for each task's texts (lang, text), which come language by language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, mine = None, np.zeros(SLOTS, np.uint32)

        def flush() -> pa.RecordBatch:
            parts = mine.reshape(-1, SPAN)
            some = np.flatnonzero(parts.any(axis=1))
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([lang] * len(some), pa.string()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in some], pa.binary()), pa.array([int(parts[i].sum()) for i in some], pa.int64())], ["part", "lang", "counts", "n"])

        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own != lang:
                    if lang is not None:
                        yield flush()
                    lang, mine[:] = own, 0
                for block in blocks(text.as_py()):
                    found, n = np.unique(picks(block), return_counts=True)
                    mine[found] += n.astype(np.uint32)
        if lang is not None:
            yield flush()

    return sample.mapInArrow(count, "part int, lang string, counts binary, n long")


def predict(df: DataFrame, model: Model, keep: tuple[Column | str, ...] = (), text_col: str = "text") -> DataFrame:
    """The columns in ``keep``, then lang_pred and score. No shuffle."""
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast((model.languages, zlib.compress(model.masks.tobytes(), 1)))
    kept = df.select(*keep)
    # A text that is kept anyway is not sent twice.
    at = kept.columns.index(text_col) if any(isinstance(c, str) and c == text_col for c in keep) else len(kept.columns)
    rows = kept if at < len(kept.columns) else df.select(*keep, F.col(text_col).cast("string").alias("_text"))
    n = len(kept.columns)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, masks = sent.value
        m = Model(languages, np.frombuffer(zlib.decompress(masks), np.uint64))
        for batch in batches:
            found = [m.judge(t.as_py()) for t in batch.columns[at]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*batch.schema.names[:n], "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "lang_pred string, score double"])
    return rows.mapInArrow(judge, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = residue(F.col("doc_id"), 5) == 0
    model = train(docs.where(~held_out))
    return predict(id_text(spread(docs)).withColumn("held_out", residue(F.col("doc_id"), 5) == 0), model, ("doc_id", "held_out"))
