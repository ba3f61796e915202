"""The corpus pipeline: stages over documents, each given all that the one before it kept.

Language identification rejects documents without a letter and those whose text
no language explains; of each group of near copies the document with the least
id stays; documents that hold benchmark questions go; the rest is packed into
sequences.

Every stage takes nulls, empty and very long texts, repeated rows, empty tables
and extra columns. A null or empty text is rejected by the first stage. Rows
without an id are never taken for copies. Rows that share an id are one document
for the second stage; they stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded, spread
from tidemark.llm.decontamination import contaminated, row_key
from tidemark.llm.language_id import predict, train
from tidemark.llm.near_dedup import near_groups
from tidemark.llm.packing import pack
from tidemark.runtime import Scratch, materialise

#: The least share of a text's n-grams that its language must explain.
LEAST_SCORE = 0.2
#: Percent of shingles that near copies share at least.
SIMILAR = 80


def renamed(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named by their places, so that none is called like one of an operator's."""
    return docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))


def column(docs: DataFrame, name: str) -> str:
    return f"_{docs.columns.index(name)}"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = renamed(docs)
    judged = predict(own, train(docs), tuple(own.columns), column(docs, "text"))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*own.columns).toDF(*docs.columns)


def without(docs: DataFrame, key, gone: DataFrame) -> DataFrame:
    """The rows of ``renamed(docs)`` whose ``key`` is not in the one column of ``gone``, under the names of ``docs``."""
    return renamed(docs).join(bounded(gone.toDF("gone")), key == F.col("gone"), "left_anti").toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = materialise(near_groups(docs, SIMILAR).where("not kept").select("doc_id").distinct(), "copies")
    return without(docs, F.col(column(docs, "doc_id")), gone)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    gone = materialise(contaminated(docs, items).select("row_key").distinct(), "leaks")
    return without(docs, row_key(F.col(column(docs, "doc_id")), F.col(column(docs, "text"))), gone)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("packing", packing)]
#: The stages learn, link and tokenize, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what lies between them is deleted at the end."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        return scratch.result(STAGES[-1][1](spark, docs, sf_dir), "packed")
