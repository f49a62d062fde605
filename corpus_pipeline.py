"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Toxic documents go; repeated runs of lines lose their later copies; of each group of near copies
(five-word shingles, similarity 0.8 or more) one document stays; what is left is packed into
sequences. Each stage works on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from packetloom.llm import line_runs, packing, simhash, toxicity
from packetloom.llm.io import table, written
from packetloom.llm.queries import vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_runs.cut(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, similarity=0.8, words=5)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The executors' heaps are as large by now as the stages before needed, so the workers keep fewer words.
    return packing.pack(docs, vocabulary(), capacity=2048, end_id=1, memo_words=60_000, at_once=500)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("near dedup", without_near_copies),
    ("packing", packed),
]

#: Classifiers, fingerprints and encodings are not SQL: the tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
