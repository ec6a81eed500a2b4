"""Cleaning pipeline over documents: language, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept. All but the last keep the columns of
documents as they are, whatever others there are. In every stage a null text counts as an empty one, a null doc_id is an id that
comes last, repeated rows are rows of their own, and an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import langid
from harrow.llm.common import fresh, shared_dir
from harrow.llm.dedup import drop_exact_duplicates
from harrow.llm.packing import pack
from harrow.llm.simhash import drop_near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, in one language or several; the model is learned from the table's own labels.

    Null, empty and letterless texts go. Without any label no language is known, and all documents go.
    """
    into = fresh(docs, "__language")
    labelled = langid.identify(docs, langid.train(docs), into)
    return labelled.where(F.col(f"{into}.lang_pred") != langid.UNKNOWN).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts but for white space: the longest, then the smallest doc_id, then the first row."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over five-word shingles: the smallest doc_id, then the
    first row. SimHash and its distance table find most links; all pairs that they could miss are compared too."""
    return drop_near_duplicates(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 tokens; an empty text is its end token."""
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: Language spans, similarity groups and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result but the last is written as Parquet and read again."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
