"""The training-text pipeline: filter, dedup, mix and pack ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but
the last return the columns of ``docs``.

* toxicity: documents that the classifier scores 0.5 or more go.
* line_dedup: lines that repeat an earlier line go, short ones if they equal it; a document that is
  left with no line or blank lines alone, goes.
* near_copies: of each component of similar documents, the one with the smallest id stays.
* mixing: documents that the mix does not take go; one that it takes more than once has its
  text that often; one that it takes in part has those words.
* packing: one row per piece of a document, with its sequence and offset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arledger.llm.common import discard, stored_at, table
from arledger.llm.line_dedup import dedup_lines
from arledger.llm.mixing import mixed_texts
from arledger.llm.ngram_join import drop_near_copies
from arledger.llm.packing import pack_documents
from arledger.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs, drop_emptied=True, short_copies=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("mixing", mixing),
    ("packing", packing),
]

#: A trained classifier and a tokenizer are no SQL; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again, and removed once
    the next one has been written."""
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, fresh = stored_at(stage(spark, docs, sf_dir))
        if path is not None:
            discard(spark, path)
        path = fresh
    return STAGES[-1][1](spark, docs, sf_dir)
