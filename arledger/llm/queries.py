"""Registered queries of the operators and the pipeline, with their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arledger.llm import sql
from arledger.llm.common import table
from arledger.llm.fill_middle import fill_middle_digest
from arledger.llm.language import language_digest
from arledger.llm.line_dedup import line_dedup_digest
from arledger.llm.mixing import mix_sources
from arledger.llm.ngram_join import ngram_components
from arledger.llm.packing import pack_documents
from arledger.llm.pii import pii_digest
from arledger.llm.quality import quality_digest
from arledger.llm.quality_model import quality_model_digest
from arledger.llm.suffix_dedup import repeats_digest
from arledger.llm.topk import top_products
from arledger.llm.toxicity import toxicity_digest
from arledger.llm.vector_codes import vector_code_digest

Query = Callable[[SparkSession, str], DataFrame]


def _over_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


def _vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_code_digest(table(spark, sf_dir, "embeddings"))


REGISTRY: dict[str, tuple[Query, str | None]] = {
    "op1_line_dedup": (_over_documents(line_dedup_digest), sql.LINE_DEDUP),
    "op2_toxicity": (_toxicity, None),
    "op3_mix_sources": (_over_documents(mix_sources), None),
    "op4_ngram_join": (_over_documents(ngram_components), sql.NGRAM_JOIN),
    "op5_quality_rules": (_over_documents(quality_digest), sql.QUALITY),
    "op6_pii": (_over_documents(pii_digest), None),
    "op7_packing": (_over_documents(pack_documents), None),
    "op8_topk": (_topk, sql.TOP_K),
    "op9_suffix_dedup": (_over_documents(repeats_digest), None),
    "op10_language": (_over_documents(language_digest), None),
    "op11_fill_middle": (_over_documents(fill_middle_digest), sql.FILL_MIDDLE),
    "op12_vector_codes": (_vector_codes, sql.VECTOR_CODES),
    "op13_quality_model": (_quality_model, None),
}
