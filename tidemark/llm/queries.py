"""The queries on documents, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import languages, leaks, mixing
from tidemark.scale import spread
from tidemark.sources.tables import load


def p6_found(spark: SparkSession, at: str) -> DataFrame:
    """Documents that repeat a passage of a test item, and the items."""
    documents = spread(load(spark, at, "documents", "doc_id", "text"), "doc_id")
    return leaks.leaked_items(documents, load(spark, at, "eval_items", "item_id", "text")).select("doc_id", "item_id")


def p7_mix(spark: SparkSession, at: str) -> DataFrame:
    """The documents of the mix in training order, each with its source, its repeat, its tokens and its position."""
    documents = spread(load(spark, at, "documents", "doc_id", "text", "source"), "doc_id")
    return mixing.mix(documents, load(spark, at, "source_targets"))


def p7_shares(spark: SparkSession, at: str) -> DataFrame:
    """The share of each source in the mix and its target."""
    documents = spread(load(spark, at, "documents", "doc_id", "text", "source"), "doc_id")
    return mixing.actual_shares(documents, load(spark, at, "source_targets"))


def _languages(spark: SparkSession, at: str, detail: bool) -> DataFrame:
    documents = load(spark, at, "documents", "doc_id", "text", "lang").where("doc_id IS NOT NULL")
    model = languages.fit_documents(documents)
    return languages.document_passages(spread(documents, "doc_id"), model, keep=("lang",), detail=detail)


def p8_found(spark: SparkSession, at: str) -> DataFrame:
    """The languages of documents whose label is missing, wrong, or one of several."""
    found = F.map_keys("languages")
    wrong = (F.size(found) > 1) | ~F.coalesce(F.array_contains(found, languages.label_language(F.col("lang"))), F.lit(False))
    return _languages(spark, at, False).where(wrong).select("doc_id", F.explode(found).alias("found_lang")).distinct()


def p8_passages(spark: SparkSession, at: str) -> DataFrame:
    """Every passage of every document with its language and confidence; start and end count characters."""
    return _languages(spark, at, True).select("doc_id", F.explode("passages").alias("p")).select(
        "doc_id", F.col("p.start").alias("start"), F.col("p.end").alias("end"), F.col("p.language").alias("found_lang"), F.round("p.confidence", 4).alias("confidence")
    )


QUERIES = {"p6_found": p6_found, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_passages": p8_passages}

ORACLES: dict[str, str] = {}
