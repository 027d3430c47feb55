"""Queries over the text of scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.scans import repaired
from paperloom.plans.registry import Registry
from paperloom.session import table

REGISTRY = Registry()


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "entries").where("kind = 'ocr'"), "entry_id", "text", "source_id", "page_first")


@REGISTRY.add("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divided and misread words, running heads and page numbers of scanned pages."""
    return _pages(spark, sf_dir).select("entry_id", F.inline("noise"))


@REGISTRY.add("p6_texts")
def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned pages as readable paragraphs."""
    return _pages(spark, sf_dir).select("entry_id", "clean_text")
