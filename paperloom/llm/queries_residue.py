"""Queries over template residue and error-page text in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.residue import judged
from paperloom.plans.registry import Registry
from paperloom.session import table

REGISTRY = Registry()


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


@REGISTRY.add("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold residue, filler, an error message or a script notice."""
    return _judged(spark, sf_dir).where(F.size("evidence") > 0).select("doc_id")


@REGISTRY.add("p9_kinds")
def p9_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each such document with the kind of its evidence."""
    return _judged(spark, sf_dir).select("doc_id", F.explode("evidence").alias("evidence_kind"))


@REGISTRY.add("p9_kept")
def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The remaining documents, whole."""
    docs = table(spark, sf_dir, "documents")
    return docs.join(p9_found(spark, sf_dir), "doc_id", "left_anti")
