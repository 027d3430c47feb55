"""Queries over the training mix of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.mixing import mix
from paperloom.plans.registry import Registry
from paperloom.session import table

REGISTRY = Registry()


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "text", "source")


@REGISTRY.add("p8_mix")
def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, with how often each is used."""
    return _mix(spark, sf_dir)[0]


@REGISTRY.add("p8_shares")
def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of the total size, per source."""
    return _mix(spark, sf_dir)[1]
