"""Queries over what the senders of emails wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.mail import layout, newly_written
from paperloom.plans.registry import Registry
from paperloom.session import table

REGISTRY = Registry()


@REGISTRY.add("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that aren't newly written: quotations and what introduces them, signatures, legal notices."""
    read = newly_written(table(spark, sf_dir, "emails"), "email_id", "body")
    return read.select("email_id", F.explode("other_lines").alias("line_no"))


@REGISTRY.add("p5_texts")
def p5_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newly written text of each message."""
    return newly_written(table(spark, sf_dir, "emails"), "email_id", "body").select("email_id", "new_text")


@REGISTRY.add("p5_nodes")
def p5_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout tree of each message, enclosed bodies included."""
    return layout(table(spark, sf_dir, "emails"), "email_id", "body")
