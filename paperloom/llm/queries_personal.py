"""Queries over personal information in emails and entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.personal import Lexicon, gather_names, mentions
from paperloom.plans.registry import Registry
from paperloom.session import table

REGISTRY = Registry()


def _lexicon(spark: SparkSession, sf_dir: str, texts: DataFrame) -> Lexicon:
    senders = table(spark, sf_dir, "emails").select(F.explode("from_addrs").alias("_name"))
    people = table(spark, sf_dir, "people").select(F.col("person_name").alias("_name"))
    return gather_names(senders.unionByName(people), texts.where("field <> 'from_addrs'").select(F.col("text").alias("_text")))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    emails, entries = table(spark, sf_dir, "emails"), table(spark, sf_dir, "entries")
    part = lambda df, name, key, field, text: df.select(F.lit(name).alias("src_table"), F.col(key).alias("row_id"), F.lit(field).alias("field"), text.alias("text"))
    every = part(emails, "emails", "email_id", "body", F.col("body")).unionByName(part(emails, "emails", "email_id", "from_addrs", F.array_join("from_addrs", ", ")))
    every = every.unionByName(part(entries, "entries", "entry_id", "text", F.col("text")))
    return mentions(every, [F.col("src_table"), F.col("row_id"), F.col("field")], F.col("text"), _lexicon(spark, sf_dir, every))


@REGISTRY.add("p3_found")
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mention of a person, an address, a number or an account, at its first character."""
    span = F.explode("spans").alias("s")
    return _mentions(spark, sf_dir).select("src_table", "row_id", "field", span).select("src_table", "row_id", "field", "s.pii_kind", "s.start_pos")


@REGISTRY.add("p3_masked")
def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts with each mention replaced by its placeholder."""
    return _mentions(spark, sf_dir).select("src_table", "row_id", "field", "masked_text")
