"""Queries over evaluation items in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.leakage import leaked_items, leaks, question_classes, renamed
from paperloom.plans.registry import Registry
from paperloom.session import table

REGISTRY = Registry()

_PASSAGES = r"""
    WITH d AS (
      SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM (
        SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (
          SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS ws FROM documents))
    ), e AS (
      SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS pos FROM (
        SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS ws FROM eval_items) WHERE len(ws) >= 12
    ), dw AS (
      SELECT doc_id, pos, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS win,
        count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS n FROM d
    ), ew AS (SELECT DISTINCT item_id, array_to_string(ws[pos:pos + 11], ' ') AS win FROM e),
    met AS (SELECT DISTINCT doc_id, item_id, pos FROM dw JOIN ew USING (win) WHERE n = 12)
"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple:
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text"


@REGISTRY.add("p7_found", sql=_PASSAGES + "SELECT DISTINCT doc_id, item_id FROM met")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain at least twelve consecutive words of an item."""
    return leaks(*_tables(spark, sf_dir)).select("doc_id", "item_id")


@REGISTRY.add("p7_items", sql=_PASSAGES + "SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM met GROUP BY item_id")
def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that leaked, with the number of documents that hold a passage of them."""
    return leaked_items(leaks(*_tables(spark, sf_dir)), "item_id").select("item_id", "n_docs")


@REGISTRY.add("p7_renamed")
def p7_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that ask a class of items' question with other names or numbers and hold the words of none."""
    return renamed(*_tables(spark, sf_dir))


@REGISTRY.add("p7_classes")
def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of each class of question windows."""
    return question_classes(table(spark, sf_dir, "eval_items"), "item_id", "text")
