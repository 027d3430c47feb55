"""Queries over oversized chunks and entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.splitting import pieces
from paperloom.plans.registry import Registry
from paperloom.session import table

REGISTRY = Registry()


def _largest(pieces: str) -> str:
    return rf"list_max(list_transform({pieces}, lambda s: octet_length(encode(regexp_replace(s, '^\s+|\s+$', '', 'g')))))"


_LEVELS = rf"""
    WITH t AS (SELECT 'chunks' AS item_table, chunk_id AS item_id, text FROM chunks UNION ALL SELECT 'entries', entry_id, text FROM entries),
    m AS (SELECT item_table, item_id, text, regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g') AS marked FROM t WHERE octet_length(encode(text)) > 4096)
    SELECT item_table, item_id, CASE
      WHEN {_largest(r"regexp_split_to_array(text, '\f|\n[ \t\r]*\n')")} <= 4096 THEN 'paragraph'
      WHEN {_largest(r"regexp_split_to_array(text, '[\f\n]')")} <= 4096 THEN 'line'
      WHEN {_largest(r"regexp_split_to_array(marked, '[\f\n' || chr(1) || ']')")} <= 4096 THEN 'sentence'
      WHEN {_largest(r"regexp_split_to_array(text, '\s+')")} <= 4096 THEN 'word' ELSE 'char' END AS cut_level FROM m
"""


@REGISTRY.add("p2_pieces")
def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each oversized text of both tables."""
    chunks = pieces(table(spark, sf_dir, "chunks"), "chunk_id", "text", F.col("pages.page_first"), F.col("pages.page_last"))
    entries = pieces(table(spark, sf_dir, "entries"), "entry_id", "text")
    named = [df.withColumnRenamed(key, "item_id").withColumn("item_table", F.lit(name)) for df, key, name in ((chunks, "chunk_id", "chunks"), (entries, "entry_id", "entries"))]
    return named[0].unionByName(named[1])


@REGISTRY.add("p2_found", sql=_LEVELS)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each oversized text with the level at which it can be cut, as its first piece tells."""
    return p2_pieces(spark, sf_dir).where("piece_no = 1").select("item_table", "item_id", "cut_level")


@REGISTRY.add(
    "p2_rejoined",
    sql="""
    SELECT 'chunks' AS item_table, chunk_id AS item_id, md5(text) AS digest, true AS fits FROM chunks WHERE octet_length(encode(text)) > 4096
    UNION ALL SELECT 'entries', entry_id, md5(text), true FROM entries WHERE octet_length(encode(text)) > 4096
    """,
)
def p2_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each text joined again without their overlaps, and whether all are within the limit and overlap by 300 characters at most."""
    own = p2_pieces(spark, sf_dir)
    parts = own.groupBy("item_table", "item_id").agg(
        F.array_sort(F.collect_list(F.struct("piece_no", F.expr("substring(text, overlap_chars + 1)").alias("new")))).alias("parts"),
        F.bool_and((F.octet_length("text") <= 4096) & (F.col("overlap_chars") <= 300)).alias("fits"),
    )  # one row per text, of its own pieces
    return parts.select("item_table", "item_id", F.md5(F.array_join(F.col("parts.new"), "")).alias("digest"), "fits")
