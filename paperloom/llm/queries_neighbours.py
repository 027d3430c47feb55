"""Queries over the vectors of units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm.neighbours import nearest, pairs
from paperloom.plans.registry import Registry
from paperloom.session import table

REGISTRY = Registry()


_BRUTE = """
    WITH e AS (SELECT vec_id, model, dim, CAST(vector AS DOUBLE[]) AS v FROM unit_embeddings WHERE vector IS NOT NULL AND len(vector) = dim
      AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
    s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM e a JOIN e b ON a.model IS NOT DISTINCT FROM b.model AND a.dim = b.dim AND a.vec_id <> b.vec_id),
    t AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY CAST(sim AS FLOAT) DESC, b) AS place FROM s)
    SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM t WHERE place <= 5 AND CAST(sim AS FLOAT) >= CAST(0.9 AS FLOAT)
"""


@REGISTRY.add("p1_found", sql=_BRUTE)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of similarity 0.9 and more of which one is among the other's five most similar."""
    found = nearest(table(spark, sf_dir, "unit_embeddings"), "vec_id", "vector", "model", "dim", k=5, least=0.9, recall=0.999)
    return pairs(found).where("similarity >= 0.9").select("vec_id_a", "vec_id_b")


@REGISTRY.add("p1_neighbours")
def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar rows of every usable vector."""
    found = nearest(table(spark, sf_dir, "unit_embeddings"), "vec_id", "vector", "model", "dim", k=5, recall=0.95)
    return found.toDF("vec_id", "neighbour_id", "similarity", "place")
