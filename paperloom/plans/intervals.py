"""Queries over the sightings' clocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.intervals import periods_and_gaps, seconds_to_ms
from paperloom.plans.registry import Registry
from paperloom.session import table

REGISTRY = Registry()


@REGISTRY.add(
    "p4_found",
    sql="""
    WITH r AS (
      SELECT person_id, source_path, CAST(round(start_seconds * 1000) AS BIGINT) AS s, CAST(round(end_seconds * 1000) AS BIGINT) AS e
      FROM sightings
      WHERE start_seconds IS NOT NULL AND end_seconds IS NOT NULL AND NOT isnan(start_seconds) AND NOT isnan(end_seconds)
        AND end_seconds >= start_seconds
    ), m AS (
      SELECT *, max(e) OVER (PARTITION BY person_id, source_path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r
    ), i AS (
      SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END)
        OVER (PARTITION BY person_id, source_path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m
    ), p AS (
      SELECT person_id, source_path, min(s) AS start_ms, max(e) AS end_ms FROM i GROUP BY person_id, source_path, island
    ), g AS (
      SELECT person_id, source_path, end_ms AS start_ms,
        lead(start_ms) OVER (PARTITION BY person_id, source_path ORDER BY start_ms) AS end_ms FROM p
    )
    SELECT person_id, source_path, 'period' AS span_kind, start_ms, end_ms FROM p
    UNION ALL
    SELECT person_id, source_path, 'gap', start_ms, end_ms FROM g WHERE end_ms IS NOT NULL
    """,
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each continuous period and each gap of a person on a recording, in milliseconds."""
    seen = table(spark, sf_dir, "sightings")
    spans = periods_and_gaps(seen, ["person_id", "source_path"], seconds_to_ms(F.col("start_seconds")), seconds_to_ms(F.col("end_seconds")))
    return spans.withColumnsRenamed({"start_unit": "start_ms", "end_unit": "end_ms"})
