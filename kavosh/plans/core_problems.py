"""Queries of the general data-preparation operators (problems 1 and 5), with SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavosh.operators.hotkeys import key_profile, third_partners
from kavosh.operators.multivalue import packed_values, split_values
from kavosh.sources.tables import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_values(load(spark, sf_dir, "contacts"))


def p1_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields hold how many values."""
    values = split_values(load(spark, sf_dir, "contacts"))
    return values.filter("pos = 1").groupBy("field", "n").agg(F.count("*").alias("n_fields"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return third_partners(load(spark, sf_dir, "discovered_links"))


def p5_key_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = load(spark, sf_dir, "discovered_links")
    out = key_profile(links, {"target_domain": "source_url", "source_url": "target_url"})
    return out.select("field", "key_value", "n_rows", F.col("n_flagged").alias("n_external"), "first_us", "last_us")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_value_counts": p1_value_counts,
    "p5_found": p5_found,
    "p5_key_profile": p5_key_profile,
}

_PARTNERS = """
  SELECT 'target_domain' AS field, target_domain AS key_value, source_url AS partner, first_seen, id, external FROM discovered_links
  UNION ALL SELECT 'source_url', source_url, target_url, first_seen, id, external FROM discovered_links
"""

ORACLE: dict[str, str] = {
    "p5_found": f"""
WITH x AS ({_PARTNERS}),
f AS (SELECT *, row_number() OVER (PARTITION BY field, key_value, partner ORDER BY first_seen NULLS LAST, id) AS k
      FROM x WHERE key_value IS NOT NULL AND partner IS NOT NULL),
g AS (SELECT field, key_value, id, row_number() OVER (PARTITION BY field, key_value ORDER BY first_seen NULLS LAST, id) AS place
      FROM f WHERE k = 1)
SELECT field, key_value, id FROM g WHERE place = 3""",
    "p5_key_profile": f"""
WITH x AS ({_PARTNERS})
SELECT field, key_value, count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE external)::BIGINT AS n_external,
       epoch_us(min(first_seen::TIMESTAMP))::BIGINT AS first_us, epoch_us(max(first_seen::TIMESTAMP))::BIGINT AS last_us
FROM x WHERE key_value IS NOT NULL GROUP BY 1, 2""",
}
