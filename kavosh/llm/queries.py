"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavosh.llm import addresses, garble, history, leaks, packing, residue, subjects, survivors
from kavosh.sources.tables import load


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.duplicates_by_batch(history.page_batches(spark, sf_dir))


def p2_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, and pages with numbers, that share most words with one accepted before; two sort orders."""
    return history.near_duplicates_by_batch(history.page_batches(spark, sf_dir, 2))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garble.garbled_fields(load(spark, sf_dir, "contacts")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(load(spark, sf_dir, "contacts"), corpus=load(spark, sf_dir, "documents")).select("id").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.best_rows(load(spark, sf_dir, "contacts"))


def p6_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field by field, the value with most trust- and recency-weighted votes of each site."""
    return survivors.voted(load(spark, sf_dir, "contacts"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return addresses.same_building(load(spark, sf_dir, "contacts"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(load(spark, sf_dir, "documents"), load(spark, sf_dir, "token_budgets"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers each capacity takes and how full they are."""
    filled = p8_containers(spark, sf_dir).groupBy("budget_id").agg(F.count_distinct("container").alias("n_containers"), F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("n_docs"))
    capacity = load(spark, sf_dir, "token_budgets")
    return filled.join(capacity, "budget_id").withColumn("fill", F.round(F.col("tokens") / (F.col("n_containers") * F.col("max_tokens")), 6))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects(load(spark, sf_dir, "documents"), load(spark, sf_dir, "subject_labels")).select("doc_id", "subject")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p2_found": p2_found, "p2_near": p2_near, "p3_found": p3_found, "p4_found": p4_found, "p6_found": p6_found, "p6_survivors": p6_survivors, "p7_found": p7_found, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p10_found": p10_found}

ORACLE: dict[str, str] = {}
