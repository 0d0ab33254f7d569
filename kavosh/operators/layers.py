"""Breadth-first layers over the link graph, and batches of one layer at a time."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kavosh.sources.tables import keep


def layers(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(url, depth): everything within ``depth`` links of the seeds, or everything they lead to, at its least depth.

    One join per layer over an edge table written once; a layer is anti-joined with what was
    reached before and stored, so the plan doesn't grow with the depth and cycles end it.
    ``edges``: source_url, target_url. ``seeds``: url.
    """
    pairs = keep(edges.select("source_url", "target_url").filter("target_url is not null").distinct(), "edges")
    reached = keep(seeds.select("url").filter("url is not null").distinct().withColumn("depth", F.lit(0)), "layer-0")
    frontier = reached
    for d in count(1) if depth is None else range(1, depth + 1):
        found = pairs.join(frontier.select(F.col("url").alias("source_url")), "source_url", "left_semi").select(F.col("target_url").alias("url")).distinct()
        frontier = keep(found.join(reached, "url", "left_anti").withColumn("depth", F.lit(d)), f"layer-{d}")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def lowest_open_layer(state: DataFrame) -> DataFrame:
    """Pending rows of each seed's lowest unfinished layer; none while that layer still has queued rows' peers above it.

    ``state``: seed_url, url, depth, status. Only rows at the least depth that has pending or
    queued rows are returned, and of these the pending ones.
    """
    open_ = F.min(F.when(F.col("status").isin("pending", "queued"), F.col("depth"))).over(Window.partitionBy("seed_url"))
    return state.withColumn("open_depth", open_).filter("depth = open_depth and status = 'pending'").drop("open_depth")


def finished_depth(state: DataFrame) -> DataFrame:
    """(seed_url, depth): the least crawled depth of each seed with nothing unfinished at or below it."""
    by = state.groupBy("seed_url").agg(F.min(F.when(F.col("status") == "crawled", F.col("depth"))).alias("depth"), F.min(F.when(F.col("status").isin("pending", "queued"), F.col("depth"))).alias("open"))
    return by.filter("depth is not null and (open is null or open > depth)").select("seed_url", "depth")


def reconciled(queued: DataFrame, active: DataFrame, crawled: DataFrame) -> DataFrame:
    """Queued rows that nobody works on: crawled if the URL is known as such, else pending again."""
    lost = queued.join(active.select("url").distinct(), "url", "left_anti")
    done = crawled.select("url").distinct().withColumn("done", F.lit(True))
    return lost.join(done, "url", "left").withColumn("status", F.when(F.col("done"), "crawled").otherwise("pending")).drop("done")
