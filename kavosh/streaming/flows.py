"""The batch operators on streams: contact intake, link figures, and per-URL state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kavosh.sources.sinks import append_new


def files(spark: SparkSession, folder: str, like: DataFrame, per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def intake(stream: DataFrame, target: str, checkpoint: str, keys: tuple[str, ...] = ("source_url", "phones"), order: str = "id", every: str | None = None) -> StreamingQuery:
    """Insert-or-ignore each micro-batch into a table; ``every`` repeats on an interval, else what is there is taken once."""
    writer = stream.writeStream.foreachBatch(lambda df, _: append_new(target, df, keys, order)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed_counts(stream: DataFrame, time_col: str, key: str, length: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Rows per key and time window, late rows admitted up to a watermark."""
    return stream.withWatermark(time_col, lateness).groupBy(F.window(time_col, length).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def first_seen(stream: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first, n) of each key, kept as state across micro-batches: Arrow batches per key, state of two numbers."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, n = state.get if state.exists else (None, 0)
        for pdf in batches:
            low = int(pdf[order].min())
            first, n = low if first is None else min(first, low), n + len(pdf)
        state.update((first, n))
        yield pd.DataFrame({"key": [k[0]], "first": [first], "n": [n]})

    narrow = stream.select(F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias(order)).filter("key is not null")
    return narrow.groupBy("key").applyInPandasWithState(step, "key string, first bigint, n bigint", "first bigint, n bigint", "update", GroupStateTimeout.NoTimeout)


_STATE = "domain string, status string, source_url string, first_seen string, crawled_at string, failure_reason string, cycle bigint, reserved boolean"
_OUT = "url string, domain string, status string, source_url string, first_seen string, crawled_at string, failure_reason string, cycle bigint"


class UrlState(StatefulProcessor):
    """The state of one URL under a stream of operations (see ``operators.frontier``).

    A new cycle reaches no single URL, so operations carry the number of the cycle they belong to: what failed in an earlier one may be
    tried again. State never expires.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("url", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _STATE.split(", ")]
        now = dict(zip(names, self.state.get())) if self.state.exists() else None
        for r in pd.concat(list(rows)).sort_values("seq").to_dict("records"):
            r = {k: None if pd.isna(v) else v for k, v in r.items()}
            if now and now["status"] == "failed" and r["cycle"] > now["cycle"]:
                now["status"] = "retry_pending"
            if r["op"] == "reserve_seed" or (r["op"] == "reserve" and now is None):
                now = {"domain": r["domain"], "status": "queued", "source_url": r["source_url"], "first_seen": r["at"], "crawled_at": None, "failure_reason": now["failure_reason"] if now else None, "reserved": True}
            elif now and r["op"] == "crawled":
                now |= {"status": "crawled", "crawled_at": r["at"], "failure_reason": None}
            elif now and r["op"] == "failed":
                now |= {"status": "failed", "failure_reason": (r["reason"] or "").strip() or None}
            if now:
                now["cycle"] = int(r["cycle"])
        if now:
            self.state.update(tuple(now[n] for n in names))
            yield pd.DataFrame([{"url": key[0], **{n: now[n] for n in names if n != "reserved"}}], columns=[c.split()[0] for c in _OUT.split(", ")])

    def close(self) -> None:
        pass


def url_states(ops: DataFrame) -> DataFrame:
    """The state of each URL of a stream of operations(seq, cycle, op, url, domain, source_url, reason, at), whenever it changes.

    Needs a state store that holds several variables: spark.sql.streaming.stateStore.providerClass of RocksDB.
    """
    narrow = ops.select(F.col("seq").cast("bigint"), F.col("cycle").cast("bigint"), *[F.col(c).cast("string") for c in ("op", "url", "domain", "source_url", "reason", "at")]).filter("url is not null")
    return narrow.groupBy("url").transformWithStateInPandas(UrlState(), T.StructType.fromDDL(_OUT), "Update", "None")
