"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagesieve.config import FrontierSettings
from pagesieve.storage import shared_root


def actions_per_window(events: DataFrame, width: str = "1 minute", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts per (sliding) window and action of events (ts, action), with a watermark for late ones."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "action").agg(F.count("*").alias("n")).select("w.start", "w.end", "action", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Session windows per host."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "host").agg(F.count("*").alias("n")).select("w.start", "w.end", "host", "n")


def running_totals(events: DataFrame) -> DataFrame:
    """Cumulative counters (complete or update mode)."""
    return events.groupBy("action").agg(F.count("*").alias("pages"), F.sum("score").alias("score_sum"))


def first_of_fingerprint(pages: DataFrame, late: str = "1 day") -> DataFrame:
    """Pages (ts, fp) whose fingerprint wasn't seen within the watermark."""
    return pages.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fp"])


def token_buckets(requests: DataFrame, s: FrontierSettings = FrontierSettings()) -> DataFrame:
    """Requests (host, at in seconds, failed) with granted: a token bucket and a backoff after failures for each host.

    A host's requests of a batch are taken in order of time; state is (tokens, updated, backoff).
    State is three numbers a host and is kept as long as the stream.
    """
    capacity, refill, cooldown = s.host_token_capacity, s.host_refill_seconds, s.failure_cooldown_seconds

    def step(key, frames: Iterator, state: GroupState):
        import pandas as pd

        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        tokens, updated, backoff = state.get if state.exists else (capacity, float(rows["at"].iloc[0]), 0.0)
        granted = []
        for at, failed in zip(rows["at"], rows["failed"]):
            if backoff > at:
                tokens = 0.0
            else:
                tokens = capacity if refill <= 0 else min(capacity, tokens + max(0.0, at - updated) / refill)
            updated = at
            ok = tokens >= 1.0
            if ok:
                tokens -= 1.0
            granted.append(ok)
            if failed:
                backoff, tokens = max(backoff, at + cooldown), 0.0
        state.update((tokens, updated, backoff))
        yield pd.DataFrame({"host": key[0], "at": rows["at"].to_numpy(), "granted": granted})

    return requests.groupBy("host").applyInPandasWithState(step, "host string, at double, granted boolean", "tokens double, updated double, backoff double", "append", GroupStateTimeout.NoTimeout)


def failure_cache(failures: DataFrame, expiry: str = "7 days") -> DataFrame:
    """Failures (ts, url, status) as entries with count, first and last time; state older than the expiry goes with the watermark."""
    return failures.withWatermark("ts", expiry).groupBy(F.session_window("ts", expiry).alias("w"), "url").agg(F.count("*").alias("count"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max_by("status", "ts").alias("status")).select("url", "count", "first", "last", "status")


def drained(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Run a stream over all that is available into a table in the shared folder; returns the table.

    In complete mode each batch's snapshot takes the place of the one before. With ``checkpoint`` and ``path`` of an
    earlier run the stream goes on where that one ended.
    """
    spark = df.sparkSession
    root = f"{shared_root(spark)}/{name}"
    path, checkpoint = path or f"{root}/table", checkpoint or f"{root}/checkpoint"
    w = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        w = w.format("parquet").option("path", path)
    else:
        spark.createDataFrame([], df.schema).write.mode("ignore").parquet(path)
        w = w.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    q = w.start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(df.schema).parquet(path)
