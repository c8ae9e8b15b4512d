"""Queries that run the streaming operators over ``events`` until they are drained."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagesieve.plans.pages import table
from pagesieve.streaming import streams as st

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def events(spark, d):
    """The events table as a stream: the reader wants the folder, and a filter for the file's name."""
    schema = table(spark, d, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d)
    act = F.when(F.col("event_type") == "click", "llm").when(F.col("event_type") == "purchase", "persist").otherwise("skip")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("host"), act.alias("action"), (F.col("value") / 20).alias("score"), "event_type")


def name():
    return f"s_{uuid.uuid4().hex}"


ACT = "CASE event_type WHEN 'click' THEN 'llm' WHEN 'purchase' THEN 'persist' ELSE 'skip' END"


@query("stream_totals", f"SELECT {ACT} AS action, count(*) AS pages, round(sum(value / 20), 4) AS score_sum FROM events GROUP BY 1")
def stream_totals(spark, d):
    return st.drained(st.running_totals(events(spark, d)), name(), "complete").withColumn("score_sum", F.round("score_sum", 4))


@query("stream_windows", f"SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, {ACT} AS action, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    got = st.drained(st.actions_per_window(events(spark, d), "1 hour"), name(), "complete")
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "action", "n")


@query("stream_first_seen", "SELECT DISTINCT user_id || '/' || event_type AS fp FROM events")
def stream_first_seen(spark, d):
    e = events(spark, d).withColumn("fp", F.concat("host", F.lit("/"), F.col("event_type")))
    return st.drained(st.first_of_fingerprint(e, "60 days"), name()).select("fp")


@query("stream_tokens")
def stream_tokens(spark, d):
    """Which requests a token bucket per host would grant."""
    r = events(spark, d).select("host", F.unix_timestamp("ts").cast("double").alias("at"), (F.col("event_type") == "signup").alias("failed"))
    return st.drained(st.token_buckets(r), name())
