"""Sinks: raw pages, excerpts, breadcrumbs, telemetry, snapshots, cluster and topic tables.

All are Spark writers, so a failed job leaves no half-written result. Illegal pages must be filtered before a sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.operators.pages import sanitized


def raw_pages(pages: DataFrame, path: str, enabled: bool = False) -> bool:
    """Raw html by shard (two digits of the hash) and time; off unless asked for. Reads url_hash, fetched_at, html, headers."""
    if not enabled:
        return False
    name = F.concat(F.date_format("fetched_at", "yyyyMMdd'T'HHmmss"), F.lit("_"), F.col("url_hash"))
    pages.withColumns({"shard": F.substring("url_hash", 1, 2), "name": name}).write.mode("append").partitionBy("shard").parquet(path)
    return True


def excerpts(observations: DataFrame, path: str, max_chars: int = 5000) -> None:
    sanitized(observations, max_chars).write.mode("append").json(path)


def breadcrumbs(crumbs: DataFrame, path: str) -> None:
    """JSON lines in a folder for each UTC day."""
    crumbs.withColumn("observed_date", F.date_format("observed_at", "yyyy-MM-dd")).write.mode("append").partitionBy("observed_date").json(path)


def telemetry(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def snapshot(df: DataFrame, path: str, form: str = "parquet") -> None:
    """A state table in place of the one before (frontier, failures, blocks, graph, metrics, vectors)."""
    df.write.mode("overwrite").format(form).save(path)


def link_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as one node-link JSON object, which ``files.link_graph`` reads; for graphs that one row can hold.

    ``nodes`` has node and attributes (a map of strings), ``edges`` src, dst, weight, last_seen, anchor_texts and rel.
    Larger graphs go to ``snapshot`` as two tables.
    """
    n = nodes.select(F.map_concat(F.create_map(F.lit("id"), F.col("node").cast("string")), "attributes").alias("n")).agg(F.collect_list("n").alias("nodes"))
    e = edges.select(F.struct(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), F.col("weight").cast("double").alias("weight"), F.col("last_seen").cast("string").alias("last_seen"), "anchor_texts", "rel").alias("e")).agg(F.collect_list("e").alias("links"))
    whole = n.join(F.broadcast(e)).select(F.to_json(F.struct(F.lit(True).alias("directed"), F.lit(False).alias("multigraph"), "nodes", "links")).alias("value"))
    whole.coalesce(1).write.mode("overwrite").text(path)


def frontier_state(jobs: DataFrame, seen: DataFrame, path: str) -> None:
    """A frontier as one JSON object, which ``files.frontier_state`` reads; for frontiers that one row can hold."""
    j = jobs.agg(F.collect_list(F.struct(*jobs.columns)).alias("jobs"))
    s = seen.select("url").distinct().agg(F.array_sort(F.collect_list("url")).alias("seen"))
    j.join(F.broadcast(s)).select(F.to_json(F.struct("jobs", "seen")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def swapped(df: DataFrame, path: str, form: str = "parquet") -> bool:
    """A snapshot written beside the one before and moved into its place, if it differs from it; says whether it did.

    Readers see the old or the new snapshot, never a part of one.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at, new, old = hadoop(path), hadoop(f"{path}.new"), hadoop(f"{path}.old")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at):
        before = spark.read.schema(df.schema).format(form).load(path)
        keys = lambda x: x.select(F.to_json(F.struct(*df.columns)).alias("row"))
        if not keys(df).exceptAll(keys(before)).limit(1).count() and not keys(before).exceptAll(keys(df)).limit(1).count():
            return False
    df.write.mode("overwrite").format(form).save(f"{path}.new")
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)
    return True


def fetched_page(pages: DataFrame, decided: DataFrame, raw: str, excerpt: str, enabled: bool = False, call=None) -> DataFrame:
    """Record fetched pages (raw, only if enabled) and hand the scored ones to triage; returns the findings.

    ``decided`` are the observations with their decisions; every one's excerpt is written, also of skipped pages.
    """
    from pagesieve.operators.triage import triaged

    raw_pages(pages, raw, enabled)
    excerpts(decided, excerpt)
    return triaged(decided, call)


def table_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def summaries(topics: DataFrame, path: str) -> None:
    topics.write.mode("overwrite").json(path)
