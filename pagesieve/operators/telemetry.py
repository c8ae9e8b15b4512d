"""Telemetry operators: counters, ratios, timing, cost, running values, histories, runs and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summary(events: DataFrame) -> DataFrame:
    """One row over events (at, action, score, bytes, duration_ms, illegal): the run's counters and derived ratios.

    Fetch duration and KiB are divided by pages, as the definitions want; a request is an event with a duration. Where
    there are columns ``finding`` and ``error``, a finding counts as a call of the model and an error as an error.
    """
    n = F.count("*")
    called = F.col("action") == "llm"
    if "finding" in events.columns:
        called = called | F.col("finding").isNotNull()
    errors = F.count("error") if "error" in events.columns else F.lit(0).cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = events.agg(
        n.alias("pages"), F.count_if(F.col("action") == "skip").alias("skip"), F.count_if(F.col("action") == "persist").alias("persist"), F.count_if(F.col("action") == "llm").alias("llm"), F.count_if("illegal").alias("illegal_skipped"), F.count("duration_ms").alias("requests"), F.count_if(called).alias("llm_calls"), errors.alias("errors"),
        total("score").alias("score_sum"), total("bytes").alias("bytes"), total("duration_ms").alias("duration_ms"), F.min("at").alias("first"), F.max("at").alias("last"),
    )
    seconds = F.unix_timestamp(F.col("last").cast("timestamp")) - F.unix_timestamp(F.col("first").cast("timestamp"))
    per = lambda x: F.try_divide(x, F.nullif("pages", F.lit(0)))
    return counts.select(
        "pages", "skip", "persist", "llm", "illegal_skipped", "requests", "llm_calls", "errors", F.round(per(F.col("score_sum")), 4).alias("average_score"), F.round(per(F.col("persist") + F.col("llm")), 4).alias("odd_hit_ratio"),
        F.round(per(F.col("duration_ms")), 4).alias("average_fetch_ms"), F.round(per(F.col("bytes") / 1024), 4).alias("kib_per_page"), F.round(F.col("bytes") / (1024 * 1024), 4).alias("mib"),
        seconds.cast("long").alias("elapsed_seconds"), F.round(F.try_divide(F.col("pages") * 3600.0, F.nullif(seconds, F.lit(0))), 4).alias("pages_per_hour"), F.round(F.try_divide(F.col("pages") * 60.0, F.nullif(seconds, F.lit(0))), 4).alias("pages_per_minute"),
    )


def hourly_cap(metrics: DataFrame) -> DataFrame:
    """How often the hourly cap was met and the last wait for it, of saved metrics; zeros where they are missing."""
    have = set(metrics.columns)
    pick = lambda c, zero: (F.coalesce(F.col(c), F.lit(zero)) if c in have else F.lit(zero))
    return metrics.select(pick("llm_hourly_cap_hits", 0).alias("cap_hits"), pick("last_llm_hourly_wait_seconds", 0.0).alias("last_wait_seconds"))


def top(events: DataFrame, column: str, k: int = 10, order: str | None = None) -> DataFrame:
    """The k most frequent values; ties by the first ``order`` at which a value is seen, if it is given, then by value."""
    found = events.groupBy(column).agg(F.count("*").alias("n"), *([F.min(order).alias("__first")] if order else []))
    return found.orderBy(F.desc("n"), *(["__first"] if order else []), column).limit(k).select(column, "n")


def running(events: DataFrame, key: str) -> DataFrame:
    """Counters after every event (at, id) of a key: pages, odd hits and their ratio so far."""
    w = Window.partitionBy(key).orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    odd = F.sum(F.when(F.col("action").isin("persist", "llm"), 1).otherwise(0)).over(w)
    pages = F.count("*").over(w)
    return events.withColumns({"pages": pages, "odd": odd, "odd_ratio": F.round(odd / pages, 4)})


def last_n(events: DataFrame, key: str, n: int) -> DataFrame:
    """The last n values of a key, newest first."""
    w = Window.partitionBy(key).orderBy(F.desc("at"), F.desc("id"))
    kept = events.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("history"))


def checkpoints(events: DataFrame, key: str, every: int) -> DataFrame:
    """Which checkpoint covers each event of a key."""
    return events.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy("at", "id")) - 1) / every).cast("long"))


def runs(summaries: DataFrame, metrics: DataFrame, active: DataFrame) -> DataFrame:
    """Run rows from summary, metrics and active lists (run_id, pages, updated): the first value that is there wins."""
    j = summaries.alias("s").join(metrics.alias("m"), "run_id", "full_outer").join(active.alias("a"), "run_id", "full_outer")
    pick = lambda c: F.coalesce(F.when(F.col(f"s.{c}").cast("string") != "", F.col(f"s.{c}")), F.when(F.col(f"m.{c}").cast("string") != "", F.col(f"m.{c}")), F.col(f"a.{c}"))
    return j.select("run_id", pick("pages").alias("pages"), pick("updated").alias("updated"))


def purge_plan(files: DataFrame, sections: DataFrame, now) -> DataFrame:
    """What a purge does: files (section, path, mtime), sections (section, enabled, ttl_days).

    One row per section: reason why it's skipped, else how many files are expired.
    """
    j = sections.join(files, "section", "left")
    expired = F.col("path").isNotNull() & (F.col("mtime") < now - F.make_dt_interval(F.col("ttl_days")))
    got = j.groupBy("section", "enabled", "ttl_days").agg(F.count("path").alias("files"), F.count_if(expired).alias("expired"))
    reason = F.when(~F.col("enabled"), "disabled").when(F.col("ttl_days").isNull(), "ttl_unset").when(F.col("files") == 0, "missing")
    return got.select("section", reason.alias("skipped_reason"), F.when(reason.isNull(), F.col("expired")).otherwise(0).alias("removed"))


def purge_text(plan: DataFrame, dry_run: bool) -> DataFrame:
    verb = "would remove" if dry_run else "removed"
    return plan.withColumn("line", F.when(F.col("skipped_reason").isNotNull(), F.format_string("%s: skipped (%s)", "section", "skipped_reason")).otherwise(F.format_string(f"%s: {verb} %d files", "section", "removed")))


def tail(lines: DataFrame, n: int = 200, schema: str = "event string, url string, action string, score double") -> DataFrame:
    """The last n readable records of JSON lines (line_no, value); blank and corrupt lines don't count as records."""
    parsed = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"})).where(F.trim("value").startswith("{") & F.try_parse_json("value").isNotNull())
    return parsed.orderBy(F.desc("line_no")).limit(n).select("line_no", "r.*")
