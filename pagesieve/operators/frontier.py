"""Crawl-frontier operators: host statistics, priority terms, scheduling, failures and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.config import FrontierSettings


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def host_feedback(visits: DataFrame) -> DataFrame:
    """Per host of visits (host, at, score, action): pulls, summed reward, hits, last score and action, hint.

    The hint is the largest reward, or score_hint if ``visits`` has that column and it is larger.
    """
    reward = clamp(F.col("score"))
    last = lambda c: F.max_by(c, F.struct("at", "id"))
    return visits.groupBy("host").agg(F.count("*").alias("pulls"), F.sum(reward).alias("reward_sum"), F.count_if(F.col("action").isin("persist", "llm")).alias("hits"), last(reward).alias("last_score"), last(F.col("action")).alias("last_action"), F.max(F.greatest(reward, clamp_or_null(F.col("score_hint"))) if "score_hint" in visits.columns else reward).alias("hint"))


def host_failures(fails: DataFrame) -> DataFrame:
    """Per host of failures (host, status, reason, at): count, histogram of statuses, last reason."""
    each = fails.groupBy("host", "status").agg(F.count("*").alias("n"), F.max(F.struct("at", "reason")).alias("m"))
    return each.groupBy("host").agg(F.sum("n").alias("failures"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("status").cast("string"), "n")))).alias("status_counts"), F.max("m")["reason"].alias("last_reason"))


def novelty(pulls: Column, s: FrontierSettings = FrontierSettings()) -> Column:
    return F.when(F.coalesce(pulls, F.lit(0)) <= 0, 1.0).otherwise(F.greatest(F.lit(0.1), F.exp(-pulls / max(s.novelty_decay, 1.0))))


def bandit(pulls: Column, reward_sum: Column, total: Column, s: FrontierSettings = FrontierSettings()) -> Column:
    bonus = s.bandit_exploration * F.sqrt(F.ln(F.greatest(total, F.lit(1))) / pulls)
    return F.when(F.coalesce(pulls, F.lit(0)) == 0, s.bandit_initial).otherwise(clamp(clamp(reward_sum / pulls) + bonus))


def oddity_prior(pulls: Column, reward_sum: Column, hint: Column, host_hint: Column, s: FrontierSettings = FrontierSettings()) -> Column:
    return clamp(F.coalesce(F.greatest(F.when(pulls > 0, clamp(reward_sum / pulls)), clamp_or_null(hint), clamp_or_null(host_hint)), F.lit(s.oddity_baseline)))


def clamp_or_null(c: Column) -> Column:
    return F.when(c.isNotNull(), clamp(c))


def cascade_penalty(skips: Column, passes: Column, s: FrontierSettings = FrontierSettings()) -> Column:
    total = F.coalesce(skips, F.lit(0)) + F.coalesce(passes, F.lit(0))
    excess = skips / total - s.cascade_skip_threshold
    scaled = excess / max(1e-6, 1.0 - s.cascade_skip_threshold) * s.cascade_penalty
    return F.when((total >= s.cascade_min_observations) & (total > 0) & (excess > 0), F.least(F.lit(s.cascade_penalty), F.greatest(F.lit(0.0), scaled))).otherwise(0.0)


def refilled(tokens: Column, elapsed: Column, in_backoff: Column, s: FrontierSettings = FrontierSettings()) -> Column:
    """Tokens after ``elapsed`` seconds; none in backoff, all without a refill time."""
    if s.host_refill_seconds <= 0:
        return F.when(in_backoff, 0.0).otherwise(s.host_token_capacity)
    return F.when(in_backoff, 0.0).otherwise(F.least(F.lit(s.host_token_capacity), tokens + F.greatest(elapsed, F.lit(0.0)) / s.host_refill_seconds))


def budget(tokens: Column, in_backoff: Column, s: FrontierSettings = FrontierSettings()) -> Column:
    return F.when(in_backoff, 0.0).otherwise(clamp(F.coalesce(tokens / max(s.host_token_capacity, 1.0), F.lit(1.0))))


def wait_seconds(tokens: Column, backoff_left: Column, s: FrontierSettings = FrontierSettings()) -> Column:
    """Seconds until a host may be asked again."""
    wait = F.greatest(F.lit(0.0), 1 - tokens) * s.host_refill_seconds
    return F.greatest(F.when(F.coalesce(backoff_left, F.lit(0.0)) > wait, backoff_left).otherwise(wait), F.lit(s.host_penalty_seconds))


def retry_wait(attempt: Column, low: float, high: float, retries: int) -> Column:
    return F.least(F.lit(float(high)), low + (high - low) * (attempt - 1) / max(retries, 1))


def priority(terms: dict[str, Column], depth: Column, from_host: Column, host: Column, penalty: Column, s: FrontierSettings = FrontierSettings()) -> Column:
    score = s.weight_host_budget * terms["budget"] + s.weight_novelty * terms["novelty"] + s.weight_bandit * terms["bandit"] + s.weight_oddity * terms["oddity"]
    score = score - s.depth_penalty * F.greatest(depth, F.lit(0)) - penalty
    score = score + F.when((F.coalesce(from_host, F.lit("")) != "") & (from_host != host), s.cross_domain_bonus).otherwise(0.0)
    return F.greatest(F.lit(s.min_priority), F.least(F.lit(s.max_priority), score))


def admitted(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates (order, host, url, ...) with url and host that weren't seen before; the first of equal urls."""
    fresh = candidates.where("url <> '' AND host <> ''").join(seen.select("url"), "url", "left_anti")
    first = fresh.groupBy("url").agg(F.min("order").alias("order"))
    return fresh.join(first, ["url", "order"], "left_semi").dropDuplicates(["url"])


def next_batch(jobs: DataFrame, tokens: DataFrame, size: int, s: FrontierSettings = FrontierSettings()) -> DataFrame:
    """The jobs that would be taken next: per host at most its whole tokens, then by priority and order.

    ``jobs`` has host, url, priority and order, ``tokens`` host and tokens (full for unknown hosts).
    """
    t = F.coalesce("tokens", F.lit(s.host_token_capacity))
    ranked = jobs.join(tokens.select("host", "tokens"), "host", "left").withColumn("k", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("priority"), "order")))
    if s.host_refill_seconds > 0:
        ranked = ranked.where(F.col("k") <= F.floor(t))
    return ranked.orderBy(F.desc("priority"), "order").limit(size).drop("k", "tokens")


def failure_entries(fails: DataFrame) -> DataFrame:
    """Upsert by url of failures (url, status, reason, at, id): first and last time, count, last status and reason."""
    m = F.max(F.struct("at", "id", "status", "reason"))
    return fails.groupBy("url").agg(F.min("at").alias("first_recorded_at"), F.max("at").alias("last_recorded_at"), F.count("*").alias("count"), m["status"].alias("status"), m["reason"].alias("reason"))


def not_failed(urls: DataFrame, entries: DataFrame, now: Column, expiry_seconds: float | None, statuses=(404,)) -> DataFrame:
    """URLs without an unexpired failure of the given statuses."""
    alive = F.lit(True) if expiry_seconds is None else (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_recorded_at").cast("timestamp"))) < expiry_seconds
    return urls.join(entries.where(F.col("status").isin(*statuses) & alive).select("url"), "url", "left_anti")


def block_state(hosts: DataFrame, blocks: DataFrame, now: Column) -> DataFrame:
    """host and state: open, blocked (temporary) or forbidden (illegal); a block without a readable end is active."""
    until = F.try_to_timestamp(F.col("blocked_until"))
    active = blocks.where(until.isNull() | (until > now)).groupBy("host").agg(F.max(F.when(F.startswith("reason", F.lit("illegal")), 2).otherwise(1)).alias("k"))
    return hosts.join(active, "host", "left").select("host", F.when(F.col("k") == 2, "forbidden").when(F.col("k") == 1, "blocked").otherwise("open").alias("state"))


def failure_islands(events: DataFrame) -> DataFrame:
    """Running length of each host's run of failures, reset by a success: events (host, at, id, failed).

    A host's history is ordered in one task, as the reset rule is sequential.
    """
    w = Window.partitionBy("host").orderBy("at", "id")
    island = F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = events.withColumn("island", island)
    run = F.sum(F.when(F.col("failed"), 1).otherwise(0)).over(Window.partitionBy("host", "island").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("run", run).drop("island")


def request_gap(requests: DataFrame, interval: float) -> DataFrame:
    """Seconds each request (host, at, id) must still wait after the one before of its host."""
    before = F.lag("at").over(Window.partitionBy("host").orderBy("at", "id"))
    gone = F.unix_timestamp(F.col("at").cast("timestamp")) - F.unix_timestamp(before.cast("timestamp"))
    return requests.withColumn("wait", F.when(before.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), interval - gone)))


def promoted(jobs: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(ready, delayed) of jobs with available_at: a job is ready from that moment on."""
    ready = F.coalesce("available_at", F.lit(0.0)) <= now
    return jobs.where(ready), jobs.where(~ready)


def delayed(jobs: DataFrame, waits: DataFrame, now: Column) -> DataFrame:
    """``jobs`` whose host has a wait (host, wait seconds) may be taken only after it."""
    later = F.greatest(F.coalesce("available_at", F.lit(0.0)), now + F.col("wait"))
    return jobs.join(waits.select("host", "wait"), "host", "left").withColumn("available_at", F.coalesce(later, "available_at")).drop("wait").select(*jobs.columns)


def pending(ready: DataFrame, held: DataFrame) -> DataFrame:
    """All jobs that wait: those that are ready and those that are held back; a frontier's length is its count."""
    return ready.unionByName(held, allowMissingColumns=True)


def inflight_metadata(taken: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, metadata) of each of ``urls``: that of its job in flight, null if there is none."""
    return urls.select("url").join(taken.select("url", "metadata"), "url", "left")


def jobs_to_json(jobs: DataFrame) -> DataFrame:
    """(job): each job as a JSON object that ``jobs_from_json`` reads back."""
    return jobs.select(F.to_json(F.struct(*jobs.columns)).alias("job"))


def jobs_from_json(lines: DataFrame, schema: str) -> DataFrame:
    """Jobs of JSON objects (job); gaps are filled as for a saved frontier, and objects without a URL left out."""
    jobs = lines.select(F.from_json("job", schema).alias("j")).where(F.coalesce("j.url", F.lit("")) != "").select("j.*")
    return jobs.fillna({c: v for c, v in {"priority": 0.0, "depth": 0, "available_at": 0.0, "host": ""}.items() if c in jobs.columns})
