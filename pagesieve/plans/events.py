"""Queries of frontier, telemetry, safety and retention operators, with their SQL.

``events`` stands in for visits and failures: user_id is the host, value / 20 the score, event_type the action.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pagesieve.config import FrontierSettings
from pagesieve.operators import frontier as fr
from pagesieve.operators import telemetry as te
from pagesieve.plans.pages import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = re.sub(r"\bat\b", '"at"', sql)  # a keyword there
        return f

    return put


ACTION_SQL = "CASE event_type WHEN 'click' THEN 'llm' WHEN 'purchase' THEN 'persist' ELSE 'skip' END"
CLAMP = "greatest(0.0, least(1.0, value / 20))"
VISITS = f"v AS (SELECT event_id AS id, ts AS at, user_id AS host, value, {ACTION_SQL} AS action, {CLAMP} AS score, event_type = 'signup' AS failed FROM events)"


def visits(spark, d):
    act = F.when(F.col("event_type") == "click", "llm").when(F.col("event_type") == "purchase", "persist").otherwise("skip")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("user_id").alias("host"), "value", act.alias("action"), fr.clamp(F.col("value") / 20).alias("score"), (F.col("event_type") == "signup").alias("failed"))


def now():
    return F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")


FEEDBACK = f"WITH {VISITS}, h AS (SELECT host, count(*) AS pulls, sum(score) AS reward_sum, count(*) FILTER (action <> 'skip') AS hits, arg_max(score, (at, id)) AS last_score, arg_max(action, (at, id)) AS last_action, max(score) AS hint, count(*) FILTER (failed) AS skips, count(*) FILTER (NOT failed) AS passes FROM v GROUP BY host), n AS (SELECT count(*) AS total FROM v)"


def hosts(spark, d):
    v = visits(spark, d)
    casc = v.groupBy("host").agg(F.count_if("failed").alias("skips"), F.count_if(~F.col("failed")).alias("passes"))
    return fr.host_feedback(v).join(casc, "host")


@query("host_feedback", FEEDBACK + " SELECT host, pulls, round(reward_sum, 6) AS reward_sum, hits, round(last_score, 6) AS last_score, last_action, round(hint, 6) AS hint FROM h")
def host_feedback(spark, d):
    return fr.host_feedback(visits(spark, d)).select("host", "pulls", F.round("reward_sum", 6).alias("reward_sum"), "hits", F.round("last_score", 6).alias("last_score"), "last_action", F.round("hint", 6).alias("hint"))


@query("host_failures", "WITH e AS (SELECT user_id AS host, CASE WHEN value < 10 THEN 404 ELSE 500 END AS status, event_type AS reason, ts FROM events), c AS (SELECT host, status, count(*) AS n FROM e GROUP BY 1, 2) SELECT host, CAST(sum(n) AS BIGINT) AS failures, string_agg(status || '=' || n, ',' ORDER BY status) AS statuses, (SELECT arg_max(reason, (ts, reason)) FROM e WHERE e.host = c.host) AS last_reason FROM c GROUP BY host")
def host_failures(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("host"), F.when(F.col("value") < 10, 404).otherwise(500).alias("status"), F.col("event_type").alias("reason"), F.col("ts").alias("at"))
    got = fr.host_failures(e)
    return got.select("host", "failures", F.array_join(F.transform(F.map_entries("status_counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("statuses"), "last_reason")


@query("host_novelty", FEEDBACK + " SELECT host, round(greatest(0.1, exp(-pulls / 30.0)), 6) AS novelty FROM h")
def host_novelty(spark, d):
    return hosts(spark, d).select("host", F.round(fr.novelty(F.col("pulls"), FrontierSettings(novelty_decay=30.0)), 6).alias("novelty"))


@query("host_ucb", FEEDBACK + " SELECT host, round(greatest(0.0, least(1.0, greatest(0.0, least(1.0, reward_sum / pulls)) + 0.25 * sqrt(ln(total) / pulls))), 6) AS ucb FROM h, n")
def host_ucb(spark, d):
    n = visits(spark, d).count()
    return hosts(spark, d).select("host", F.round(fr.bandit(F.col("pulls"), F.col("reward_sum"), F.lit(n)), 6).alias("ucb"))


@query("host_oddity_prior", FEEDBACK + " SELECT host, round(greatest(reward_sum / pulls, hint), 6) AS prior FROM h")
def host_oddity_prior(spark, d):
    return hosts(spark, d).select("host", F.round(fr.oddity_prior(F.col("pulls"), F.col("reward_sum"), F.lit(None).cast("double"), F.col("hint")), 6).alias("prior"))


@query("cascade_penalty", FEEDBACK + " SELECT host, round(CASE WHEN skips + passes >= 5 AND skips / (skips + passes) > 0.15 THEN least(0.15, (skips / (skips + passes) - 0.15) / 0.85 * 0.15) ELSE 0 END, 6) AS penalty FROM h")
def cascade_penalty(spark, d):
    s = FrontierSettings(cascade_skip_threshold=0.15)
    return hosts(spark, d).select("host", F.round(fr.cascade_penalty(F.col("skips"), F.col("passes"), s), 6).alias("penalty"))


PRIORITY = """, p AS (SELECT v.id, v.host, v.at, v.id % 4 AS depth, (v.host + 1) % 3 AS other, round(greatest(0.05, least(1.0,
  0.35 * greatest(0.0, least(1.0, (h.host % 10) / 10.0)) + 0.25 * greatest(0.1, exp(-pulls / 6.0)) + 0.25 * greatest(0.0, least(1.0, greatest(0.0, least(1.0, reward_sum / pulls)) + 0.25 * sqrt(ln(total) / pulls)))
  + 0.15 * greatest(reward_sum / pulls, score, hint) - 0.05 * (v.id % 4) - CASE WHEN skips + passes >= 5 AND skips / (skips + passes) > 0.8 THEN least(0.15, (skips / (skips + passes) - 0.8) / 0.2 * 0.15) ELSE 0 END
  + CASE WHEN (v.host + 1) % 3 <> v.host THEN 0.05 ELSE 0 END)), 6) AS priority FROM v JOIN h USING (host), n)"""


def jobs(spark, d):
    v, h = visits(spark, d), hosts(spark, d)
    j = v.join(h.drop("last_score", "last_action", "hits"), "host")
    terms = {"budget": fr.budget((F.col("host") % 10) / 10.0, F.lit(False)), "novelty": fr.novelty(F.col("pulls")), "bandit": fr.bandit(F.col("pulls"), F.col("reward_sum"), F.lit(v.count())), "oddity": fr.oddity_prior(F.col("pulls"), F.col("reward_sum"), F.col("score"), F.col("hint"))}
    p = fr.priority(terms, (F.col("id") % 4).cast("int"), ((F.col("host") + 1) % 3).cast("string"), F.col("host").cast("string"), fr.cascade_penalty(F.col("skips"), F.col("passes")))
    return j.select("id", "host", F.round(p, 6).alias("priority"))


@query("frontier_priority", FEEDBACK + PRIORITY + " SELECT id, host, priority FROM p")
def frontier_priority(spark, d):
    return jobs(spark, d)


@query("frontier_batch", FEEDBACK + PRIORITY + ", r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY priority DESC, id) AS k FROM p) SELECT id, host, priority FROM r WHERE k <= host % 4 ORDER BY priority DESC, id LIMIT 50")
def frontier_batch(spark, d):
    """The next 50 jobs under each host's tokens (a top-k by definition)."""
    j = jobs(spark, d).withColumn("order", F.col("id"))
    tokens = j.select("host").distinct().withColumn("tokens", (F.col("host") % 4).cast("double"))
    return fr.next_batch(j, tokens, 50).select("id", "host", "priority")


@query("token_refill", FEEDBACK + " SELECT host, round(CASE WHEN host % 7 = 0 THEN 0 ELSE least(3.0, 0.5 + (host % 100) / 10.0) END, 6) AS tokens, round(greatest(CASE WHEN host % 7 = 0 AND 20 > 10 * greatest(0, 1 - CASE WHEN host % 7 = 0 THEN 0 ELSE least(3.0, 0.5 + (host % 100) / 10.0) END) THEN 20.0 ELSE 10 * greatest(0, 1 - CASE WHEN host % 7 = 0 THEN 0 ELSE least(3.0, 0.5 + (host % 100) / 10.0) END) END, 1.0), 6) AS wait FROM h")
def token_refill(spark, d):
    """Tokens after some seconds, and how long until the next request."""
    s = FrontierSettings(host_token_capacity=3.0)
    off = F.col("host") % 7 == 0
    t = fr.refilled(F.lit(0.5), (F.col("host") % 100).cast("double"), off, s)
    return hosts(spark, d).select("host", F.round(t, 6).alias("tokens"), F.round(fr.wait_seconds(t, F.when(off, 20.0), s), 6).alias("wait"))


@query("retry_backoff", "SELECT event_id, round(least(10.0, 2 + 8 * (event_id % 5) / 3.0), 6) AS wait FROM events")
def retry_backoff(spark, d):
    return table(spark, d, "events").select("event_id", F.round(fr.retry_wait(F.col("event_id") % 5 + 1, 2, 10, 3), 6).alias("wait"))


@query("seen_anti_join", "WITH c AS (SELECT user_id % 40 || '/' || (event_id % 200) AS url, event_id FROM events), s AS (SELECT DISTINCT user_id % 40 || '/' || (event_id % 200) AS url FROM events WHERE event_type = 'click') SELECT url, min(event_id) AS first FROM c WHERE url NOT IN (SELECT url FROM s) GROUP BY url")
def seen_anti_join(spark, d):
    url = F.concat((F.col("user_id") % 40).cast("string"), F.lit("/"), (F.col("event_id") % 200).cast("string"))
    e = table(spark, d, "events").select(url.alias("url"), F.col("user_id").cast("string").alias("host"), F.col("event_id").alias("order"), "event_type")
    return fr.admitted(e, e.where("event_type = 'click'").distinct()).select("url", F.col("order").alias("first"))


FAILS = "f AS (SELECT user_id % 40 AS url, CASE WHEN value < 10 THEN 404 ELSE 500 END AS status, event_type AS reason, ts AS at, event_id AS id FROM events WHERE event_type IN ('signup', 'click')), u AS (SELECT url, min(at) AS first_recorded_at, max(at) AS last_recorded_at, count(*) AS count, arg_max(status, (at, id)) AS status, arg_max(reason, (at, id)) AS reason FROM f GROUP BY url)"


def fails(spark, d):
    return table(spark, d, "events").where("event_type IN ('signup', 'click')").select((F.col("user_id") % 40).alias("url"), F.when(F.col("value") < 10, 404).otherwise(500).alias("status"), F.col("event_type").alias("reason"), F.col("ts").alias("at"), F.col("event_id").alias("id"))


@query("failure_upsert", f"WITH {FAILS} SELECT * FROM u")
def failure_upsert(spark, d):
    return fr.failure_entries(fails(spark, d))


@query("failure_skip", f"WITH {FAILS} SELECT DISTINCT user_id % 40 AS url FROM events WHERE user_id % 40 NOT IN (SELECT url FROM u WHERE status = 404 AND epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(date_trunc('second', last_recorded_at)) < 200000)")
def failure_skip(spark, d):
    urls = table(spark, d, "events").select((F.col("user_id") % 40).alias("url")).distinct()
    return fr.not_failed(urls, fr.failure_entries(fails(spark, d)), F.lit("2024-01-31 00:00:00").cast("timestamp"), 200_000)


@query("block_state", "SELECT DISTINCT user_id AS host, CASE WHEN user_id % 11 = 0 THEN 'forbidden' WHEN user_id % 5 = 0 AND user_id % 2 = 0 THEN 'blocked' WHEN user_id % 13 = 0 THEN 'blocked' ELSE 'open' END AS state FROM events")
def block_state(spark, d):
    h = table(spark, d, "events").select(F.col("user_id").alias("host")).distinct()
    day = lambda c: c.cast("string")
    b = h.where("host % 11 = 0").select("host", F.lit("2030-01-01 00:00:00").alias("blocked_until"), F.lit("illegal: listed").alias("reason"))
    b = b.union(h.where("host % 5 = 0").select("host", day(F.when(F.col("host") % 2 == 0, "2030-01-01 00:00:00").otherwise("2020-01-01 00:00:00")), F.lit("failures")))
    b = b.union(h.where("host % 13 = 0").select("host", F.lit("not a time"), F.lit("failures")))
    return fr.block_state(h, b, F.lit("2024-06-01 00:00:00").cast("timestamp"))


@query("failure_islands", f"WITH {VISITS}, i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY at, id ROWS UNBOUNDED PRECEDING) AS island FROM v) SELECT id, host, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY host, island ORDER BY at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM i")
def failure_islands(spark, d):
    return fr.failure_islands(visits(spark, d)).select("id", "host", "run")


@query("rate_limit_wait", f"WITH {VISITS}, g AS (SELECT *, epoch(date_trunc('second', at)) - epoch(date_trunc('second', lag(at) OVER (PARTITION BY host ORDER BY at, id))) AS gap FROM v) SELECT id, host, CAST(CASE WHEN gap IS NULL THEN 0 ELSE greatest(0, 3600 - gap) END AS DOUBLE) AS wait FROM g")
def rate_limit_wait(spark, d):
    return fr.request_gap(visits(spark, d), 3600.0).select("id", "host", F.col("wait").cast("double").alias("wait"))


@query("running_metrics", f"WITH {VISITS} SELECT id, host, row_number() OVER w AS pages, CAST(sum(CASE WHEN action <> 'skip' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS odd, round(sum(CASE WHEN action <> 'skip' THEN 1 ELSE 0 END) OVER w / row_number() OVER w, 4) AS odd_ratio FROM v WINDOW w AS (PARTITION BY host ORDER BY at, id ROWS UNBOUNDED PRECEDING)")
def running_metrics(spark, d):
    return te.running(visits(spark, d), "host").select("id", "host", "pages", "odd", "odd_ratio")


@query("checkpoint_batches", f"WITH {VISITS} SELECT id, host, CAST(floor((row_number() OVER (PARTITION BY host ORDER BY at, id) - 1) / 25) AS BIGINT) AS batch FROM v")
def checkpoint_batches(spark, d):
    return te.checkpoints(visits(spark, d), "host", 25).select("id", "host", "batch")


@query("last_n_history", f"WITH {VISITS}, r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY at DESC, id DESC) AS k FROM v) SELECT host, string_agg(action, ',' ORDER BY k) AS history FROM r WHERE k <= 10 GROUP BY host")
def last_n_history(spark, d):
    return te.last_n(visits(spark, d).withColumn("value", F.col("action")), "host", 10).select("host", F.array_join("history", ",").alias("history"))


@query("conversation_tail", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id, string_agg(role, ',' ORDER BY k) AS roles FROM r WHERE k <= 5 GROUP BY conv_id")
def conversation_tail(spark, d):
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("at"), F.col("turn").alias("id"), F.col("role").alias("value"))
    return te.last_n(c, "conv_id", 5).select("conv_id", F.array_join("history", ",").alias("roles"))


@query("telemetry_summary", f"""WITH {VISITS}, s AS (SELECT count(*) AS pages, count(*) FILTER (action = 'skip') AS skip, count(*) FILTER (action = 'persist') AS persist, count(*) FILTER (action = 'llm') AS llm, count(*) FILTER (failed) AS illegal_skipped, count(*) FILTER (action = 'llm' OR value > 15) AS calls, count(*) FILTER (value < 2) AS errors,
  sum(score) AS ss, sum(CAST(floor(value * 1000) AS BIGINT)) AS b, sum(value) AS ms, epoch(date_trunc('second', max(at))) - epoch(date_trunc('second', min(at))) AS sec FROM v)
SELECT pages, skip, persist, llm, illegal_skipped, pages AS requests, calls AS llm_calls, errors, round(ss / pages, 4) AS average_score, round((persist + llm) / pages, 4) AS odd_hit_ratio, round(ms / pages, 4) AS average_fetch_ms, round(b / 1024 / pages, 4) AS kib_per_page, round(b / 1048576, 4) AS mib, CAST(sec AS BIGINT) AS elapsed_seconds, round(pages * 60.0 / sec, 4) AS pages_per_minute, round(pages * 3600.0 / sec, 4) AS pages_per_hour FROM s""")
def telemetry_summary(spark, d):
    v = visits(spark, d).withColumns({"bytes": F.floor(F.col("value") * 1000).cast("long"), "duration_ms": F.col("value"), "illegal": F.col("failed"), "finding": F.when(F.col("value") > 15, "found"), "error": F.when(F.col("value") < 2, "timeout")})
    return te.summary(v)


@query("reason_top10", "SELECT json_extract_string(props, '$.k') AS reason, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, reason LIMIT 10")
def reason_top10(spark, d):
    return te.top(table(spark, d, "events").select(F.get_json_object("props", "$.k").alias("reason")), "reason", 10)


@query("failure_hosts_top10", "SELECT user_id AS host, count(*) AS n FROM events WHERE event_type = 'signup' AND value < 10 GROUP BY 1 ORDER BY n DESC, host LIMIT 10")
def failure_hosts_top10(spark, d):
    return te.top(table(spark, d, "events").where("event_type = 'signup' AND value < 10").select(F.col("user_id").alias("host")), "host", 10)


@query("actions_per_minute", f"WITH {VISITS} SELECT date_trunc('minute', at) AS minute, action, count(*) AS n FROM v GROUP BY 1, 2")
def actions_per_minute(spark, d):
    return visits(spark, d).groupBy(F.window("at", "1 minute")["start"].alias("minute"), "action").agg(F.count("*").alias("n"))


@query("session_activity", f"WITH {VISITS}, g AS (SELECT *, CASE WHEN at - lag(at) OVER (PARTITION BY host ORDER BY at, id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM v), s AS (SELECT *, sum(fresh) OVER (PARTITION BY host ORDER BY at, id ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT host, min(at) AS start, count(*) AS n FROM s GROUP BY host, k")
def session_activity(spark, d):
    return visits(spark, d).groupBy("host", F.session_window("at", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("host", F.col("w.start").alias("start"), "n")


@query("action_rollup", f"WITH {VISITS} SELECT coalesce(action, 'all') AS action, coalesce(CAST(host % 3 AS BIGINT), -1) AS shard, count(*) AS n, round(avg(score), 6) AS average FROM v GROUP BY ROLLUP (action, CAST(host % 3 AS BIGINT))")
def action_rollup(spark, d):
    return visits(spark, d).withColumn("shard", F.col("host") % 3).rollup("action", "shard").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("average")).fillna({"action": "all", "shard": -1})


@query("props_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.missing') AS BIGINT) AS missing FROM events")
def props_json(spark, d):
    j = F.from_json("props", "k long, missing long")
    return table(spark, d, "events").select("event_id", j["k"].alias("k"), j["missing"].alias("missing"))


@query("telemetry_tail", "SELECT event_id AS line_no, event_type AS event, round(value, 4) AS score FROM events WHERE event_id % 3 <> 0 ORDER BY event_id DESC LIMIT 200")
def telemetry_tail(spark, d):
    """The last 200 readable lines of a log in which every third line is corrupt (a tail by definition)."""
    good = F.to_json(F.struct(F.col("event_type").alias("event"), F.round("value", 4).alias("score")))
    lines = table(spark, d, "events").select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 3 == 0, "{broken").otherwise(good).alias("value"))
    return te.tail(lines, 200).select("line_no", "event", "score")


@query("full_outer_runs", "WITH s AS (SELECT user_id AS run_id, count(*) AS pages FROM events WHERE event_type = 'click' AND user_id % 2 = 0 GROUP BY 1), m AS (SELECT user_id AS run_id, count(*) AS pages FROM events WHERE user_id % 3 = 0 GROUP BY 1), a AS (SELECT DISTINCT user_id AS run_id, CAST(-1 AS BIGINT) AS pages FROM events WHERE user_id % 5 = 0) SELECT run_id, coalesce(s.pages, m.pages, a.pages) AS pages FROM s FULL JOIN m USING (run_id) FULL JOIN a USING (run_id)")
def full_outer_runs(spark, d):
    e = table(spark, d, "events").withColumn("run_id", F.col("user_id"))
    s = e.where("event_type = 'click' AND run_id % 2 = 0").groupBy("run_id").agg(F.count("*").alias("pages"), F.max("ts").alias("updated"))
    m = e.where("run_id % 3 = 0").groupBy("run_id").agg(F.count("*").alias("pages"), F.max("ts").alias("updated"))
    a = e.where("run_id % 5 = 0").select("run_id", F.lit(-1).cast("long").alias("pages"), F.lit(None).cast("timestamp_ntz").alias("updated")).distinct()
    return te.runs(s, m, a).select("run_id", "pages")


PURGE = "WITH x AS (SELECT o_orderpriority AS section, o_orderdate AS mtime FROM orders), c AS (SELECT DISTINCT section, section NOT LIKE '1%' AS enabled, CASE WHEN section LIKE '2%' THEN NULL ELSE CAST(left(section, 1) AS INTEGER) * 100 END AS ttl FROM x), p AS (SELECT c.section, enabled, ttl, count(*) FILTER (mtime < TIMESTAMP '1998-01-01' - to_days(ttl)) AS n FROM c JOIN x USING (section) GROUP BY 1, 2, 3), q AS (SELECT section, CASE WHEN NOT enabled THEN 'disabled' WHEN ttl IS NULL THEN 'ttl_unset' END AS skipped_reason, n FROM p)"


def purge(spark, d):
    o = table(spark, d, "orders")
    files = o.select(F.col("o_orderpriority").alias("section"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("mtime"))
    first = F.substring("section", 1, 1)
    sections = files.select("section").distinct().select("section", (first != "1").alias("enabled"), F.when(first != "2", first.cast("int") * 100).alias("ttl_days"))
    return te.purge_plan(files, sections, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))


@query("ttl_purge", PURGE + " SELECT section, skipped_reason, CASE WHEN skipped_reason IS NULL THEN n ELSE 0 END AS removed FROM q")
def ttl_purge(spark, d):
    return purge(spark, d).select("section", "skipped_reason", F.col("removed").cast("long").alias("removed"))


@query("purge_summary", PURGE + " SELECT section || ': ' || CASE WHEN skipped_reason IS NOT NULL THEN 'skipped (' || skipped_reason || ')' ELSE 'would remove ' || n || ' files' END AS line FROM q")
def purge_summary(spark, d):
    return te.purge_text(purge(spark, d), True).select("line")


@query("iso_timestamps", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 2 THEN NULL ELSE date_trunc('second', ts) END, TIMESTAMP '2000-01-01 00:00:00') AS at, CAST(CAST(CASE WHEN event_id % 3 = 2 THEN TIMESTAMP '2000-01-01 00:00:00' ELSE ts END AS DATE) AS VARCHAR) AS day FROM events")
def iso_timestamps(spark, d):
    """ISO texts with Z, without zone, and unreadable ones (which get a default)."""
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(t, F.lit("Z"))).when(F.col("event_id") % 3 == 1, t).otherwise(F.lit("soon"))
    at = F.coalesce(F.try_to_timestamp(text), F.lit("2000-01-01 00:00:00").cast("timestamp")).cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", at.alias("at"), at.cast("date").cast("string").alias("day"))


