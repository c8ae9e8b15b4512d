"""Queries of triage operators, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from pagesieve.config import FusionSettings, PrefilterSettings
from pagesieve.operators import frontier as fr
from pagesieve.operators import graph as gr
from pagesieve.operators import pages as op
from pagesieve.operators import triage as tr
from pagesieve.plans.events import VISITS, visits
from pagesieve.plans.pages import FEATURES, NETLOC, TIGHT, TIGHT_SQL, table
from pagesieve.plans.pages import SQL as PAGE_SQL
from pagesieve.sources.files import json_object
from pagesieve.storage import keeper, stored

QUERIES, SQL = {}, {}
GATE = FusionSettings(llm_gate=0.55)


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("demo_finding", "SELECT page_id, 'observation:' || left(sha1(url), 8) AS ref FROM pages")
def demo_finding(spark, d):
    return table(spark, d, "pages").select("page_id", tr.sample_finding(F.col("url"))["observation_ref"].alias("ref"))


@query("analyst_prompt", f"WITH {FEATURES} SELECT page_id, CAST(length('Judge the page below and answer with one JSON object.' || chr(10) || 'URL: ' || url || chr(10) || 'Title: ' || chr(10) || 'Excerpt:' || chr(10) || left(t, 500) || chr(10) || 'Features:' || chr(10) || '{{\"tokens\":' || tokens || '}}') AS INTEGER) AS chars FROM z")
def analyst_prompt(spark, d):
    """Length of each page's prompt (the title left empty)."""
    p = op.with_features(table(spark, d, "pages")).withColumn("title", F.lit(""))
    return p.select("page_id", F.length(tr.analyst_prompt(F.struct(F.col("token_count").alias("tokens")))).alias("chars"))


def analyst(prompts):
    """Stands in for a model: finds in prose for URLs of an odd length, and answers the rest with something unreadable."""
    n = [len(re.search(r"(?m)^URL: (.*)$", p)[1]) for p in prompts]
    return [f'I think: {{"summary": "seen {x}", "risk_tag": "other", "confidence": 0.9}} ok?' if x % 2 else "no idea" for x in n]


@query("analyst_udf", f"SELECT f.page_id, CASE WHEN length(url) % 2 = 1 THEN 'seen ' || length(url) ELSE summary END AS summary, CASE WHEN length(url) % 2 = 1 THEN 'other' ELSE risk_tag END AS risk_tag, CASE WHEN length(url) % 2 = 1 THEN 0.9 ELSE confidence END AS confidence, observation_ref FROM ({PAGE_SQL["fallback_findings"]}) f JOIN pages p ON p.page_id = f.page_id")
def analyst_udf(spark, d):
    """Triage with an analyst plugged in: only pages beyond the gate reach it."""
    return tr.triaged(op.scored(table(spark, d, "pages"), s=GATE), analyst).select("page_id", "summary", "risk_tag", "confidence", "observation_ref")


@query("tolerant_json", "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE -1 END AS k FROM events")
def tolerant_json(spark, d):
    """Objects alone, within prose, cut, and absent."""
    m = F.col("event_id") % 4
    text = F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit("so: "), F.col("props"), F.lit(" done"))).when(m == 2, F.substring("props", 1, 3)).otherwise("none")
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object(json_object(text), "$.k").cast("long"), F.lit(-1).cast("long")).alias("k"))


@query("stage_json", f"WITH {TIGHT_SQL} SELECT page_id, coalesce(r1, r3, r4, r6, '') AS reason, CAST(CASE WHEN r1 IS NOT NULL THEN 1 WHEN r3 IS NOT NULL THEN 3 WHEN r4 IS NOT NULL THEN 4 WHEN r6 IS NOT NULL THEN 6 ELSE 7 END AS BIGINT) AS stages FROM q")
def stage_json(spark, d):
    """Decisions as JSON and read back: number of stages, and the reason of the last."""
    c = op.cascade(table(spark, d, "pages"), TIGHT, PrefilterSettings(enabled=False)).select("page_id", tr.stage_json(F.col("stages"), F.col("reason")).alias("j"))
    got = c.select("page_id", F.from_json("j", "array<struct<stage:string,status:string,reason:string>>").alias("s"))
    return got.select("page_id", F.coalesce(F.element_at("s", -1)["reason"], F.lit("")).alias("reason"), F.size("s").cast("long").alias("stages"))


@query("host_blocks", (f"WITH {VISITS}, i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY at, id ROWS UNBOUNDED PRECEDING) AS island FROM v), r AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY host, island ORDER BY at, id ROWS UNBOUNDED PRECEDING) AS run FROM i) SELECT host, count(*) AS blocks, strftime(max(at) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS blocked_until FROM r WHERE run > 0 AND run % 2 = 0 GROUP BY 1").replace(" at,", ' "at",').replace("(at)", '("at")').replace("AS at", 'AS "at"'))
def host_blocks(spark, d):
    got = tr.blocks_of(fr.failure_islands(visits(spark, d)), 2, 30)
    return got.select("host", "blocks", F.date_format("blocked_until", "yyyy-MM-dd HH:mm:ss").alias("blocked_until"))


@query("illegal_blocks", f"SELECT {NETLOC.format('url')} AS host, 'illegal: ' || min(CASE WHEN contains(lower(html), 'tion') THEN 'tion' END) AS reason FROM pages WHERE contains(lower(html), 'tion') GROUP BY 1")
def illegal_blocks(spark, d):
    bad = op.with_illegal(table(spark, d, "pages"), "html", ("tion",)).where("illegal").select("url", F.lit("illegal").alias("outcome"), F.col("illegal_reason").alias("reason"))
    return tr.illegal_blocks(bad, F.lit("2025-01-01 00:00:00").cast("timestamp")).select("host", "reason")


@query("node_merge", "SELECT l_suppkey AS url, count(*) AS observations, CAST(sum(l_linenumber) AS BIGINT) AS webring_hits, strftime(max(l_shipdate), '%Y-%m-%d') AS last_seen FROM lineitem GROUP BY 1")
def node_merge(spark, d):
    """Two half snapshots merged equal the whole."""
    v = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("url"), F.col("l_shipdate").alias("seen_at"), F.lit(200).alias("status"), F.lit("").alias("title"), F.col("l_linenumber").alias("webring_hits"), "l_orderkey")
    got = tr.merged_nodes(gr.nodes_of(v.where("l_orderkey % 2 = 0")), gr.nodes_of(v.where("l_orderkey % 2 = 1")))
    return got.select("url", "observations", "webring_hits", F.date_format("last_seen", "yyyy-MM-dd").alias("last_seen"))


@query("crawl_outcomes_with_graph")
def crawl_outcomes_with_graph(spark, d):
    """The whole course with the link graph: first scores feed the neighbours' ratio, then all metrics feed the final score."""
    pages = table(spark, d, "pages")
    links = stored(op.page_links(pages), "crawl-links")
    edges = links.where("url <> target").select(F.col("url").alias("src"), F.col("target").alias("dst"))
    first = op.scored(pages).groupBy(F.col("url").alias("node")).agg(F.max("score").alias("last_score"))
    metrics = gr.graph_metrics(edges, first, keeper("crawl"), 10)
    g = tr.enriched(pages.select("page_id", "url"), links, metrics).select("page_id", "graph_score", "component_size", "has_webring")
    return op.outcomes(pages, graph=stored(g, "crawl-graph"))
