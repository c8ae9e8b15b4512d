"""Triage: prompts, an analyst that can be plugged in, findings, references, and what is recorded of them.

The analyst and the summariser are callables from a list of prompts to a list of texts. They run in Arrow batches for
the pages that ask for them only (a filter stands before the call); without one, the fallback finding is used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesieve.operators import pages as op
from pagesieve.sources.files import json_object
from pagesieve.storage import stored

FINDING = "url string, summary string, why_flagged array<string>, risk_tag string, dangerous_content struct<present:boolean,category:string,notes:string>, confidence double, observation_ref string"


def text_call(call: Callable[[list[str]], list[str]]):
    """A column function that answers prompts by ``call``, a batch at a time; a null prompt has no answer."""

    @F.pandas_udf(T.StringType())
    def answer(prompts):
        import pandas as pd

        asked = prompts[prompts.notna()]
        out = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
        if len(asked):
            out[asked.index] = call(asked.tolist())
        return out

    return answer


def summary_prompt(url: Column, excerpt: Column) -> Column:
    return F.concat_ws("\n", F.lit("Summarise in two sentences what is unusual about this page."), F.concat(F.lit("URL: "), url), F.lit("Excerpt:"), F.substring(excerpt, 1, 2000))


def with_summaries(observed: DataFrame, call: Callable[[list[str]], list[str]], chars: int = 500) -> DataFrame:
    """Append flash_summary, at most ``chars`` characters."""
    return observed.withColumn("flash_summary", F.substring(text_call(call)(summary_prompt(F.col("url"), F.col("text_excerpt"))), 1, chars))


def analyst_prompt(features: Column, extra: Column | None = None) -> Column:
    """URL, title, excerpt (at most 2000 characters), features as JSON, and what else is known."""
    parts = [F.lit("Judge the page below and answer with one JSON object."), F.concat(F.lit("URL: "), F.coalesce("url", F.lit(""))), F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))), F.lit("Excerpt:"), F.substring(F.coalesce("text_excerpt", F.lit("")), 1, 2000), F.lit("Features:"), F.to_json(features)]
    if extra is not None:
        parts += [F.lit("Context:"), extra]
    return F.concat_ws("\n", *parts)


def reference(fetched_at: Column, url_hash: Column) -> Column:
    return F.concat(F.lit("observation:"), F.coalesce(fetched_at.cast("string"), F.lit("unknown")), F.lit(":"), F.substring(url_hash, 1, 8))


def triaged(decided: DataFrame, call: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """page_id and finding of the pages with action llm; an answer that can't be read falls back, gaps in one are filled."""
    fallback = op.findings(decided)
    if call is None:
        return fallback
    asked = decided.where("action = 'llm'")
    prompt = analyst_prompt(F.struct("retro_signals", "url_flags", "retro_score", "semantic_score", "score"))
    # Written, so that no plan around it asks a model twice for one page
    answers = stored(asked.select("page_id", F.col("url").alias("own_url"), "url_sha256", text_call(call)(prompt).alias("answer")), "answers")
    read = answers.select("page_id", "own_url", "url_sha256", F.from_json(json_object(F.col("answer")), FINDING).alias("f"))
    j = fallback.join(read, "page_id", "left")
    pick = lambda c: F.coalesce(F.when(F.col("f.summary").isNotNull(), F.col(f"f.{c}")), F.col(c)).alias(c)
    ref = F.coalesce(F.nullif(F.col("f.observation_ref"), F.lit("")), F.col("observation_ref")).alias("observation_ref")
    return j.select("page_id", F.coalesce(F.nullif(F.col("f.url"), F.lit("")), F.col("url")).alias("url"), *[pick(c) for c in ("summary", "why_flagged", "risk_tag", "dangerous_content", "confidence")], ref)


def finding_fault() -> Column:
    """Why a finding breaks its schema (null if it doesn't): summary <= 800, 2 to 6 reasons, confidence 0 to 1, notes <= 300."""
    n = F.size("why_flagged")
    return F.when(F.length("summary") > 800, "summary").when((n < 2) | (n > 6), "why_flagged").when(~F.col("confidence").between(0, 1), "confidence").when(F.length("dangerous_content.notes") > 300, "notes")


def crumbs_of(found: DataFrame, observed: DataFrame, salt: str = "2025Q1") -> DataFrame:
    """Breadcrumbs of triaged findings; ``observed`` has page_id, text_excerpt, url_sha256 and fetched_at."""
    j = found.join(observed.select("page_id", F.col("text_excerpt").alias("excerpt"), F.col("url_sha256").alias("url_hash"), F.col("fetched_at").alias("observed_at")), "page_id")
    return op.breadcrumbs(j.withColumns({"present": F.col("dangerous_content.present"), "category": F.col("dangerous_content.category"), "notes": F.col("dangerous_content.notes")}), salt)


def sample_finding(url: Column) -> Column:
    """A finding to show the form of one."""
    return F.struct(url.alias("url"), F.lit("An example of a finding.").alias("summary"), F.array(F.lit("example"), F.lit("form")).alias("why_flagged"), F.lit("harmless-retro").alias("risk_tag"), F.lit(0.5).alias("confidence"), F.concat(F.lit("observation:"), F.substring(F.sha1(url.cast("binary")), 1, 8)).alias("observation_ref"))


def stage_json(stages: Column, reason: Column) -> Column:
    """Stages as JSON; only the last can have a reason, and what is empty is left out."""
    last = F.size(stages) - 1
    return F.to_json(F.transform(stages, lambda s, i: F.struct(F.split_part(s, F.lit(":"), F.lit(1)).alias("stage"), F.split_part(s, F.lit(":"), F.lit(2)).alias("status"), F.when(i == last, F.nullif(reason, F.lit(""))).alias("reason"))))


def blocks_of(islands: DataFrame, most: int, minutes: int) -> DataFrame:
    """Block windows from runs of failures (host, at, run): each time a run reaches a multiple of ``most``."""
    hit = islands.where((F.col("run") > 0) & (F.col("run") % most == 0))
    return hit.groupBy("host").agg(F.count("*").alias("blocks"), (F.max("at") + F.make_dt_interval(mins=F.lit(minutes))).alias("blocked_until"))


def illegal_blocks(outcomes: DataFrame, at: Column, days: int = 365) -> DataFrame:
    """A long block for each host with illegal content."""
    from pagesieve.functions.urls import netloc

    bad = outcomes.where("outcome = 'illegal'")
    return bad.groupBy(netloc(F.col("url")).alias("host")).agg((at + F.make_dt_interval(days=F.lit(days))).alias("blocked_until"), F.concat(F.lit("illegal: "), F.min("reason")).alias("reason"))


def merged_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two node snapshots (url, first_seen, last_seen, observations, webring_hits, status, title) as one."""
    both = old.unionByName(new)
    return both.groupBy("url").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("observations").alias("observations"), F.sum("webring_hits").alias("webring_hits"), F.max_by("status", "last_seen").alias("status"), F.max_by("title", F.when(F.col("title") != "", F.col("last_seen"))).alias("title"))


def enriched(observed: DataFrame, links: DataFrame, metrics: DataFrame) -> DataFrame:
    """Observations with the graph metrics of their URL and their own link counts; missing ones are zero."""
    counts = op.outbound_counts(observed, links)
    m = metrics.select(F.col("node").alias("url"), "out_degree", "in_degree", "reciprocal_links", F.col("size").alias("component_size"), F.col("density").alias("component_density"), F.col("rank").alias("pagerank"), "odd_neighbor_ratio", "graph_score")
    return observed.join(counts, "page_id", "left").join(m, "url", "left").fillna({"graph_score": 0.0, "outbound_count": 0, "outbound_domains": 0, "webring_hits": 0, "has_webring": False})
