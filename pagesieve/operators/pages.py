"""Page operators: features, links, the staged cascade, the safety scan, scores, findings and breadcrumbs.

All take and return DataFrames of pages with ``page_id``, ``url`` and ``html`` (page_id is the order of arrival).
Everything is native but the exact fingerprint, which one Arrow call makes for the pages that reach that stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.config import DANGER_CATEGORIES, ILLEGAL_KEYWORDS, RETRO_TAGS, SNIPPET_RETRO_TAGS, CascadeSettings, FusionSettings, PrefilterSettings
from pagesieve.functions import text as tx
from pagesieve.functions import urls as ur
from pagesieve.functions.fingerprints import simhash64
from pagesieve.storage import stored

# --- features ----------------------------------------------------------------------------------


def with_features(pages: DataFrame, excerpt_chars: int = 500) -> DataFrame:
    """Append title, excerpt, tokens, hashes, retro signals, URL flags and the semantic share."""
    p = pages.withColumns({"text": tx.html_text(F.col("html")), "title": tx.html_title(F.col("html")), "marked": tx.markup(F.col("html"))})
    counts = {f"n_{t}": tx.tag_count(F.col("marked"), t) for t in RETRO_TAGS}
    p = p.withColumns({**counts, "token_count": tx.space_tokens(F.col("text")), "url_flags": ur.weird_flags(F.col("url")), "content_sha256": F.sha2(F.coalesce("html", F.lit("")), 256), "url_sha256": F.sha2(F.coalesce("url", F.lit("")), 256)})
    hits = sum((F.col(f"n_{t}") for t in RETRO_TAGS[1:]), F.col(f"n_{RETRO_TAGS[0]}"))
    p = p.withColumns(
        {
            "text_excerpt": F.substring("text", 1, excerpt_chars),
            "retro_count": hits,
            "retro_signals": F.array_compact(F.array(*[F.when(F.col(f"n_{t}") > 0, F.lit(t)) for t in RETRO_TAGS])),
            "retro_score": F.least(hits / F.lit(3.0), F.lit(1.0)),
            "url_score": F.when(F.size("url_flags") > 0, 1.0).otherwise(0.0),
            "semantic_score": F.least(F.col("token_count") / F.lit(800.0), F.lit(1.0)),
            "anomaly_score": F.lit(0.0),
        }
    )
    return p.drop("text", "marked", *counts)


def page_links(pages: DataFrame) -> DataFrame:
    """One row per distinct target of a page: page_id, pos, url, target, anchor_text, rel, webring; the first mention stays.

    Reads hrefs of every quoting, also of anchors that aren't closed. Relative targets are resolved against
    ``<base href>`` or the page, and every target is canonical. Root-relative and absolute targets of a plain form are
    resolved natively; an Arrow call gets the others only.
    """
    value = r"(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    anchor = rf"(?is)<a(?=\s)[^>]*?(?<![\w-])href\s*=\s*{value}[^>]*>(.*?)(?=</a\s*>|<a\s|\z)"
    either = lambda c, pattern: F.concat(*[F.regexp_extract(c, pattern, k) for k in (1, 2, 3)])
    html = F.coalesce("html", F.lit(""))
    whole = F.regexp_extract_all(F.regexp_replace(html, tx.COMMENT, ""), F.lit(anchor), F.lit(0))
    base = either(html, rf"(?is)<base(?=\s)[^>]*?(?<![\w-])href\s*=\s*{value}")
    # both are read off the page before its anchors become rows, so that no row carries or scans the page again
    read = pages.select("page_id", "url", base.alias("base"), whole.alias("whole"))
    rows = read.select("page_id", "url", F.coalesce(F.nullif("base", F.lit("")), "url").alias("base"), F.posexplode("whole").alias("pos", "a"))
    rel = either("a", rf"(?is)<a(?=\s)[^>]*?(?<![\w-])rel\s*=\s*{value}")
    rows = rows.select("page_id", "url", "base", "pos", F.trim(either("a", anchor)).alias("href"), F.substring(tx.html_text(F.regexp_extract("a", anchor, 4)), 1, 160).alias("anchor_text"), F.array_sort(F.array_distinct(F.filter(F.split(rel, r"\s+"), lambda x: x != ""))).alias("rel"))
    rows = rows.where((F.col("href") != "") & ~F.startswith("href", F.lit("#")))
    origin = F.concat(ur.scheme(F.col("base")), F.lit("://"), ur.netloc(F.col("base")))
    plain = F.when(F.col("href").rlike(r"^/(?!/)[^?#&]*$") & F.col("base").rlike(r"^(?i:https?)://[^&]*$"), F.concat(origin, "href")).when(F.col("href").rlike(r"^(?i:https?)://[^?#&]*$"), F.col("href"))
    rows = rows.withColumn("plain", plain).withColumn("simple", ur.simple(F.col("plain")))
    # one pass over the pages: the Arrow call sees nulls where a target is native
    asked = ur.target_udf(F.when(~F.col("simple"), F.coalesce("plain", "base")), F.when(F.col("plain").isNull(), F.col("href")).otherwise(""))
    rows = rows.withColumn("asked", asked).withColumn("target", F.when(F.col("simple"), ur.native_canonical(F.col("plain"))).otherwise(F.col("asked"))).drop("plain", "simple", "asked")
    rows = rows.where(F.col("target").isNotNull())
    first = rows.groupBy("page_id", "target").agg(F.min(F.struct("pos", "url", "anchor_text", "rel")).alias("m"))
    out = first.select("page_id", "m.pos", "m.url", "target", "m.anchor_text", "m.rel")
    return out.withColumn("webring", F.contains(F.lower("anchor_text"), F.lit("webring")) | F.contains(F.lower("target"), F.lit("webring")))


def outbound_counts(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Per page: links, distinct hosts, webring hits; zeros for pages without links."""
    per = links.groupBy("page_id").agg(F.count("*").alias("outbound_count"), F.count_distinct(ur.netloc(F.col("target"))).alias("outbound_domains"), F.count_if("webring").alias("webring_hits"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return pages.select("page_id").join(per, "page_id", "left").select("page_id", zero("outbound_count"), zero("outbound_domains"), zero("webring_hits"), (F.coalesce("webring_hits", F.lit(0)) > 0).alias("has_webring"))


def same_domain_ratio(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Share of a page's links that stay on its host; null without links or host."""
    own = ur.netloc(F.col("p.url"))
    per = pages.alias("p").join(links.select("page_id", "target"), "page_id", "left").groupBy("page_id", own.alias("host")).agg(F.count("target").alias("n"), F.count_if(ur.netloc(F.col("target")) == own).alias("same"))
    return per.select("page_id", F.when((F.col("n") > 0) & (F.col("host") != ""), F.col("same") / F.col("n")).alias("ratio"))


# --- safety ------------------------------------------------------------------------------------


def illegal_matches(t: Column, keywords=ILLEGAL_KEYWORDS) -> Column:
    """Keywords that occur in ``t``, in order."""
    low = F.lower(F.coalesce(t, F.lit("")))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in sorted({k.strip().lower() for k in keywords if k.strip()})]))


def with_illegal(df: DataFrame, text: str, keywords=ILLEGAL_KEYWORDS, least: int = 1) -> DataFrame:
    """Append illegal and illegal_reason (the first five matches)."""
    m = F.col("__m")
    found = F.size(m) >= least
    return df.withColumn("__m", illegal_matches(F.col(text), keywords)).withColumns({"illegal": found, "illegal_reason": F.when(found, F.array_join(F.slice(m, 1, 5), "; ")).otherwise("")}).drop("__m")


# --- cascade -----------------------------------------------------------------------------------


def structure_metrics(pages: DataFrame, s: CascadeSettings = CascadeSettings()) -> DataFrame:
    """Metrics of the snippet: counts, unrounded ratios, and the flags that the gates need."""
    p = pages.withColumn("snippet", tx.snippet(F.col("html"), s.snippet_bytes))
    p = p.withColumns({"__text": tx.html_text(F.col("snippet")), "__marked": tx.markup(F.col("snippet"))})
    p = p.withColumn("__tags", F.greatest(tx.tag_count(F.col("__marked")), F.lit(1)))
    retro = sum((tx.tag_count(F.col("__marked"), t) for t in SNIPPET_RETRO_TAGS[1:]), tx.tag_count(F.col("__marked"), SNIPPET_RETRO_TAGS[0]))
    return p.withColumns(
        {
            "tokens": tx.space_tokens(F.col("__text")),
            "text_length": F.length("__text").cast("long"),
            "anchor_ratio": tx.tag_count(F.col("__marked"), "a") / F.col("__tags"),
            "script_ratio": tx.tag_count(F.col("__marked"), "script") / F.col("__tags"),
            "text_density": F.length("__text") / F.greatest(F.length("snippet"), F.lit(1)),
            "snippet_retro": F.least(retro / F.lit(3.0), F.lit(1.0)),
            "odd_keyword": tx.first_keyword(F.col("__text"), s.odd_keywords).isNotNull(),
        }
    ).drop("__text", "__marked", "__tags")


def classifier_probability(s: CascadeSettings) -> Column:
    w = s.classifier_weights
    z = F.lit(float(w["bias"])) + w["text_density"] * F.bround("text_density", 4) + w["retro_score"] * F.bround("snippet_retro", 4) + w["script_ratio"] * F.bround("script_ratio", 4) + w["anchor_ratio"] * F.bround("anchor_ratio", 4)
    z = z + w["token_ratio"] * F.least(F.lit(2.0), F.col("tokens") / F.lit(100.0)) + F.when(F.col("odd_keyword"), float(w["odd_keyword"])).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def head_reason(s: CascadeSettings, content_type: Column | None = None, length: Column | None = None) -> Column:
    kind = F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1)))) if content_type is not None else F.lit("")
    own = F.octet_length(F.coalesce("html", F.lit("")))
    n = F.coalesce(length.try_cast("long"), own) if length is not None else own
    wrong = (kind != "") & ~kind.isin(*s.content_types) if s.content_types else F.lit(False)
    return F.when(wrong, F.concat(F.lit("content-type:"), kind)).when(n < s.min_content_length, f"content-length<{s.min_content_length}").when(n > s.max_content_length, f"content-length>{s.max_content_length}")


def prefilter_reasons(s: PrefilterSettings, excerpt: Column, tokens: Column, ratio: Column | None = None, gate: Column | None = None) -> Column:
    """All reasons, in order: too few tokens, a boring keyword, too many links to the same host, a boring embedding.

    A text of 20 characters or more whose embedding is odd enough (gate ``pass``) has no reason, whatever the others say.
    """
    if not s.enabled:
        return F.array().cast("array<string>")
    few = F.when((tokens > 0) & (tokens < s.min_token_count), f"token_count<{s.min_token_count}")
    word = tx.first_keyword(excerpt, s.boring_keywords)
    same = F.when(ratio >= s.max_same_domain_ratio, "outbound_same_domain") if ratio is not None else F.lit(None).cast("string")
    plain = [few, F.when(word.isNotNull(), F.concat(F.lit("keyword:"), word)), same]
    if gate is None:
        return F.array_compact(F.array(*plain))
    near = F.when(F.length(F.coalesce(excerpt, F.lit(""))) >= 20, gate)
    found = F.array_compact(F.array(*plain, F.when(near == "boring_embedding", near)))
    return F.when(near == "pass", F.array().cast("array<string>")).otherwise(found)


STAGES = ("head", "snippet", "structure", "keywords", "simhash", "classifier", "prefilter")


def cascade(pages: DataFrame, s: CascadeSettings = CascadeSettings(), pre: PrefilterSettings = PrefilterSettings(), content_type: str | None = None, content_length: str | None = None, same_domain: str | None = None, gate: str | None = None) -> DataFrame:
    """page_id, stage (where a page stopped, or null), reason, override, probability and stages (name:status of each).

    Gates run from cheap to dear. The fingerprint stage sees only the text of pages that reach it; of those with one
    fingerprint the first by arrival goes on. The first is aggregated and joined back, so that a page that very many
    repeat is no single task's work. ``same_domain`` (share of links to the own host) and ``gate`` (of ``centroid_gate``)
    name columns of ``pages`` that the prefilter looks at too.
    """
    p = structure_metrics(pages, s)
    head = head_reason(s, F.col(content_type) if content_type else None, F.col(content_length) if content_length else None)
    snippet = F.when(F.col("html").isNull(), "body-missing").when(F.length(tx.stripped(F.coalesce("snippet", F.lit("")))) == 0, "empty-snippet")
    low = F.col("text_density") < s.min_text_density
    override = F.when(low, F.when(F.col("tokens") >= s.density_token_override, "token").when(F.col("snippet_retro") >= s.retro_override_score, "retro").when(F.col("anchor_ratio") >= s.density_anchor_override, "anchor").when(F.col("odd_keyword"), "keyword").when(F.col("tokens") > s.density_skip_token_cap, "low_density"))
    structure = F.when(F.col("script_ratio") > s.max_script_ratio, f"script-ratio>{s.max_script_ratio}").when(F.col("anchor_ratio") > s.max_anchor_ratio, f"anchor-ratio>{s.max_anchor_ratio}").when(low & override.isNull(), f"text-density<{s.min_text_density}")
    word = tx.first_keyword(F.col("snippet"), s.boring_keywords)
    p = p.withColumns({"r1": head, "r2": snippet, "r3": structure, "override": override, "r4": F.when(word.isNotNull(), F.concat(F.lit("keyword:"), F.lower(word))), "probability": classifier_probability(s)})
    excerpt = tx.snippet(F.col("html"), 1200)
    words = F.size(F.regexp_extract_all(tx.snippet(F.col("html"), 2048), F.lit(tx.WORD), F.lit(0)))
    ratio, near = (F.col(c) if c else None for c in (same_domain, gate))
    p = p.withColumn("r7", F.nullif(F.array_join(prefilter_reasons(pre, excerpt, words, ratio, near), ";"), F.lit("")))
    p = p.withColumn("r6", F.when(F.col("probability") < s.classifier_threshold, f"classifier<{s.classifier_threshold}"))
    early = F.coalesce("r1", "r2", "r3", "r4")
    fp = simhash64(F.when(early.isNull(), F.col("snippet"))) if s.simhash else F.lit(None).cast("long")
    slim = p.select("page_id", "r1", "r2", "r3", "r4", "r6", "r7", "override", "probability", fp.alias("fp"))
    # Written once: what follows uses these few columns several times, and each page's text is handled only here.
    slim = stored(slim.withColumn("fp", F.when(early.isNull(), F.col("fp"))), "cascade")
    first = slim.where("fp IS NOT NULL").groupBy("fp").agg(F.min("page_id").alias("first"))
    p = slim.join(first, "fp", "left").withColumn("r5", F.when(F.col("page_id") != F.col("first"), "simhash-duplicate"))
    reasons = [F.col(f"r{i + 1}") for i in range(7)]
    stopped = F.coalesce(*[F.when(r.isNotNull(), F.lit(i)) for i, r in enumerate(reasons)], F.lit(7))
    status = lambda i: F.when(stopped == i, "skip").when(F.lit(i == 2) & F.col("override").isNotNull(), "warn").otherwise("pass")
    stages = F.array_compact(F.array(*[F.when(stopped >= i, F.concat(F.lit(f"{n}:"), status(i))) for i, n in enumerate(STAGES)]))
    return p.select("page_id", F.element_at(F.array(*[F.lit(n) for n in STAGES], F.lit(None)), stopped + 1).alias("stage"), F.coalesce(*reasons).alias("reason"), F.when((stopped > 2), F.col("override")).alias("override"), F.when(stopped >= 5, F.col("probability")).alias("probability"), F.col("fp").alias("fingerprint"), stages.alias("stages"))


def cascade_metrics(decisions: DataFrame) -> DataFrame:
    """One row: skips, passes, pages with any warning, and how often each override was given."""
    warned = F.exists("stages", lambda s: F.endswith(s, F.lit(":warn")))
    per = decisions.groupBy("override").agg(F.count("*").alias("n"), F.count_if(F.col("stage").isNotNull()).alias("skips"), F.count_if(F.col("stage").isNull()).alias("passes"), F.count_if(warned).alias("warns"))
    tally = F.collect_list(F.when(F.col("override").isNotNull() & (F.col("warns") > 0), F.struct("override", F.col("warns").alias("n"))))  # one entry an override
    return per.agg(F.coalesce(F.sum("skips"), F.lit(0)).alias("skips"), F.coalesce(F.sum("passes"), F.lit(0)).alias("passes"), F.coalesce(F.sum("warns"), F.lit(0)).alias("warns"), F.map_from_entries(F.array_sort(tally)).alias("overrides"))


def stage_counts(decisions: DataFrame) -> DataFrame:
    """Pages per stage and status."""
    each = decisions.select(F.explode("stages").alias("s"))
    return each.groupBy(F.split_part("s", F.lit(":"), F.lit(1)).alias("stage"), F.split_part("s", F.lit(":"), F.lit(2)).alias("status")).agg(F.count("*").alias("pages"))


def override_counts(decisions: DataFrame) -> DataFrame:
    """Pages per override, of those that the structure gate let pass with a warning."""
    return decisions.where(F.exists("stages", lambda s: F.endswith(s, F.lit(":warn")))).groupBy("override").agg(F.count("*").alias("pages"))


def verdict_counts(decisions: DataFrame) -> DataFrame:
    """One row: pages that passed every gate, that were stopped, and that have a warning of any gate."""
    return decisions.agg(F.count_if(F.col("stage").isNull()).alias("passes"), F.count_if(F.col("stage").isNotNull()).alias("skips"), F.count_if(F.exists("stages", lambda s: F.endswith(s, F.lit(":warn")))).alias("warned"))


# --- scores ------------------------------------------------------------------------------------


def fused(retro: Column, url: Column, semantic: Column, anomaly: Column, graph: Column, s: FusionSettings = FusionSettings()) -> Column:
    w, zero = s.weights, lambda c: F.coalesce(c, F.lit(0.0))
    raw = w["retro_html"] * zero(retro) + w["url_weird"] * zero(url) + w["semantic"] * zero(semantic) + w["anomaly"] * zero(anomaly) + w["graph"] * zero(graph) + F.lit(float(w["bias"]))
    return 1 / (1 + F.exp(-raw))


def action(score: Column, s: FusionSettings = FusionSettings()) -> Column:
    return F.when(score >= s.llm_gate, "llm").when(score >= s.persist, "persist").otherwise("skip")


def thresholds_hit(score: Column, s: FusionSettings = FusionSettings()) -> Column:
    """persist always, with its threshold; llm and alert once they are reached."""
    return F.map_filter(F.create_map(F.lit("persist"), F.lit(s.persist), F.lit("llm"), F.when(score >= s.llm_gate, F.lit(s.llm_gate)), F.lit("alert"), F.when(score >= s.alert, F.lit(s.alert))), lambda k, v: v.isNotNull())


def score_reasons(retro: Column, flags: Column, webring: Column, size: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(F.size(retro) > 0, F.concat(F.lit("retro HTML signals: "), F.array_join(retro, ", "))),
            F.when(F.size(flags) > 0, F.concat(F.lit("url oddities: "), F.array_join(flags, ", "))),
            F.when(webring, F.lit("possible webring membership")),
            F.when((size > 0) & (size <= 3), F.concat(F.lit("small link neighborhood (size="), size.cast("int").cast("string"), F.lit(")"))),
        )
    )


def scored(pages: DataFrame, graph: DataFrame | None = None, s: FusionSettings = FusionSettings()) -> DataFrame:
    """Features, score, action, reasons and thresholds; ``graph`` has page_id, graph_score, component_size and has_webring."""
    p = with_features(pages)
    if graph is None:
        p = p.withColumns({"graph_score": F.lit(0.0), "component_size": F.lit(None).cast("long"), "has_webring": F.lit(False)})
    else:
        p = p.join(graph.select("page_id", "graph_score", "component_size", "has_webring"), "page_id", "left")
    p = p.withColumn("score", fused(F.col("retro_score"), F.col("url_score"), F.col("semantic_score"), F.col("anomaly_score"), F.col("graph_score"), s))
    return p.withColumns({"action": action(F.col("score"), s), "reasons": score_reasons(F.col("retro_signals"), F.col("url_flags"), F.col("has_webring"), F.col("component_size")), "thresholds_hit": thresholds_hit(F.col("score"), s)})


def findings(decided: DataFrame, fetched_at: Column | None = None) -> DataFrame:
    """The finding that stands in where no analyst is at hand, for pages with action llm."""
    why = F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("auto-escalated")))
    own = F.trim(F.coalesce("text_excerpt", F.lit("")))
    text = F.when(own != "", own).otherwise(F.concat(F.lit("Page at "), F.coalesce("url", F.lit("")), F.lit(" flagged because "), F.array_join(why, ", "), F.lit(".")))
    short = F.when(F.length(text) > 360, F.concat(F.rtrim(F.substring(text, 1, 357)), F.lit("..."))).otherwise(text)
    when = F.coalesce(fetched_at.cast("string"), F.lit("unknown")) if fetched_at is not None else F.lit("unknown")
    return decided.where("action = 'llm'").select(
        "page_id", "url", short.alias("summary"), why.alias("why_flagged"), F.when(F.size("retro_signals") > 0, "harmless-retro").otherwise("unknown").alias("risk_tag"),
        F.struct(F.lit(False).alias("present"), F.lit("none").alias("category"), F.lit("").alias("notes")).alias("dangerous_content"),
        F.round("score", 2).alias("confidence"), F.concat(F.lit("observation:"), when, F.lit(":"), F.substring("url_sha256", 1, 8)).alias("observation_ref"),
    )


def category(c: Column) -> Column:
    return F.when(c.isin(*DANGER_CATEGORIES), c).otherwise("other")


def breadcrumbs(found: DataFrame, salt: str = "2025Q1", excerpt_chars: int = 200) -> DataFrame:
    """Breadcrumbs of dangerous findings: url, notes, why_flagged, category, present, observed_at, url_hash and excerpt are read."""
    why = F.array_join(F.filter(F.transform("why_flagged", lambda x: F.trim(x)), lambda x: x != ""), "; ")
    reason = F.when(F.coalesce("notes", F.lit("")) != "", F.trim("notes")).when(why != "", F.substring(why, 1, 300)).otherwise("dangerous-content")
    text = F.when(F.coalesce("excerpt", F.lit("")) != "", F.substring(tx.stripped(F.col("excerpt")), 1, excerpt_chars))
    return found.where("present").select(F.coalesce(F.nullif("url_hash", F.lit("")), F.sha2("url", 256)).alias("url_hash"), "observed_at", category(F.col("category")).alias("category"), reason.alias("reason"), F.lit("analyst").alias("source"), F.lit(salt).alias("salt_version"), text.alias("excerpt_redacted"))


def breadcrumb_fault(excerpt_chars: int = 200) -> Column:
    """Why a breadcrumb is invalid, else null."""
    return F.when(F.coalesce("url_hash", F.lit("")) == "", "url_hash").when(F.length("excerpt_redacted") > excerpt_chars, "excerpt").when(F.col("observed_at").isNull(), "observed_at")


def sanitized(df: DataFrame, max_chars: int = 5000) -> DataFrame:
    """Without raw content; the excerpt cut."""
    kept = df.drop("raw_html", "content", "raw_content", "html")
    return kept.withColumn("text_excerpt", F.substring("text_excerpt", 1, max_chars)) if "text_excerpt" in kept.columns else kept


def url_hash() -> Column:
    """The first hash that is there, else that of the URL."""
    return F.coalesce(F.nullif("url_sha256", F.lit("")), F.nullif("url_sha1", F.lit("")), F.nullif("url_md5", F.lit("")), F.sha2("url", 256))


def outcomes(pages: DataFrame, s: CascadeSettings = CascadeSettings(), pre: PrefilterSettings = PrefilterSettings(), fusion: FusionSettings = FusionSettings(), graph: DataFrame | None = None) -> DataFrame:
    """The whole course of every page: illegal, skipped by the cascade, or scored; one row each.

    Early exits are filters, so later stages never see what earlier ones stopped.
    """
    scanned = with_illegal(pages, "html")
    blank = lambda *cs: [F.lit(None).cast(t).alias(c) for c, t in cs]
    illegal = scanned.where("illegal").select("page_id", "url", F.lit("illegal").alias("outcome"), F.col("illegal_reason").alias("reason"), *blank(("score", "double")), F.lit("skip").alias("action"))
    decided = cascade(scanned.where("NOT illegal"), s, pre)
    skipped = decided.where("stage IS NOT NULL").join(pages.select("page_id", "url"), "page_id").select("page_id", "url", F.lit("cascade").alias("outcome"), "reason", *blank(("score", "double")), F.lit("skip").alias("action"))
    alive = pages.join(decided.where("stage IS NULL").select("page_id"), "page_id", "left_semi")
    post = with_illegal(scored(alive, graph, fusion), "text_excerpt").select("page_id", "url", "illegal", "illegal_reason", "reasons", "score", "action")
    post = stored(post, "scored")
    late = post.where("illegal").select("page_id", "url", F.lit("illegal").alias("outcome"), F.col("illegal_reason").alias("reason"), *blank(("score", "double")), F.lit("skip").alias("action"))
    done = post.where("NOT illegal").select("page_id", "url", F.lit("scored").alias("outcome"), F.array_join("reasons", "; ").alias("reason"), "score", "action")
    return illegal.unionByName(skipped).unionByName(late).unionByName(done)
