"""Queries over pages and documents, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from pagesieve.config import ILLEGAL_KEYWORDS, ODD_KEYWORDS, RETRO_TAGS, CascadeSettings, PrefilterSettings
from pagesieve.functions import fingerprints as fp
from pagesieve.functions import text as tx
from pagesieve.functions import urls as ur
from pagesieve.operators import pages as op
from pagesieve.storage import stored

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(*ws):
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


TEXT = tx.sql_html_text("html")
MARK = tx.sql_markup("html")
RETRO = " + ".join(tx.sql_tags("m", t) for t in RETRO_TAGS)
FLAGS = "list_filter([CASE WHEN contains(lower(url), 'cgi-bin') THEN 'cgi-bin' END, CASE WHEN contains(url, '/~') THEN 'tilde_home' END, CASE WHEN starts_with(url, 'http://') THEN 'insecure' END], lambda x: x IS NOT NULL)"
NETLOC = r"lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1))"
FEATURES = f"""
f AS (SELECT page_id, url, html, {TEXT} AS t, {MARK} AS m FROM pages),
g AS (SELECT *, {tx.sql_tokens('t')} AS tokens, {RETRO} AS retro, {FLAGS} AS flags FROM f),
s AS (SELECT *, least(retro / 3.0, 1.0) AS retro_score, CASE WHEN len(flags) > 0 THEN 1.0 ELSE 0.0 END AS url_score, least(tokens / 800.0, 1.0) AS semantic FROM g),
z AS (SELECT *, 1 / (1 + exp(-(0.25 * retro_score + 0.10 * url_score + 0.30 * semantic))) AS score FROM s)
"""


@query("page_features", f"WITH {FEATURES} SELECT page_id, tokens AS token_count, retro AS retro_count, CAST(round(retro_score, 6) AS DOUBLE) AS retro_score, array_to_string(flags, ',') AS url_flags, CAST(url_score AS DOUBLE) AS url_score, CAST(round(semantic, 6) AS DOUBLE) AS semantic_score FROM s")
def page_features(spark, d):
    f = op.with_features(table(spark, d, "pages"))
    return f.select("page_id", "token_count", "retro_count", F.round("retro_score", 6).alias("retro_score"), F.array_join("url_flags", ",").alias("url_flags"), "url_score", F.round("semantic_score", 6).alias("semantic_score"))


TITLE = r"regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$', '', 'g')"
TITLE = tx.sql_unescaped(TITLE)


@query("page_title_excerpt", f"SELECT page_id, {TITLE} AS title, left({TEXT}, 500) AS text_excerpt FROM pages")
def page_title_excerpt(spark, d):
    return op.with_features(table(spark, d, "pages")).select("page_id", "title", "text_excerpt")


@query("page_hashes", "SELECT page_id, sha256(html) AS content_sha256, sha256(url) AS url_sha256, left(sha256(url), 2) AS shard, sha1(url) AS url_sha1 FROM pages")
def page_hashes(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("content_sha256"), F.sha2("url", 256).alias("url_sha256"), F.substring(F.sha2("url", 256), 1, 2).alias("shard"), F.sha1(F.col("url").cast("binary")).alias("url_sha1"))


@query("fetch_metrics", "SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS bytes_downloaded, 200 AS status FROM pages")
def fetch_metrics(spark, d):
    """Size of the body where no count of downloaded bytes came with it."""
    return table(spark, d, "pages").select("page_id", F.coalesce(F.lit(None).cast("long"), F.octet_length("html").cast("long")).alias("bytes_downloaded"), F.lit(200).alias("status"))


@query("url_host_parts", f"SELECT page_id, {NETLOC.format('url')} AS netloc, split_part(url, ':', 1) AS scheme FROM pages")
def url_host_parts(spark, d):
    return table(spark, d, "pages").select("page_id", ur.netloc(F.col("url")).alias("netloc"), ur.scheme(F.col("url")).alias("scheme"))


@query("url_scheme_gate", "SELECT page_id, url LIKE 'https://%' AND url NOT LIKE 'https:///%' AS allowed FROM pages")
def url_scheme_gate(spark, d):
    return table(spark, d, "pages").select("page_id", ur.allowed(F.col("url"), ("https",)).alias("allowed"))


@query("tor_route", "SELECT page_id, lower(regexp_extract(url, '://([^/:?#]*)', 1)) LIKE '%.org' OR lower(regexp_extract(url, '://([^/:?#]*)', 1)) IN ('tionsh.example.net') AS routed FROM pages")
def tor_route(spark, d):
    """Routing by a host suffix or a list of hosts (here: suffix .org)."""
    return table(spark, d, "pages").select("page_id", ur.routed(F.col("url"), domains=["tionsh.example.net"], suffix=".org").alias("routed"))


CANONICAL = f"split_part(url, ':', 1) || '://' || {NETLOC.format('url')} || coalesce(nullif(regexp_extract(url, '^[^:]+://[^/?#]*(/[^?#]*)', 1), ''), '/') || CASE WHEN contains(url, '?') THEN '?' || array_to_string(list_sort(string_split(split_part(split_part(url, '#', 1), '?', 2), '&')), '&') ELSE '' END"


@query("url_canonical", f"SELECT page_id, {CANONICAL} AS url_canonical FROM pages")
def url_canonical(spark, d):
    got = ur.with_canonical(table(spark, d, "pages").select("page_id", "url"))
    return got.select("page_id", "url_canonical")


@query("url_canonical_all", f"SELECT page_id, {CANONICAL} AS url_canonical, CASE WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'no-scheme' WHEN {NETLOC.format('url')} = '' THEN 'no-host' END AS url_canonical_reason FROM pages")
def url_canonical_all(spark, d):
    return ur.with_canonical(table(spark, d, "pages").select("page_id", "url")).select("page_id", "url_canonical", "url_canonical_reason")


def sql_snippet(size: int) -> str:
    """The first bytes of html as text, without a character that the cut splits."""
    chars = f"(SELECT c, i, sum(octet_length(encode(c))) OVER (ORDER BY i) AS b FROM (SELECT unnest(string_split(left(html, {size}), '')) AS c, unnest(range(length(left(html, {size})))) AS i))"
    return f"CASE WHEN octet_length(encode(html)) <= {size} THEN html ELSE (SELECT string_agg(c, '' ORDER BY i) FROM {chars} WHERE b <= {size}) END"


METRICS = f"""
n AS (SELECT page_id, url, html, {sql_snippet(8192)} AS sn FROM pages),
t AS (SELECT page_id, url, html, sn, {tx.sql_html_text('sn')} AS t, {tx.sql_markup('sn')} AS m FROM n),
c AS (SELECT page_id, url, html, sn, t, {tx.sql_tokens('t')} AS tokens, greatest({tx.sql_tags('m')}, 1) AS tags, {tx.sql_tags('m', 'a')} AS anchors, {tx.sql_tags('m', 'script')} AS scripts,
  {tx.sql_tags('m', 'marquee')} + {tx.sql_tags('m', 'blink')} + {tx.sql_tags('m', 'font')} + {tx.sql_tags('m', 'center')} AS retro FROM t),
k AS (SELECT page_id, url, html, sn, tokens, length(t) AS text_length, anchors / tags AS anchor_ratio, scripts / tags AS script_ratio, length(t) / greatest(length(sn), 1) AS text_density, least(retro / 3.0, 1.0) AS snippet_retro,
  {tx.sql_first_keyword('t', ODD_KEYWORDS)} IS NOT NULL AS odd_keyword FROM c)
"""
LOGIT = "-1.59 + 0.29 * round_even(text_density, 4) + 0.04 * round_even(snippet_retro, 4) - 0.35 * round_even(script_ratio, 4) + 0.75 * round_even(anchor_ratio, 4) + 3.01 * least(2.0, tokens / 100.0) + CASE WHEN odd_keyword THEN 0.89 ELSE 0 END"


@query("structure_metrics", f"WITH {METRICS} SELECT page_id, tokens, text_length, round(anchor_ratio, 6) AS anchor_ratio, round(script_ratio, 6) AS script_ratio, round(text_density, 6) AS text_density, CAST(round(snippet_retro, 6) AS DOUBLE) AS snippet_retro, odd_keyword FROM k")
def structure_metrics(spark, d):
    m = op.structure_metrics(table(spark, d, "pages"))
    return m.select("page_id", "tokens", "text_length", *[F.round(c, 6).alias(c) for c in ("anchor_ratio", "script_ratio", "text_density", "snippet_retro")], "odd_keyword")


@query("cascade_head", "SELECT page_id, CASE WHEN octet_length(encode(html)) < 1024 THEN 'content-length<1024' WHEN octet_length(encode(html)) > 8192 THEN 'content-length>8192' END AS reason FROM pages")
def cascade_head(spark, d):
    """The first gate with tight lengths, so that both sides fire."""
    s = CascadeSettings(min_content_length=1024, max_content_length=8192)
    return table(spark, d, "pages").select("page_id", op.head_reason(s).alias("reason"))


@query("cascade_keywords", f"WITH {METRICS} SELECT page_id, 'keyword:' || {tx.sql_first_keyword('sn', ('guest', 'chau', 'tion'))} AS reason FROM k")
def cascade_keywords(spark, d):
    m = op.structure_metrics(table(spark, d, "pages"))
    return m.select("page_id", F.concat(F.lit("keyword:"), tx.first_keyword(F.col("snippet"), ("guest", "chau", "tion"))).alias("reason"))


@query("cascade_classifier", f"WITH {METRICS} SELECT page_id, round(1 / (1 + exp(-({LOGIT}))), 6) AS probability FROM k")
def cascade_classifier(spark, d):
    m = op.structure_metrics(table(spark, d, "pages"))
    return m.select("page_id", F.round(op.classifier_probability(CascadeSettings()), 6).alias("probability"))


TIGHT = CascadeSettings(min_content_length=900, max_content_length=60_000, max_anchor_ratio=0.42, min_text_density=0.45, density_token_override=200, density_skip_token_cap=60, classifier_threshold=0.8, boring_keywords=("chau", "stion the"), simhash=False)
TIGHT_PRE = PrefilterSettings(min_token_count=200, boring_keywords=("ouchau", "oiment"))
TIGHT_SQL = f"""
{METRICS},
r AS (SELECT *, CASE WHEN octet_length(encode(html)) < 900 THEN 'content-length<900' WHEN octet_length(encode(html)) > 60000 THEN 'content-length>60000' END AS r1,
  CASE WHEN anchor_ratio >= 0.35 THEN 1 ELSE 0 END AS anchored,
  CASE WHEN text_density < 0.45 THEN CASE WHEN tokens >= 200 THEN 'token' WHEN snippet_retro >= 0.3 THEN 'retro' WHEN anchor_ratio >= 0.35 THEN 'anchor' WHEN odd_keyword THEN 'keyword' WHEN tokens > 60 THEN 'low_density' END END AS ov,
  {tx.sql_first_keyword('sn', ('chau', 'stion the'))} AS kw, 1 / (1 + exp(-({LOGIT}))) AS prob FROM k),
q AS (SELECT page_id, r1, CASE WHEN script_ratio > 0.55 THEN 'script-ratio>0.55' WHEN anchor_ratio > 0.42 THEN 'anchor-ratio>0.42' WHEN text_density < 0.45 AND ov IS NULL THEN 'text-density<0.45' END AS r3, ov,
  'keyword:' || kw AS r4, CASE WHEN prob < 0.8 THEN 'classifier<0.8' END AS r6, prob FROM r)
"""


@query("cascade_outcome", f"WITH {TIGHT_SQL} SELECT page_id, CASE WHEN r1 IS NOT NULL THEN 'head' WHEN r3 IS NOT NULL THEN 'structure' WHEN r4 IS NOT NULL THEN 'keywords' WHEN r6 IS NOT NULL THEN 'classifier' END AS stage, coalesce(r1, r3, r4, r6) AS reason, CASE WHEN r1 IS NULL AND r3 IS NULL THEN ov END AS override FROM q")
def cascade_outcome(spark, d):
    """All native gates with tightened limits; the prefilter is off."""
    return op.cascade(table(spark, d, "pages"), TIGHT, PrefilterSettings(enabled=False)).select("page_id", "stage", "reason", "override")


@query("cascade_stage_counts", f"""WITH {TIGHT_SQL},
e AS (SELECT unnest([
  'head:' || CASE WHEN r1 IS NOT NULL THEN 'skip' ELSE 'pass' END,
  CASE WHEN r1 IS NULL THEN 'snippet:pass' END,
  CASE WHEN r1 IS NULL THEN 'structure:' || CASE WHEN r3 IS NOT NULL THEN 'skip' WHEN ov IS NOT NULL THEN 'warn' ELSE 'pass' END END,
  CASE WHEN coalesce(r1, r3) IS NULL THEN 'keywords:' || CASE WHEN r4 IS NOT NULL THEN 'skip' ELSE 'pass' END END,
  CASE WHEN coalesce(r1, r3, r4) IS NULL THEN 'simhash:pass' END,
  CASE WHEN coalesce(r1, r3, r4) IS NULL THEN 'classifier:' || CASE WHEN r6 IS NOT NULL THEN 'skip' ELSE 'pass' END END,
  CASE WHEN coalesce(r1, r3, r4, r6) IS NULL THEN 'prefilter:pass' END]) AS s FROM q)
SELECT split_part(s, ':', 1) AS stage, split_part(s, ':', 2) AS status, count(*) AS pages FROM e WHERE s IS NOT NULL GROUP BY 1, 2""")
def cascade_stage_counts(spark, d):
    return op.stage_counts(op.cascade(table(spark, d, "pages"), TIGHT, PrefilterSettings(enabled=False)))


WARNED = "r1 IS NULL AND r3 IS NULL AND ov IS NOT NULL"
#: A density that many pages are below, so that overrides let them pass.
DENSE, DENSE_SQL = replace(TIGHT, min_text_density=0.7), TIGHT_SQL.replace("0.45", "0.7")


@query("cascade_overrides", f"WITH {DENSE_SQL} SELECT ov AS override, count(*) AS pages FROM q WHERE {WARNED} GROUP BY 1")
def cascade_overrides(spark, d):
    return op.override_counts(op.cascade(table(spark, d, "pages"), DENSE, PrefilterSettings(enabled=False)))


@query("cascade_verdicts", f"WITH {DENSE_SQL} SELECT count(*) FILTER (coalesce(r1, r3, r4, r6) IS NULL) AS passes, count(*) FILTER (coalesce(r1, r3, r4, r6) IS NOT NULL) AS skips, count(*) FILTER ({WARNED}) AS warned FROM q")
def cascade_verdicts(spark, d):
    return op.verdict_counts(op.cascade(table(spark, d, "pages"), DENSE, PrefilterSettings(enabled=False)))


@query("cascade_prefilter", f"""WITH {TIGHT_SQL}, g AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN NULL ELSE nullif(concat_ws(';', CASE WHEN page_id % 10 >= 8 THEN 'outbound_same_domain' END, CASE WHEN page_id % 7 = 1 THEN 'boring_embedding' END), '') END AS r7 FROM pages)
SELECT page_id, CASE WHEN r1 IS NOT NULL THEN 'head' WHEN r3 IS NOT NULL THEN 'structure' WHEN r4 IS NOT NULL THEN 'keywords' WHEN r6 IS NOT NULL THEN 'classifier' WHEN r7 IS NOT NULL THEN 'prefilter' END AS stage, coalesce(r1, r3, r4, r6, r7) AS reason FROM q JOIN g USING (page_id)""")
def cascade_prefilter(spark, d):
    """The cascade with shares of links and embedding gates that stand in for measured ones (both made of the id)."""
    k = F.col("page_id")
    p = table(spark, d, "pages").withColumns({"ratio": (k % 10) / 10, "gate": F.when(k % 7 == 0, "pass").when(k % 7 == 1, "boring_embedding").otherwise("open")})
    pre = PrefilterSettings(min_token_count=0, boring_keywords=(), max_same_domain_ratio=0.8)
    return op.cascade(p, TIGHT, pre, same_domain="ratio", gate="gate").select("page_id", "stage", "reason")


VOTES = r"""
sim_w AS (SELECT {id}, unnest(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+')) AS w FROM {src}),
sim_c AS (SELECT {id}, w, count(*) AS n FROM sim_w GROUP BY 1, 2),
sim_h AS (SELECT w, right(sha256('\x00\x00\x00\x00'::BLOB || encode(w)), 16) AS h FROM (SELECT DISTINCT w FROM sim_c)),
sim_v AS (SELECT w, i, (CAST(('0x' || h[1 + i // 4]) AS INTEGER) >> (3 - i % 4)) & 1 AS bit FROM sim_h, range(64) r(i)),
sim_b AS (SELECT {id}, i, sum(CASE WHEN bit = 1 THEN n ELSE -n END) >= 0 AS on_ FROM sim_c JOIN sim_v USING (w) GROUP BY 1, 2),
sim AS (SELECT {id}, string_agg(CASE WHEN on_ THEN '1' ELSE '0' END, '' ORDER BY i) AS bits FROM sim_b GROUP BY 1)
"""


@query("doc_simhash", "WITH " + VOTES.format(id="doc_id", t="text", src="documents") + " SELECT d.doc_id, coalesce(bits, repeat('0', 64)) AS bits FROM documents d LEFT JOIN sim USING (doc_id)")
def doc_simhash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lpad(F.bin(fp.simhash64(F.col("text"))), 64, "0").alias("bits"))


@query("simhash_dedupe", "WITH " + VOTES.format(id="doc_id", t="text", src="documents") + " SELECT doc_id, row_number() OVER (PARTITION BY bits ORDER BY doc_id) > 1 AS duplicate FROM (SELECT d.doc_id, coalesce(bits, '0') AS bits FROM documents d LEFT JOIN sim USING (doc_id))")
def simhash_dedupe(spark, d):
    """Exact repetition of a fingerprint, by arrival; the first is aggregated and joined back, so a hot one is no task's work."""
    p = stored(table(spark, d, "documents").select("doc_id", fp.simhash64(F.col("text")).alias("fp")), "fingerprints")  # both sides of the join read it
    first = p.groupBy("fp").agg(F.min("doc_id").alias("first"))
    return p.join(first, "fp").select("doc_id", (F.col("doc_id") != F.col("first")).alias("duplicate"))


@query("simhash_near_pairs", "WITH " + VOTES.format(id="doc_id", t="text", src="documents") + """, g AS (SELECT bits, min(doc_id) AS doc_id FROM sim GROUP BY bits)
SELECT a.doc_id AS a, b.doc_id AS b, CAST(len(list_filter(range(1, 65), lambda i: a.bits[i] <> b.bits[i])) AS INTEGER) AS distance FROM g a JOIN g b ON a.doc_id < b.doc_id
WHERE len(list_filter(range(1, 65), lambda i: a.bits[i] <> b.bits[i])) <= 3""")
def simhash_near_pairs(spark, d):
    """Pairs of distinct fingerprints at a Hamming distance of at most 3.

    Of five parts of a fingerprint at least two agree in such a pair, so each fingerprint is looked up by its ten pairs
    of parts (25 or 26 bits). Equal fingerprints are one row with their smallest id: groups of copies aren't paired off.
    """
    # written before it is filtered: a filter would move below the call and make each fingerprint a second time
    p = stored(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", fp.simhash64(F.col("text")).alias("fp")), "made-fingerprints")
    p = stored(p.where("fp <> 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fingerprints")  # both sides of the join read it
    parts = [F.shiftrightunsigned("fp", 13 * i).bitwiseAND(8191) for i in range(5)]
    keys = [F.shiftleft(parts[i], 13).bitwiseOR(parts[j]) for i in range(5) for j in range(i)]
    q = p.select("doc_id", "fp", F.posexplode(F.array(*keys)).alias("k", "v"))
    a, b = q.alias("a"), q.alias("b")
    near = fp.hamming(F.col("a.fp"), F.col("b.fp"))
    return a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.doc_id") < F.col("b.doc_id")) & (near <= 3)).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), near.cast("int").alias("distance")).distinct()


@query("token_counts", r"SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS BIGINT) AS word_tokens, " + tx.sql_tokens("text") + " AS space_tokens FROM documents")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tx.word_tokens(F.col("text"))).cast("long").alias("word_tokens"), tx.space_tokens(F.col("text")).alias("space_tokens"))


KW = ("haon", "tion the", "schen", "ther")


@query("illegal_scan", "WITH m AS (SELECT doc_id, list_filter(" + words(*sorted(KW)) + ", lambda k: contains(lower(text), k)) AS ks FROM documents) SELECT doc_id, len(ks) >= 2 AS illegal, CASE WHEN len(ks) >= 2 THEN array_to_string(ks[1:5], '; ') ELSE '' END AS reason FROM m")
def illegal_scan(spark, d):
    """The keyword scan with two matches needed, by words that occur here."""
    return op.with_illegal(table(spark, d, "documents"), "text", KW, 2).select("doc_id", "illegal", F.col("illegal_reason").alias("reason"))


@query("boring_first_keyword", f"SELECT doc_id, {tx.sql_first_keyword('text', KW)} AS keyword FROM documents")
def boring_first_keyword(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.first_keyword(F.col("text"), KW).alias("keyword"))


@query("prefilter_reasons", "SELECT doc_id, concat_ws(';', CASE WHEN t > 0 AND t < 40 THEN 'token_count<40' END, 'keyword:' || k) AS reasons FROM (SELECT doc_id, " + tx.sql_tokens("text") + f" AS t, {tx.sql_first_keyword('text', KW)} AS k FROM documents)")
def prefilter_reasons(spark, d):
    got = op.prefilter_reasons(PrefilterSettings(boring_keywords=KW), F.col("text"), tx.space_tokens(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.array_join(got, ";").alias("reasons"))


ANCHOR = r'(?is)<a\b[^>]*\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a\s*>'
LINKS = f"""
x AS (SELECT page_id, url, unnest(regexp_extract_all(regexp_replace(html, '{tx.COMMENT}', '', 'g'), '{ANCHOR}')) AS a, unnest(range(len(regexp_extract_all(regexp_replace(html, '{tx.COMMENT}', '', 'g'), '{ANCHOR}')))) AS pos FROM pages),
y AS (SELECT page_id, url, pos, trim(regexp_extract(a, '{ANCHOR}', 1)) AS href, left({tx.sql_html_text("regexp_extract(a, '" + ANCHOR + "', 2)")}, 160) AS anchor_text FROM x),
u AS (SELECT page_id, url, pos, anchor_text, CASE WHEN starts_with(href, '/') AND NOT starts_with(href, '//') THEN split_part(url, ':', 1) || '://' || {NETLOC.format('url')} || regexp_replace(href, '#.*$', '') WHEN regexp_matches(href, '^https?://') THEN regexp_replace(href, '#.*$', '') END AS target FROM y WHERE href <> '' AND NOT starts_with(href, '#')),
l AS (SELECT page_id, url, target, arg_min(anchor_text, pos) AS anchor_text, min(pos) AS pos FROM u WHERE target IS NOT NULL GROUP BY 1, 2, 3)
"""


@query("page_links", f"WITH {LINKS} SELECT page_id, CAST(pos AS INTEGER) AS pos, target, anchor_text FROM l")
def page_links(spark, d):
    return op.page_links(table(spark, d, "pages")).select("page_id", "pos", "target", "anchor_text")


@query("outbound_counts", f"WITH {LINKS} SELECT p.page_id, count(target) AS outbound_count, count(DISTINCT {NETLOC.format('target')}) AS outbound_domains, count(*) FILTER (contains(lower(anchor_text), 'webring') OR contains(lower(target), 'webring')) AS webring_hits FROM pages p LEFT JOIN l USING (page_id) GROUP BY 1")
def outbound_counts(spark, d):
    p = table(spark, d, "pages")
    return op.outbound_counts(p, op.page_links(p)).drop("has_webring")


@query("same_domain_ratio", f"WITH {LINKS} SELECT p.page_id, round(avg(CASE WHEN {NETLOC.format('target')} = {NETLOC.format('p.url')} THEN 1.0 ELSE 0.0 END) FILTER (target IS NOT NULL), 6) AS ratio FROM pages p LEFT JOIN l USING (page_id) GROUP BY 1")
def same_domain_ratio(spark, d):
    p = table(spark, d, "pages")
    return op.same_domain_ratio(p, op.page_links(p)).withColumn("ratio", F.round("ratio", 6))


@query("fused_score", f"WITH {FEATURES} SELECT page_id, CAST(round(score, 6) AS DOUBLE) AS score, CASE WHEN score >= 0.6 THEN 'llm' WHEN score >= 0.35 THEN 'persist' ELSE 'skip' END AS action FROM z")
def fused_score(spark, d):
    return op.scored(table(spark, d, "pages")).select("page_id", F.round("score", 6).alias("score"), "action")


@query("action_counts", f"WITH {FEATURES} SELECT CASE WHEN score >= 0.6 THEN 'llm' WHEN score >= 0.35 THEN 'persist' ELSE 'skip' END AS action, count(*) AS pages, CAST(round(avg(score), 6) AS DOUBLE) AS average_score FROM z GROUP BY 1")
def action_counts(spark, d):
    return op.scored(table(spark, d, "pages")).groupBy("action").agg(F.count("*").alias("pages"), F.round(F.avg("score"), 6).alias("average_score"))


@query("thresholds_hit", f"WITH {FEATURES} SELECT page_id, 'persist' || CASE WHEN score >= 0.58 THEN ',llm' ELSE '' END || CASE WHEN score >= 0.59 THEN ',alert' ELSE '' END AS hit FROM z")
def thresholds_hit(spark, d):
    """With gates that these pages can reach."""
    from pagesieve.config import FusionSettings

    s = FusionSettings(llm_gate=0.58, alert=0.59)
    got = op.scored(table(spark, d, "pages"), s=s)
    return got.select("page_id", F.array_join(F.map_keys("thresholds_hit"), ",").alias("hit"))


@query("score_reasons", f"WITH {FEATURES} SELECT page_id, CASE WHEN len(flags) > 0 THEN 'url oddities: ' || array_to_string(flags, ', ') ELSE '' END AS reasons FROM z")
def score_reasons(spark, d):
    return op.scored(table(spark, d, "pages")).select("page_id", F.array_join("reasons", "; ").alias("reasons"))


@query("fallback_findings", f"""WITH {FEATURES}, e AS (SELECT *, trim(left(t, 500)) AS x, CASE WHEN len(flags) > 0 THEN 'url oddities: ' || array_to_string(flags, ', ') ELSE 'auto-escalated' END AS why FROM z WHERE score >= 0.55)
SELECT page_id, CASE WHEN length(x) > 360 THEN rtrim(left(x, 357)) || '...' WHEN x <> '' THEN x ELSE 'Page at ' || url || ' flagged because ' || why || '.' END AS summary, why AS why_flagged, CASE WHEN retro > 0 THEN 'harmless-retro' ELSE 'unknown' END AS risk_tag, CAST(round(score, 2) AS DOUBLE) AS confidence, 'observation:unknown:' || left(sha256(url), 8) AS observation_ref FROM e""")
def fallback_findings(spark, d):
    from pagesieve.config import FusionSettings

    got = op.findings(op.scored(table(spark, d, "pages"), s=FusionSettings(llm_gate=0.55)))
    return got.select("page_id", "summary", F.array_join("why_flagged", "; ").alias("why_flagged"), "risk_tag", "confidence", "observation_ref")


@query("breadcrumbs", "SELECT d.doc_id, sha256(d.source || '/' || d.doc_id) AS url_hash, CASE WHEN d.lang IN ('self-harm', 'adult') THEN d.lang ELSE 'other' END AS category, coalesce(nullif(left(concat_ws('; ', nullif(trim(d.source), ''), nullif(trim(d.lang), '')), 300), ''), 'dangerous-content') AS reason, left(" + r"regexp_replace(d.text, '^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$', '', 'g')" + ", 200) AS excerpt_redacted FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1")
def breadcrumbs(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    found = docs.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.lit(None).cast("string").alias("notes"), F.array("source", "lang").alias("why_flagged"), F.col("lang").alias("category"), (F.col("toxic") == 1).alias("present"), F.lit("").alias("url_hash"), F.lit("2025-01-01").cast("timestamp").alias("observed_at"), F.col("text").alias("excerpt"))
    ids = found.where("present").select("doc_id", F.sha2("url", 256).alias("url_hash"))
    return ids.join(op.breadcrumbs(found), "url_hash").select("doc_id", "url_hash", "category", "reason", "excerpt_redacted")


@query("shard_keys", "SELECT page_id, left(sha256(url), 2) AS shard, '20250301T000000_' || sha256(url) AS name FROM pages")
def shard_keys(spark, d):
    """Where raw pages are stored: a shard by the hash, a name by time and hash."""
    at = F.date_format(F.lit("2025-03-01 00:00:00").cast("timestamp"), "yyyyMMdd'T'HHmmss")
    return table(spark, d, "pages").select("page_id", F.substring(F.sha2("url", 256), 1, 2).alias("shard"), F.concat(at, F.lit("_"), F.sha2("url", 256)).alias("name"))


def sql_illegal(t: str) -> str:
    return "list_filter(" + words(*sorted(ILLEGAL_KEYWORDS)) + f", lambda k: contains(lower(coalesce({t}, '')), k))"


PRE, GATES = PrefilterSettings(), CascadeSettings()
OUTCOMES = f"""
{METRICS},
il AS (SELECT page_id, {sql_illegal('html')} AS ks FROM pages),
g1 AS (SELECT k.*, octet_length(encode(coalesce(html, ''))) AS size, 1 / (1 + exp(-({LOGIT}))) AS prob,
  CASE WHEN text_density < {GATES.min_text_density} THEN CASE WHEN tokens >= {GATES.density_token_override} THEN 'token' WHEN snippet_retro >= {GATES.retro_override_score} THEN 'retro' WHEN anchor_ratio >= {GATES.density_anchor_override} THEN 'anchor' WHEN odd_keyword THEN 'keyword' WHEN tokens > {GATES.density_skip_token_cap} THEN 'low_density' END END AS ov,
  {tx.sql_first_keyword('sn', GATES.boring_keywords)} AS kw, {sql_snippet(1200)} AS excerpt, {sql_snippet(2048)} AS lead FROM k JOIN il USING (page_id) WHERE len(ks) = 0),
g2 AS (SELECT *, CASE WHEN size < {GATES.min_content_length} THEN 'content-length<{GATES.min_content_length}' WHEN size > {GATES.max_content_length} THEN 'content-length>{GATES.max_content_length}' WHEN html IS NULL THEN 'body-missing' WHEN regexp_replace(sn, '{tx.EDGES}', '', 'g') = '' THEN 'empty-snippet'
  WHEN script_ratio > {GATES.max_script_ratio} THEN 'script-ratio>{GATES.max_script_ratio}' WHEN anchor_ratio > {GATES.max_anchor_ratio} THEN 'anchor-ratio>{GATES.max_anchor_ratio}' WHEN text_density < {GATES.min_text_density} AND ov IS NULL THEN 'text-density<{GATES.min_text_density}' WHEN kw IS NOT NULL THEN 'keyword:' || lower(kw) END AS early,
  CASE WHEN prob < {GATES.classifier_threshold} THEN 'classifier<{GATES.classifier_threshold}' END AS r6, len(regexp_extract_all(lead, '{tx.WORD}')) AS words FROM g1),
g3 AS (SELECT page_id, sn FROM g2 WHERE early IS NULL),
{VOTES.format(id="page_id", t="sn", src="g3")},
g4 AS (SELECT page_id, row_number() OVER (PARTITION BY coalesce(bits, '0') ORDER BY page_id) > 1 AS again FROM g3 LEFT JOIN sim USING (page_id)),
g5 AS (SELECT page_id, coalesce(early, CASE WHEN again THEN 'simhash-duplicate' END, r6, nullif(concat_ws(';', CASE WHEN words > 0 AND words < {PRE.min_token_count} THEN 'token_count<{PRE.min_token_count}' END, 'keyword:' || {tx.sql_first_keyword('excerpt', PRE.boring_keywords)}), '')) AS stop FROM g2 LEFT JOIN g4 USING (page_id)),
{FEATURES},
y AS (SELECT page_id, score, {sql_illegal('left(t, 500)')} AS late,
  list_filter([{", ".join(f"CASE WHEN {tx.sql_tags('m', t)} > 0 THEN '{t}' END" for t in RETRO_TAGS)}], lambda x: x IS NOT NULL) AS signals, flags FROM z),
o AS (SELECT page_id, p.url, ks, stop, late, score, array_to_string(list_filter(['retro HTML signals: ' || nullif(array_to_string(signals, ', '), ''), 'url oddities: ' || nullif(array_to_string(flags, ', '), '')], lambda x: x IS NOT NULL), '; ') AS why
  FROM pages p JOIN il USING (page_id) LEFT JOIN g5 USING (page_id) JOIN y USING (page_id))
SELECT page_id, url, CASE WHEN len(ks) > 0 THEN 'illegal' WHEN stop IS NOT NULL THEN 'cascade' WHEN len(late) > 0 THEN 'illegal' ELSE 'scored' END AS outcome,
  CASE WHEN len(ks) > 0 THEN array_to_string(ks[1:5], '; ') WHEN stop IS NOT NULL THEN stop WHEN len(late) > 0 THEN array_to_string(late[1:5], '; ') ELSE why END AS reason,
  CASE WHEN len(ks) = 0 AND stop IS NULL AND len(late) = 0 THEN CAST(round(score, 6) AS DOUBLE) END AS score,
  CASE WHEN len(ks) > 0 OR stop IS NOT NULL OR len(late) > 0 OR score < 0.35 THEN 'skip' WHEN score >= 0.6 THEN 'llm' ELSE 'persist' END AS action FROM o
"""


@query("page_outcomes", f"WITH {OUTCOMES}")
def page_outcomes(spark, d):
    """Flagship: what becomes of every page, by the production settings with every stage on; scores to six places."""
    return op.outcomes(table(spark, d, "pages")).withColumn("score", F.round("score", 6))


@query("outcome_union", f"WITH {TIGHT_SQL}, {FEATURES} SELECT q.page_id, CASE WHEN coalesce(r1, r3, r4, r6) IS NOT NULL THEN 'cascade' ELSE 'scored' END AS outcome, CASE WHEN coalesce(r1, r3, r4, r6) IS NULL THEN CAST(round(score, 6) AS DOUBLE) END AS score FROM q JOIN z USING (page_id)")
def outcome_union(spark, d):
    got = op.outcomes(table(spark, d, "pages"), TIGHT, PrefilterSettings(enabled=False))
    return got.select("page_id", "outcome", F.round("score", 6).alias("score"))


