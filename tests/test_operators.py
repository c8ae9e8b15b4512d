"""Operators on literal rows with known results."""

import datetime as dt

import pytest
import numpy as np
from pyspark.sql import functions as F

from pagesieve import config as cf
from pagesieve.operators import frontier as fr
from pagesieve.operators import graph as gr
from pagesieve.operators import pages as op
from pagesieve.operators import telemetry as te
from pagesieve.operators import topics as tp
from pagesieve.operators import vectors as ve
from pagesieve.operators.components import connected_components
from pagesieve.storage import keeper


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def page(body, url="http://a.test/~me/", i=1):
    return (i, url, body)


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string")


RETRO = "<html><title>Ring</title><marquee>hi</marquee><blink>b</blink><font>f</font><a href='#x'>n</a><a href=\"http://b.test/webring\" rel=\"next ring\">my webring</a><a href=\"/local\">l</a><a href=\"/local\">again</a>" + " word" * 60 + "</html>"


def test_features_and_reasons(spark):
    r = op.scored(pages(spark, page(RETRO, "http://a.test/cgi-bin/~me/"), page(None, None, 2))).orderBy("page_id").collect()
    assert list(r[0]["retro_signals"]) == ["marquee", "blink", "font"] and r[0]["retro_score"] == 1.0
    assert list(r[0]["url_flags"]) == ["cgi-bin", "insecure"] or list(r[0]["url_flags"]) == ["cgi-bin", "tilde_home", "insecure"]
    assert r[0]["reasons"][0] == "retro HTML signals: marquee, blink, font"
    assert r[1]["token_count"] == 0 and r[1]["action"] == "persist" and r[1]["score"] == 0.5


def test_queries_follow_links_of_every_spelling(spark, tmp_path):
    from pagesieve import registry

    html = """<a href="next.html">n</a><a href='../up'>u</a><a href=?q=1>q</a><a href="//h.test/p">p</a><a href="HTTP://B.test:80/x?b=1&amp;a=2#f">b</a><a data-href="no" href='/c'>c</a><a href="#f">f</a><a href=last>open"""
    pages(spark, page(html, "http://a.test/d/e/f")).write.parquet(str(tmp_path / "pages.parquet"))
    want = {"http://a.test/d/e/next.html", "http://a.test/d/up", "http://a.test/d/e/f?q=1", "http://h.test/p", "http://b.test/x?a=2&b=1", "http://a.test/c", "http://a.test/d/e/last"}
    queries = registry.queries()
    assert {r["target"] for r in queries["page_links"](spark, str(tmp_path)).collect()} == want
    assert queries["outbound_counts"](spark, str(tmp_path)).first()["outbound_count"] == 7
    assert queries["link_components"](spark, str(tmp_path)).count() == 8


def test_links(spark):
    p = pages(spark, page(RETRO), page('<base href="http://c.test/d/"><a href="e?b=1&a=2">E</a>', i=2), page("", i=3), page(None, i=4))
    got = {(r["page_id"], r["target"]): r for r in op.page_links(p).collect()}
    assert set(got) == {(1, "http://b.test/webring"), (1, "http://a.test/local"), (2, "http://c.test/d/e?a=2&b=1")}
    assert list(got[1, "http://b.test/webring"]["rel"]) == ["next", "ring"] and got[1, "http://b.test/webring"]["webring"]
    c = {r["page_id"]: r for r in op.outbound_counts(p, op.page_links(p)).collect()}
    assert (c[1]["outbound_count"], c[1]["outbound_domains"], c[1]["webring_hits"]) == (2, 2, 1)
    assert c[3]["outbound_count"] == 0 and not c[4]["has_webring"]
    assert {r["page_id"]: r["ratio"] for r in op.same_domain_ratio(p, op.page_links(p)).collect()} == {1: 0.5, 2: 0.0, 3: None, 4: None}


def test_fusion(spark):
    s = lambda *x: round(one(spark, op.fused(*[F.lit(float(v)) for v in x])), 6)
    assert s(1, 1, 0.5, 0, 0.5) == 0.639916
    assert s(1, 0, 66 / 800, 0, 0) == 0.568259
    assert one(spark, op.action(F.lit(0.6))) == "llm" and one(spark, op.action(F.lit(0.3))) == "skip"
    assert one(spark, op.thresholds_hit(F.lit(0.1))) == {"persist": 0.35}
    assert one(spark, op.thresholds_hit(F.lit(0.9))) == {"persist": 0.35, "llm": 0.6, "alert": 0.8}


@pytest.mark.parametrize("density,retro,script,anchor,tokens,odd,want", [(0, 0, 0, 0, 0, False, 0.169384), (0.5, 0, 0.1, 0.2, 50, False, 0.543639), (0.3, 1 / 3, 0, 0.1, 10, True, 0.444315), (0.3, 0, 0, 0, 30, False, 0.354344)])
def test_classifier(spark, density, retro, script, anchor, tokens, odd, want):
    df = spark.createDataFrame([(float(density), float(retro), float(script), float(anchor), tokens, odd)], "text_density double, snippet_retro double, script_ratio double, anchor_ratio double, tokens long, odd_keyword boolean")
    assert round(df.select(op.classifier_probability(cf.CascadeSettings())).first()[0], 6) == want


def test_cascade_gates(spark):
    body = "<p>" + "plain words here " * 60 + "</p>"
    rows = [page("tiny", i=1), page(body + "about insurance", i=2), page(body, i=3), page(body, i=4), page("<script>x</script>" * 60, i=5), page(" " * 600, i=6), page(None, i=7), page("<marquee>" + "<i></i>" * 400 + "</marquee>", i=8), page("x" * 600, i=9)]
    got = {r["page_id"]: r for r in op.cascade(pages(spark, *rows)).collect()}
    assert got[1]["reason"] == "content-length<512"
    assert got[2]["reason"] == "keyword:insurance"
    assert got[3]["stage"] is None and got[3]["fingerprint"] == got[4]["fingerprint"]
    assert got[4]["reason"] == "simhash-duplicate"
    assert got[5]["reason"] == "script-ratio>0.55"
    assert got[6]["reason"] == "empty-snippet"
    assert got[7]["stage"] == "head"
    assert got[8]["override"] == "retro" and list(got[8]["stages"])[2] == "structure:warn"
    assert got[9]["reason"] == "classifier<0.35"
    assert list(got[2]["stages"]) == ["head:pass", "snippet:pass", "structure:pass", "keywords:skip"]


def test_only_survivors_count_as_seen(spark):
    body = "<p>" + "some plain words " * 60
    rows = [page(body + "insurance</p>", i=1), page(body + "insurance</p>", i=2)]
    assert {r["reason"] for r in op.cascade(pages(spark, *rows)).collect()} == {"keyword:insurance"}


def test_illegal_pages_reach_no_later_stage(spark):
    bad = "<p>" + "quiet words " * 80 + " Illegal Firearms Marketplace</p>"
    good = "<p>" + "other words " * 80 + "</p>"
    got = {r["page_id"]: r for r in op.outcomes(pages(spark, page(bad, i=1), page(good, i=2))).collect()}
    assert (got[1]["outcome"], got[1]["reason"], got[1]["score"]) == ("illegal", "illegal firearms marketplace", None)
    assert got[2]["outcome"] == "scored"
    df = spark.createDataFrame([("a csam b human trafficking for sale",), ("fine",), (None,)], "t string")
    assert [tuple(r) for r in op.with_illegal(df, "t").select("illegal", "illegal_reason").collect()] == [(True, "csam; human trafficking for sale"), (False, ""), (False, "")]


def test_prefilter(spark):
    s = cf.PrefilterSettings(min_token_count=50, max_same_domain_ratio=0.5, boring_keywords=("insurance",))
    r = lambda t, n, ratio=None: list(one(spark, op.prefilter_reasons(s, F.lit(t), F.lit(n), F.lit(ratio).cast("double"))))
    assert r("x", 20) == ["token_count<50"]
    assert r("This Insurance policy", 60) == ["keyword:insurance"]
    assert r("insurance", 5, 2 / 3) == ["token_count<50", "keyword:insurance", "outbound_same_domain"]
    assert r("x", 0) == []
    c = cf.PrefilterSettings.coerced({"min_token_count": "10", "boring_keywords": "a, B,,b ", "odd_threshold": "0.5"})
    assert (c.min_token_count, c.boring_keywords, c.odd_threshold) == (10, ("a", "B"), 0.5)
    with pytest.raises(ValueError):
        cf.checked_centroids([[1.0], ["x", 2]])


def test_breadcrumbs(spark):
    at = dt.datetime(2025, 2, 1)
    rows = [("http://a", "explicit calls", ["w"], "violent", True, at, "deadbeef", " x" * 300), ("http://b", None, [" a ", ""], "odd", True, None, "", None), ("http://c", None, [], None, True, at, None, ""), ("http://d", "n", ["w"], "adult", False, at, "x", "e")]
    df = spark.createDataFrame(rows, "url string, notes string, why_flagged array<string>, category string, present boolean, observed_at timestamp, url_hash string, excerpt string")
    got = {r["reason"]: r for r in op.breadcrumbs(df, excerpt_chars=32).withColumn("fault", op.breadcrumb_fault(32)).collect()}
    assert len(got) == 3 and got["explicit calls"]["category"] == "violent" and len(got["explicit calls"]["excerpt_redacted"]) == 32
    assert got["a"]["category"] == "other" and got["a"]["fault"] == "observed_at" and len(got["a"]["url_hash"]) == 64
    assert got["dangerous-content"]["excerpt_redacted"] is None


def test_frontier_terms(spark):
    n = lambda c: round(one(spark, c), 6)
    assert n(fr.novelty(F.lit(3))) == 0.606531 and n(fr.novelty(F.lit(100))) == 0.1 and n(fr.novelty(F.lit(None).cast("int"))) == 1.0
    assert n(fr.bandit(F.lit(4), F.lit(1.6), F.lit(20))) == 0.616352
    assert n(fr.cascade_penalty(F.lit(9), F.lit(1))) == 0.075 and n(fr.cascade_penalty(F.lit(3), F.lit(1))) == 0.0
    terms = {"budget": F.lit(1.0), "novelty": F.lit(1.0), "bandit": F.lit(0.6), "oddity": fr.oddity_prior(F.lit(0), F.lit(0.0), F.lit(None).cast("double"), F.lit(None).cast("double"))}
    assert n(fr.priority(terms, F.lit(0), F.lit(None).cast("string"), F.lit("h"), F.lit(0.0))) == 0.825
    assert n(fr.priority(terms, F.lit(2), F.lit("g"), F.lit("h"), F.lit(0.0))) == 0.775
    assert [n(fr.retry_wait(F.lit(a), 2, 10, 3)) for a in (1, 2, 3)] == [2.0, 4.666667, 7.333333]
    s = cf.FrontierSettings.derived({}, per_host_rpm=6)
    assert (s.host_refill_seconds, s.failure_cooldown_seconds) == (10.0, 45.0)


def test_batch_equals_a_heap_loop(spark):
    import random

    rng = random.Random(5)
    jobs = [(f"h{rng.randint(0, 4)}", f"u{i}", rng.choice([0.1, 0.5, 0.5, 0.9]), i) for i in range(60)]
    tokens = {f"h{i}": rng.choice([0.0, 0.5, 1.0, 2.7, 9.0]) for i in range(4)}
    left, want = dict(tokens), []
    for h, u, p, o in sorted(jobs, key=lambda j: (-j[2], j[3])):
        if left.setdefault(h, 1.0) >= 1.0 and len(want) < 12:
            left[h] -= 1.0
            want.append(u)
    j = spark.createDataFrame(jobs, "host string, url string, priority double, `order` long")
    got = fr.next_batch(j, spark.createDataFrame(list(tokens.items()), "host string, tokens double"), 12)
    assert [r["url"] for r in got.orderBy(F.desc("priority"), "order").collect()] == want


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("x", "y"), ("a", "b"), ("d", None)], "src string, dst string")
    m = {r["node"]: r for r in gr.component_metrics(e.where("dst IS NOT NULL"), keeper("t")).collect()}
    assert m["c"]["component"] == "a" and m["c"]["size"] == 3 and abs(m["c"]["density"] - 2 / 3) < 1e-12 and m["y"]["density"] == 1.0
    assert {r["node"]: r["reciprocal_links"] for r in gr.reciprocity(e).collect()} == {"a": 1, "b": 1}
    score = one(spark, gr.graph_score(*[F.lit(x) for x in (1, 1, 0, 2, 0.35, 0.0)]))
    assert round(score, 6) == 0.616667
    s = spark.createDataFrame([("a", "b", i, t, [r]) for i, (t, r) in enumerate([("one", "x"), ("two", "y"), ("", "x"), ("three", "x")])] + [("a", "a", 9, "self", [])], "src string, dst string, seen_at int, anchor_text string, rel array<string>")
    r = gr.edges_of(s, 2).collect()
    assert len(r) == 1 and (r[0]["weight"], r[0]["last_seen"], list(r[0]["anchor_texts"]), list(r[0]["rel"])) == (4, 3, ["two", "three"], ["x", "y"])


def test_pagerank_equals_power_iteration(spark):
    e = [(1, 2, 3.0), (2, 3, 1.0), (1, 3, 1.0), (3, 1, 1.0), (3, 4, 2.0)]
    n, rank = 4, dict.fromkeys((1, 2, 3, 4), 0.25)
    total = {s: sum(w for a, _, w in e if a == s) for s in rank}
    for _ in range(12):
        lost = sum(rank[v] for v in rank if not total[v])
        rank = {v: 0.15 / n + 0.85 * (sum(rank[a] * w / total[a] for a, b, w in e if b == v) + lost / n) for v in rank}
    got = {r["node"]: r["rank"] for r in gr.pagerank(spark.createDataFrame(e, "src long, dst long, weight double"), keeper("r"), 12, tolerance=None).collect()}
    assert all(abs(got[v] - rank[v]) < 1e-12 for v in rank)


def test_components_of_chains_and_empty(spark):
    chain = spark.range(0, 200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = connected_components(chain, keeper("c")).agg(F.count("*"), F.max("component")).first()
    assert tuple(got) == (201, 0)
    assert connected_components(chain.limit(0), keeper("c")).count() == 0


def test_vectors(spark):
    rows = [(10, [1.0, 0.0, 0.0, 0.0]), (11, [0.0, 1.0, 0.0, 0.0]), (12, [0.0, 0.0, 1.0, 0.0]), (13, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [0.0, 1.0, 0.1, 0.0])], "vec_id long, embedding array<float>")
    for metric in ("l2", "cosine"):
        got = ve.knn(v, q, 2, metric).orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == [11, 12]
    many = ve.knn(v, v.where("embedding IS NOT NULL"), 1, "l2", block=1)
    assert {(r["query_id"], r["vec_id"]) for r in many.collect()} == {(10, 10), (11, 11), (12, 12)}
    up = ve.upsert(v.where("embedding IS NOT NULL"), spark.createDataFrame([(11, [9.0, 0.0, 0.0, 0.0]), (None, [7.0, 0.0, 0.0, 0.0])], "vec_id long, embedding array<float>"))
    assert {r["vec_id"]: r["embedding"][0] for r in up.collect()} == {10: 1.0, 11: 9.0, 12: 0.0, 13: 7.0}
    blobs = spark.createDataFrame([(i, [float(i // 20 * 50 + (i % 5) * 0.1), float(i % 4) * 0.1]) for i in range(40)] + [(99, [1000.0, 1000.0])], "vec_id long, embedding array<float>")
    c = {r["vec_id"]: r["cluster"] for r in ve.density_clusters(blobs, keeper("d"), 5, reach=5.0).collect()}
    assert len({c[i] for i in range(20)}) == 1 and c[0] != c[39] and c[99] == -1
    assert ve.layout(blobs).columns == ["vec_id", "x", "y"]
    t = spark.createDataFrame([(100, "alpha one"), (101, "beta two"), (102, "gamma")], "vec_id long, text string")
    assert ve.search_texts(t, spark.createDataFrame([(1, "beta")], t.schema), 1).first()["vec_id"] == 101


def test_topic_drift(spark):
    rep = lambda ts: [(t, 1.0) for t in ts]
    kind = "topic int, representation array<struct<term:string,weight:double>>, count long"
    b = spark.createDataFrame([(1, rep("ab"), 3), (2, rep("c"), 1)], kind)
    c = spark.createDataFrame([(1, rep("bd"), 5), (3, rep("e"), 2)], kind)
    got = {r["topic"]: r for r in tp.drift(b, c).collect()}
    assert (got[1]["state"], got[2]["state"], got[3]["state"]) == ("updated", "retired", "new")
    assert (got[1]["overlap"], list(got[1]["new_terms"]), list(got[1]["dropped_terms"]), got[1]["count_change"]) == (0.5, ["d"], ["a"], 2)


def test_purge_and_tail(spark):
    t = lambda d: dt.datetime(2025, 1, 1) - dt.timedelta(days=d)
    files = spark.createDataFrame([("raw", "old", t(40)), ("raw", "new", t(1)), ("excerpts", "x", t(99))], "section string, path string, mtime timestamp")
    sections = spark.createDataFrame([("raw", True, 30), ("excerpts", True, None), ("off", False, 1), ("gone", True, 1)], "section string, enabled boolean, ttl_days int")
    got = {r["section"]: (r["skipped_reason"], r["removed"]) for r in te.purge_plan(files, sections, F.lit(t(0))).collect()}
    assert got == {"raw": (None, 1), "excerpts": ("ttl_unset", 0), "off": ("disabled", 0), "gone": ("missing", 0)}
    lines = spark.createDataFrame([(1, '{"event":"a"}'), (2, ""), (3, "{bad"), (4, "[1]"), (5, '{"event":"b"}')], "line_no long, value string")
    assert [r["event"] for r in te.tail(lines, 5).collect()] == ["b", "a"]


def test_summary_of_nothing(spark):
    e = spark.createDataFrame([], "at timestamp, action string, score double, bytes long, duration_ms double, illegal boolean")
    r = te.summary(e).first()
    assert r["pages"] == 0 and r["average_score"] is None


def test_failures_and_blocks(spark):
    f = spark.createDataFrame([("u", 404, "x", dt.datetime(2025, 1, 1), 1), ("u", 500, "y", dt.datetime(2025, 1, 2), 2), ("v", 404, "x", dt.datetime(2025, 1, 1), 3)], "url string, status int, reason string, at timestamp, id long")
    e = fr.failure_entries(f)
    assert {r["url"]: (r["count"], r["status"], r["reason"]) for r in e.collect()} == {"u": (2, 500, "y"), "v": (1, 404, "x")}
    urls = spark.createDataFrame([("u",), ("v",), ("w",)], "url string")
    now = F.lit(dt.datetime(2025, 1, 3))
    assert {r["url"] for r in fr.not_failed(urls, e, now, None).collect()} == {"u", "w"}
    assert {r["url"] for r in fr.not_failed(urls, e, now, 60).collect()} == {"u", "v", "w"}


def test_character_references(spark):
    from html import unescape

    from pagesieve.functions import text as tx

    samples = ["caf&eacute;&nbsp;&#8217;x", "&amp;lt; &lt;b&gt;", "&#x41;&#X1F600;&#65;", "&#0;&#x110000;&#xD800;", "&#128;&#x99;", "a & b &unknown; &", "&#; &#x; &;", "&apos;&quot;", None, "plain"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = [r[0] for r in df.orderBy("i").select(tx.unescaped(F.col("s"))).collect()]
    assert got == [None if s is None else unescape(s) for s in samples]
    import duckdb

    con = duckdb.connect()
    assert [con.execute(f"SELECT {tx.sql_unescaped('?')}", [s]).fetchone()[0] for s in samples[:-2]] == got[:-2]


def test_canonical_urls_equal_a_restatement_by_the_library():
    import itertools
    import posixpath

    from pagesieve.functions.urls import canonical_url

    for parts in itertools.product(["/", "//", "///", ""], ["a", ".", "..", ""], ["/", "//"], ["b", "..", "."], ["", "/"]):
        path = "".join(parts)
        path = path if path.startswith("/") else "/" + path
        want = posixpath.normpath(path)
        want = want + "/" if path.endswith("/") and not want.endswith("/") else want
        assert canonical_url(f"HTTP://H.test.:80{path}")[0] == "http://h.test" + ("/" if want == "//" else want), path
    assert canonical_url("https://u:p@H.t:8443/?b=&a=1 2#f") == ("https://u:p@h.t:8443/?a=1+2&b=", None)
    assert [canonical_url(u)[1] for u in ("", "x", "ftp://h/", "http:///p")] == ["empty", "no-scheme", "scheme:ftp", "no-host"]


def test_routing(spark):
    from pagesieve.functions import urls as ur

    df = spark.createDataFrame([("http://x.onion/a",), ("http://In.test/",), ("http://out.test/",), (None,)], "u string")
    assert [r[0] for r in df.select(ur.routed(F.col("u"), domains=["in.test"])).collect()] == [True, True, False, False]
    assert not df.where(ur.routed(F.col("u"), enabled=False)).count()
    assert ur.proxies("h", 9050) == {"http": "socks5h://h:9050", "https": "socks5h://h:9050"}


def test_frontier_jobs_wait_and_come_back(spark):
    from pagesieve.operators import frontier as fr

    kind = "priority double, `order` long, host string, url string, depth int, metadata map<string,string>, available_at double"
    jobs = spark.createDataFrame([(0.5, 1, "a", "u1", 0, {"k": "v"}, 0.0), (0.9, 2, "b", "u2", 1, None, 50.0), (0.1, 3, "b", "u3", 1, None, None)], kind)
    ready, held = fr.promoted(jobs, F.lit(10.0))
    assert {r["url"] for r in ready.collect()} == {"u1", "u3"} and {r["url"] for r in held.collect()} == {"u2"}
    assert fr.pending(ready, held).count() == 3
    waits = spark.createDataFrame([("b", 20.0)], "host string, wait double")
    assert {r["url"]: r["available_at"] for r in fr.delayed(jobs, waits, F.lit(10.0)).collect()} == {"u1": 0.0, "u2": 50.0, "u3": 30.0}
    meta = fr.inflight_metadata(ready, spark.createDataFrame([("u1",), ("zz",)], "url string"))
    assert {r["url"]: r["metadata"] for r in meta.collect()} == {"u1": {"k": "v"}, "zz": None}
    again = fr.jobs_from_json(fr.jobs_to_json(jobs), kind)
    assert sorted(again.select("url", "order", "available_at").collect()) == sorted(jobs.fillna({"available_at": 0.0}).select("url", "order", "available_at").collect())
    visits = spark.createDataFrame([("a", 1, 1, 0.2, "skip", 0.7), ("a", 2, 2, 0.4, "llm", None)], "host string, at int, id int, score double, action string, score_hint double")
    assert fr.host_feedback(visits).first()["hint"] == 0.7 and fr.host_feedback(visits.drop("score_hint")).first()["hint"] == 0.4


def test_cascade_metrics(spark):
    rows = [("keyword", "k1", ["keyword:skip"]), (None, "geo", ["a:pass", "keyword:warn"]), (None, "geo", ["keyword:warn"]), (None, None, ["a:pass"])]
    got = op.cascade_metrics(spark.createDataFrame(rows, "stage string, override string, stages array<string>")).first()
    assert (got["skips"], got["passes"], got["warns"], got["overrides"]) == (1, 3, 2, {"geo": 2})
    none = op.cascade_metrics(spark.createDataFrame([], "stage string, override string, stages array<string>")).first()
    assert (none["skips"], none["passes"], none["warns"], none["overrides"]) == (0, 0, 0, {})


def test_nearest_ties_are_few_and_go_to_small_ids(spark):
    from pagesieve.operators import vectors as ve

    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(200)] + [(900, [0.0, 1.0])], "vec_id long, embedding array<double>")
    for metric in ("l2", "cosine"):
        q = v.where("vec_id = 900 OR vec_id = 7")
        got = ve.knn(v.coalesce(1), q, 5, metric).collect()
        assert sorted(r["vec_id"] for r in got if r["query_id"] == 7) == [0, 1, 2, 3, 4] and len(got) == 10
    new = spark.createDataFrame([(None, [float(i), 1.0]) for i in range(50)] + [(3, [5.0, 5.0])], "vec_id long, embedding array<double>")
    ids = sorted(r["vec_id"] for r in ve.upsert(v, new.repartition(7)).collect())
    assert ids == sorted([*range(200), 900, *range(901, 951)])


def test_search_is_bounded_in_memory_and_rows(spark):
    import tracemalloc

    from pagesieve.operators import vectors as ve

    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(10_000, 16)), rng.normal(size=(2_000, 16))
    q[0], v[:3000] = v[0], v[0]  # a large group of copies, too
    for metric in ("l2", "cosine"):
        near = ve.Nearest(q, 3, metric)
        tracemalloc.start()
        near.see(v, np.arange(10_000))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100e6  # one matrix of all distances alone is 160 MB
        d = ((q[:200, None] - v[None]) ** 2).sum(2) if metric == "l2" else -np.round((q[:200] @ v.T) / np.linalg.norm(q[:200], axis=1)[:, None] / np.linalg.norm(v, axis=1), 12)
        assert near.id[:200].tolist() == np.argsort(d, axis=1, kind="stable")[:, :3].tolist()
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(200)], "vec_id long, embedding array<double>").coalesce(1)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:  # k rows a query and partition, not a batch
        assert ve._pass(few, np.array([1, 2]), np.array([[1.0, 1.0], [9.0, 1.0]]), 5, "l2").count() == 10
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_cosines_equal_to_twelve_places_go_by_id(spark):
    from pagesieve.operators import vectors as ve

    rows = [(i, [(x * f) for x in (0.1, 0.7, 0.3, 0.9, 0.45)]) for i, f in enumerate((3.3, 0.7, 1.9, 7.7, 0.123, 1.0, 11.1, 0.77, 5.3, 2.2))]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ve.knn(v, v, 4, "cosine").orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3] * 10


def test_distances_far_from_the_origin_are_exact(spark):
    from pagesieve.operators import vectors as ve

    x = np.random.default_rng(2).normal(size=(100, 3)) * 0.02 + np.array([1e6, 1e6, -1e6])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = ve.knn(v, v, 4, "l2").orderBy("query_id", "rank").collect()
    want = np.argsort(((x[:, None] - x[None]) ** 2).sum(2), axis=1, kind="stable")[:, :4]
    assert [r["vec_id"] for r in got] == want.reshape(-1).tolist()


def test_every_vector_as_a_query_is_bounded(spark):
    import tracemalloc

    from pagesieve.operators import vectors as ve

    v = np.random.default_rng(3).normal(size=(6_000, 64)).astype(np.float32).astype(np.float64)
    near = ve.Nearest(v, 6, "l2")
    tracemalloc.start()
    near.see(v, np.arange(6_000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 and near.id[:, 0].tolist() == list(range(6_000)) and (near.held == 6).all()


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_single_precision_rules_out_but_never_decides(monkeypatch, metric):
    from pagesieve.operators import vectors as ve

    fine, rng = [], np.random.default_rng(4)
    whole = ve.Nearest._fine
    monkeypatch.setattr(ve.Nearest, "_fine", lambda self, rows, v, vn: fine.append(len(v)) or whole(self, rows, v, vn))
    q = rng.normal(size=(40, 8))
    v = np.concatenate([rng.normal(size=(6_000, 8)), np.repeat(q, 4, axis=0) + rng.normal(size=(160, 8)) * 1e-9, np.zeros((3, 8)), np.full((2, 8), 1e25)])

    def want(v):
        with np.errstate(invalid="ignore"):
            cos = np.nan_to_num(np.einsum("id,jd->ij", q, v) / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))), nan=-1.0)
        d = ((q[:, None] - v[None]) ** 2).sum(2) if metric == "l2" else -np.round(cos, 12)
        return np.argsort(d, axis=1, kind="stable")[:, :5].tolist()

    near = ve.Nearest(q, 5, metric)
    near.see(v[:6_000], np.arange(6_000))
    assert fine == [1024] and near.id.tolist() == want(v[:6_000])  # only the first block, when nothing is held
    near.see(v[6_000:], np.arange(6_000, len(v)))  # differences far below single precision, and lengths beyond it
    assert fine == [1024, 165] and near.id.tolist() == want(v)


def test_pagerank_moves_adjacency_rows(spark, monkeypatch):
    monkeypatch.setattr(gr, "ROW_LINKS", 3)
    e = [(0, i, 1.0 + i % 2) for i in range(1, 40)] + [(i, 0, 1.0) for i in range(1, 30)] + [(3, 3, 2.0), (0, 5, 1.0)]
    kept = {}

    def keep(df, k):
        kept[k] = keeper("t")(df, k)
        return kept[k]

    got = {r["node"]: r["rank"] for r in gr.pagerank(spark.createDataFrame(e, "src long, dst long, weight double"), keep, 7, tolerance=None).collect()}
    w = np.zeros((40, 40))
    for a, b, x in e:
        w[a, b] += x
    total, rank = w.sum(1), np.full(40, 1 / 40)
    for _ in range(7):
        rank = 0.15 / 40 + 0.85 * ((rank / np.where(total, total, 1) * (total > 0)) @ w + rank[total == 0].sum() / 40)
    assert len(got) == 40 and all(abs(got[i] - rank[i]) < 1e-12 for i in range(40))
    rows = kept[-1].collect()  # 69 edges in fewer rows, but none with all links of the hub
    assert sum(len(r["dst"]) for r in rows) == 69 and len(rows) < 50 and max(len(r["dst"]) for r in rows) < 20


def test_components_move_edges_few_times(spark):
    names = []

    def keep(df, k):
        names.append(k)
        return keeper("t")(df, k)

    rng = np.random.default_rng(4)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + (i * 7) % 31, 100 + ((i + 1) * 7) % 31) for i in range(30)] + [(200, None), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(e, "src long, dst long"), keep).collect()}
    want = {x: x for a, b in e if b is not None and a != b for x in (a, b)}
    for _ in range(200):
        for a, b in e:
            if b is not None and a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
    names.clear()
    chain = spark.range(0, 500).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert connected_components(chain, keep).where("component <> 0").count() == 0
    assert sum(k < 1 for k in names) == 3  # edges, least neighbours, and no edge left: jumps move nodes only


def test_reciprocity_counts_own_links_as_before(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 1), (3, 3), (3, 1), (4, 2)], "src long, dst long")
    assert {r["node"]: r["reciprocal_links"] for r in gr.reciprocity(e).collect()} == {1: 1, 2: 1, 3: 1}


def test_distinct_edges_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(gr, "TASK_ROWS", 50)
    e = spark.range(0, 2000).select((F.col("id") % 40).alias("src"), (F.col("id") % 1000).alias("dst"))
    assert gr.pairs_of(e).withColumn("p", F.spark_partition_id()).groupBy("p").count().agg(F.max("count")).first()[0] < 100
    assert gr.degrees(e).agg(F.sum("out_degree"), F.sum("in_degree"), F.count("*")).first() == (1000, 1000, 1000)


def test_fingerprints_are_made_once(spark):
    from pagesieve.plans.pages import QUERIES
    from tests.conftest import SF

    assert "ArrowEvalPython" not in QUERIES["simhash_dedupe"](spark, SF)._jdf.queryExecution().executedPlan().toString()  # written, then read by both sides


def test_rounds_send_no_table_through_the_driver(spark):
    plans = []

    def keep(df, k):
        out = keeper("t")(df, k)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    e = spark.createDataFrame([(i, i * 7 % 20) for i in range(20)], "src long, dst long")
    assert gr.pagerank(e, keep, 2, tolerance=None).count() == 20 and connected_components(e, keep).count() == 18
    assert plans and not any("Broadcast" in p for p in plans)


def test_pagerank_settles_or_falls_back(spark, tmp_path):
    from pagesieve.operators import graph as gr
    from pagesieve.storage import keeper

    chain = spark.createDataFrame([(i, i + 1, 1.0 + i % 3) for i in range(20)] + [(3, 9, 5.0)], "src long, dst long, weight double")
    got = {r["node"]: r["rank"] for r in gr.pagerank(chain, keeper("t")).collect()}
    w = np.zeros((21, 21))
    for s, d, x in chain.collect():
        w[s, d] = x
    out = w.sum(axis=1)
    rank = np.full(21, 1 / 21)
    for _ in range(500):
        lost = rank[out == 0].sum()
        rank = 0.15 / 21 + 0.85 * ((rank / np.where(out > 0, out, 1)) @ w + lost / 21)
    assert max(abs(got[i] - rank[i]) for i in range(21)) < 1e-5
    assert {r["rank"] for r in gr.pagerank(chain, keeper("t"), rounds=2).collect()} == {1 / 21}
