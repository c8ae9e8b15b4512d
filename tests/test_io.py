"""Sources, sinks and streams on temporary folders."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pagesieve.sources import files as so
from pagesieve.sources import sinks as si
from pagesieve.streaming import streams as st


def put(path, text):
    path.write_text(text)
    return str(path)


def test_seeds_documents_metadata(spark, tmp_path):
    s = put(tmp_path / "s.json", json.dumps({"hosts": [{"url": "http://a", "why": "x"}, {"url": " "}, {"why": "y"}]}))
    assert [r["url"] for r in so.seeds(spark, s).collect()] == ["http://a"]
    for body in ('["a", "b"]', '{"documents": ["a", "b"]}', "a\n\n b \n"):
        assert sorted(r["text"] for r in so.documents(spark, put(tmp_path / "d.json", body)).collect()) == ["a", "b"]
    for body in ('{"1": {"title": "t"}, "x": {"title": "u"}}', '[{"id": 1, "title": "t"}, {"title": "u"}]'):
        got = so.metadata(spark, put(tmp_path / "m.json", body)).collect()
        assert [(r["vec_id"], r["meta"]) for r in got] == [(1, {"title": "t"})]


def test_states(spark, tmp_path):
    state = {"jobs": [{"priority": 0.5, "order": 1, "host": "a", "url": "http://a/1"}, {"url": "http://b"}], "seen": ["http://a/1"]}
    jobs, seen = so.frontier_state(spark, put(tmp_path / "f.json", json.dumps(state)))
    assert sorted((r["url"], r["priority"], r["depth"]) for r in jobs.collect()) == [("http://a/1", 0.5, 0), ("http://b", 0.0, 0)]
    assert seen.count() == 1
    with pytest.raises(ValueError):
        so.frontier_state(spark, put(tmp_path / "g.json", "[]"))
    now = F.lit(dt.datetime(2025, 1, 1))
    cache = put(tmp_path / "c.json", '{"url":"u","status":404,"last_recorded_at":"2024-12-31T23:59:55"}\n{broken\n{"url":"v","last_recorded_at":"2024-01-01T00:00:00"}')
    assert {r["url"] for r in so.failure_cache(spark, cache, now).collect()} == {"u", "v"}
    assert {r["url"] for r in so.failure_cache(spark, cache, now, 10).collect()} == {"u"}
    blocks = put(tmp_path / "b.json", '{"host":"a","blocked_until":"2024-01-01T00:00:00"}\n{"host":"b"}\n{"host":"c","blocked_until":"?"}\n{"host":"d","blocked_until":"2026-01-01T00:00:00"}')
    assert {r["host"] for r in so.blocklist(spark, blocks, now).collect()} == {"b", "c", "d"}
    assert [r["host"] for r in so.host_list(spark, put(tmp_path / "h.txt", "B.com\n# x\n\na.com\nb.com"), 5).collect()] == ["a.com", "b.com"]


def test_json_object_metrics_robots(spark):
    df = spark.createDataFrame([('{"a":1}',), ('so: {"a":2} end',), ("none",), (None,)], "t string")
    assert [r[0] for r in df.select(so.json_object(F.col("t"))).collect()] == ['{"a":1}', '{"a":2}', None, None]
    m = so.metrics_restored(spark.createDataFrame([(None,)], "pages long"), {"pages": 0, "errors": 0}).first()
    assert (m["pages"], m["errors"]) == (0, 0)
    p = spark.createDataFrame([("http://h/blocked/x", "h"), ("http://h/ok", "h"), ("http://i/x", "i")], "url string, host string")
    r = spark.createDataFrame([("h", "User-agent: *\nDisallow: /blocked")], "host string, robots string")
    assert {x["url"]: x["allowed"] for x in so.robots_allowed(p, r, "bot").collect()} == {"http://h/blocked/x": False, "http://h/ok": True, "http://i/x": True}


def test_vector_length_is_checked(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "v"))
    assert so.vectors(spark, str(tmp_path / "v"), 2).count() == 1
    with pytest.raises(Exception, match="3 components"):
        so.vectors(spark, str(tmp_path / "v"), 3).collect()


def test_sinks(spark, tmp_path):
    at = dt.datetime(2025, 3, 1)
    p = spark.createDataFrame([("aabb", at, "<p>", "x" * 100)], "url_hash string, fetched_at timestamp, html string, text_excerpt string")
    assert not si.raw_pages(p, str(tmp_path / "raw")) and not (tmp_path / "raw").exists()
    assert si.raw_pages(p, str(tmp_path / "raw"), True)
    r = spark.read.parquet(str(tmp_path / "raw")).first()
    assert r["shard"] == "aa" and r["name"] == "20250301T000000_aabb"
    si.excerpts(p, str(tmp_path / "ex"), 32)
    e = spark.read.json(str(tmp_path / "ex"))
    assert "html" not in e.columns and len(e.first()["text_excerpt"]) == 32
    si.breadcrumbs(p.select("url_hash", F.col("fetched_at").alias("observed_at")), str(tmp_path / "bc"))
    assert (tmp_path / "bc" / "observed_date=2025-03-01").is_dir()
    si.snapshot(p, str(tmp_path / "sn"))
    si.snapshot(p.limit(0), str(tmp_path / "sn"))
    assert spark.read.parquet(str(tmp_path / "sn")).count() == 0
    si.table_csv(p.select("url_hash"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["url_hash"]


def test_streams(spark, tmp_path):
    rows = [{"ts": f"2025-01-01T00:0{i % 3}:00", "host": "h", "action": "llm" if i % 2 else "skip", "score": 0.5, "fp": i % 4, "url": "u", "status": 404} for i in range(12)]
    put(tmp_path / "t.json", "\n".join(json.dumps(r) for r in rows))
    e = so.telemetry_stream(spark, str(tmp_path), "ts timestamp, host string, action string, score double, fp int, url string, status int")
    got = st.drained(st.running_totals(e), "t_totals", "complete").collect()
    assert {r["action"]: r["pages"] for r in got} == {"llm": 6, "skip": 6}
    assert st.drained(st.actions_per_window(e), "t_windows", "complete").count() == 6
    assert st.drained(st.actions_per_window(e, "2 minutes", slide="1 minute"), "t_slides", "complete").agg(F.sum("n")).first()[0] == 24
    assert st.drained(st.first_of_fingerprint(e), "t_first").count() == 4
    assert st.drained(st.sessions(e), "t_sessions", "complete").first()["n"] == 12
    assert st.drained(st.failure_cache(e), "t_cache", "complete").first()["count"] == 12


def test_token_bucket_stream(spark, tmp_path):
    put(tmp_path / "r.json", "\n".join(json.dumps({"host": "h", "at": float(t), "failed": f}) for t, f in ((0, False), (1, False), (10, True), (20, False), (60, False))))
    s = spark.readStream.schema("host string, at double, failed boolean").json(str(tmp_path))
    got = {r["at"]: r["granted"] for r in st.drained(st.token_buckets(s), "t_tokens").collect()}
    assert got == {0.0: True, 1.0: False, 10.0: True, 20.0: False, 60.0: True}


def test_fetch_with_a_plugged_in_callable(spark):
    from pagesieve.sources.fetch import fetched

    def call(url):
        if "bad" in url:
            raise OSError("down")
        return (404, {}, b"") if "gone" in url else (200, {"Content-Type": "text/html"}, b"<p>hi")

    urls = spark.createDataFrame([("http://a/ok",), ("http://a/gone",), ("http://b/bad",)], "url string")
    got = {r["url"]: r for r in fetched(urls, call, retries=1, wait=(0.0, 0.0), hosts_at_once=2).collect()}
    assert (got["http://a/ok"]["status"], got["http://a/ok"]["bytes_downloaded"], got["http://a/ok"]["error"]) == (200, 5, None)
    assert got["http://a/ok"]["headers"] == {"Content-Type": "text/html"} and len(got["http://a/ok"]["url_hash"]) == 64
    assert got["http://a/gone"]["error"] == "status 404" and got["http://b/bad"]["error"] == "OSError: down" and got["http://b/bad"]["status"] is None


def test_triage_with_an_analyst(spark):
    from pagesieve.config import FusionSettings
    from pagesieve.operators import pages as op
    from pagesieve.operators import triage as tr

    html = "<marquee>a</marquee><blink>b</blink><font>c</font>" + " word" * 900
    p = spark.createDataFrame([(1, "http://a/", html), (2, "https://b/", "plain"), (3, "http://c/", html)], "page_id long, url string, html string")
    decided = op.scored(p, s=FusionSettings())
    answers = lambda ps: ['{"summary": "odd", "confidence": 2, "dangerous_content": {"present": true, "category": "violent", "notes": "calls"}}' if "http://a/" in x else "?" for x in ps]
    got = {r["page_id"]: r for r in tr.triaged(decided, answers).withColumn("fault", tr.finding_fault()).collect()}
    assert set(got) == {1, 3} and got[1]["summary"] == "odd" and got[1]["observation_ref"].startswith("observation:unknown:") and got[1]["fault"] == "confidence"
    assert got[3]["summary"].startswith("a b c word") and len(got[3]["summary"]) <= 360 and got[3]["risk_tag"] == "harmless-retro"
    crumbs = tr.crumbs_of(tr.triaged(decided, answers), decided.withColumn("fetched_at", F.lit(dt.datetime(2025, 1, 1)))).collect()
    assert [(c["category"], c["reason"]) for c in crumbs] == [("violent", "calls")]
    s = tr.with_summaries(p.select("url", F.col("html").alias("text_excerpt")).limit(1), lambda ps: ["x" * 900 for _ in ps]).first()
    assert len(s["flash_summary"]) == 500


def test_graph_and_frontier_files_round_trip(spark, tmp_path):
    from pagesieve.sources import files, sinks

    nodes = spark.createDataFrame([("a", {"title": "A"}), ("b", {})], "node string, attributes map<string,string>")
    edges = spark.createDataFrame([("a", "b", 2.0, "2024-01-01", ["x"], ["next"])], "src string, dst string, weight double, last_seen string, anchor_texts array<string>, rel array<string>")
    sinks.link_graph(nodes, edges, str(tmp_path / "g"))
    n, e = files.link_graph(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, nodes.collect())) and [tuple(r) for r in e.select(*edges.columns).collect()] == [tuple(r) for r in edges.collect()]
    jobs = spark.createDataFrame([(0.5, 1, "h", "u", 2, "d", {"k": "v"}, 3.0)], files.JOB.removeprefix("struct<").removesuffix(">").replace(":", " "))
    sinks.frontier_state(jobs, spark.createDataFrame([("u",), ("u",), ("v",)], "url string"), str(tmp_path / "f"))
    j, seen = files.frontier_state(spark, str(tmp_path / "f"))
    assert j.collect() == jobs.collect() and sorted(r["url"] for r in seen.collect()) == ["u", "v"]


def test_snapshots_are_swapped_only_when_they_differ(spark, tmp_path):
    from pagesieve.sources import sinks

    path, a, b = str(tmp_path / "s"), spark.range(3), spark.range(4)
    assert [sinks.swapped(x, path) for x in (a, a, b)] == [True, False, True]
    assert spark.read.parquet(path).count() == 4 and sorted(p.name for p in tmp_path.iterdir()) == ["s"]


def test_runs_of_a_folder(spark, tmp_path):
    import json

    import pytest

    from pagesieve.sources import files

    def put(run, place, value):
        p = tmp_path / run / place
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(value if isinstance(value, str) else json.dumps(value))

    put("r1", "metrics.json", {"pages": 3, "updated": "2024-01-01"})
    put("r2", "metrics.json", {"pages": 5, "updated": "2024-02-01"})
    put("r2", "reports/summary.json", {"pages": 6})
    put("r3", "metrics.json", "{ broken")
    got = [tuple(r) for r in files.run_rows(spark, str(tmp_path)).collect()]
    assert got == [("r2", 6, "2024-02-01"), ("r1", 3, "2024-01-01"), ("r3", None, None)]
    assert files.run_row(spark, str(tmp_path), "r1").first()["pages"] == 3
    with pytest.raises(KeyError):
        files.run_row(spark, str(tmp_path), "zz")
    assert set(files.artefacts(spark, str(tmp_path / "r2"))) == {"metrics", "summary"}
    assert files.contained("/a/b", "c/../d") == "/a/b/d"
    for bad in ("../x", "/a/bc", "/etc"):
        with pytest.raises(ValueError):
            files.contained("/a/b", bad)


def test_hourly_cap_and_first_seen_ties(spark):
    from pagesieve.operators import telemetry as te

    assert tuple(te.hourly_cap(spark.createDataFrame([(4,)], "llm_hourly_cap_hits int")).first()) == (4, 0.0)
    e = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3), ("c", 4)], "reason string, at int")
    assert [r["reason"] for r in te.top(e, "reason", 3, "at").collect()] == ["c", "b", "a"]
    assert [r["reason"] for r in te.top(e, "reason", 3).collect()] == ["c", "a", "b"]


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    from pagesieve.streaming import streams as st

    rows = lambda a, b: spark.range(a, b).select(F.timestamp_seconds(F.col("id") + 1_000_000).alias("ts"), F.col("id").cast("string").alias("fp"))
    rows(0, 3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows(0, 1).schema).parquet(str(tmp_path / "in"))
    run = lambda: st.drained(st.first_of_fingerprint(stream()), "t_on", checkpoint=str(tmp_path / "c"), path=str(tmp_path / "out")).count()
    assert run() == 3
    rows(2, 6).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == 6
