"""Queries that write a table through a sink and read it back through a source, with the SQL of what must come back.

Files go to a folder of their own in the shared folder. States that are one JSON object by definition (seeds, frontier,
graph, metadata, metrics, runs) are made of the small tables; everything else is written by all tasks.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from pagesieve.functions.urls import netloc
from pagesieve.operators import frontier as fr
from pagesieve.operators import pages as op
from pagesieve.operators import telemetry as te
from pagesieve.plans.events import FAILS, fails
from pagesieve.plans.pages import NETLOC, table
from pagesieve.sources import fetch, files, sinks
from pagesieve.storage import shared_root

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = re.sub(r"\bat\b", '"at"', sql)  # a keyword there
        return f

    return put


def place(spark, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def as_object(rows, name: str, path: str) -> None:
    """One JSON object with the rows as a list under ``name``."""
    whole = rows.agg(F.to_json(F.struct(F.collect_list(F.struct(*rows.columns)).alias(name))).alias("value"))
    whole.coalesce(1).write.text(path)


def put_text(spark, path: str, text: str) -> None:
    """A small file of a given name."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    out.write(text.encode())
    out.close()


@query("seed_list", "SELECT 'http://' || lower(n_name) || '.example/' AS url, 'region ' || n_regionkey AS why FROM nation WHERE n_regionkey <> 0")
def seed_list(spark, d):
    """Seeds of a JSON file; those of region 0 have a blank URL and are left out."""
    path = place(spark, "seeds")
    url = F.when(F.col("n_regionkey") == 0, " ").otherwise(F.concat(F.lit("http://"), F.lower("n_name"), F.lit(".example/")))
    as_object(table(spark, d, "nation").select(url.alias("url"), F.concat(F.lit("region "), F.col("n_regionkey").cast("string")).alias("why")), "hosts", path)
    return files.seeds(spark, path)


def jobs(spark, d):
    s = table(spark, d, "supplier")
    depth = F.when(F.col("s_suppkey") % 2 == 1, F.col("s_suppkey") % 5).cast("int")
    return s.select(F.col("s_acctbal").alias("priority"), F.col("s_suppkey").alias("order"), F.concat(F.lit("h"), F.col("s_nationkey").cast("string")).alias("host"), F.concat(F.lit("http://h"), F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_suppkey").cast("string")).alias("url"), depth.alias("depth"), F.create_map(F.lit("name"), F.col("s_name")).alias("metadata"))


JOBS = "SELECT 'http://h' || s_nationkey || '/' || s_suppkey AS url, s_suppkey AS \"order\", round(s_acctbal, 2) AS priority, CAST(CASE WHEN s_suppkey % 2 = 1 THEN s_suppkey % 5 ELSE 0 END AS INTEGER) AS depth, s_name AS name FROM supplier"


def shown(j):
    return j.select("url", "order", F.round("priority", 2).alias("priority"), "depth", F.col("metadata")["name"].alias("name"))


@query("frontier_file", JOBS)
def frontier_file(spark, d):
    """Jobs of a saved frontier; a depth that wasn't saved is 0."""
    path = place(spark, "frontier")
    sinks.frontier_state(jobs(spark, d), jobs(spark, d), path)
    return shown(files.frontier_state(spark, path)[0])


@query("frontier_seen", "SELECT DISTINCT 'h' || s_nationkey AS url FROM supplier")
def frontier_seen(spark, d):
    """What a saved frontier has seen, each once."""
    path, j = place(spark, "frontier"), jobs(spark, d)
    sinks.frontier_state(j, j.select(F.col("host").alias("url")), path)
    return files.frontier_state(spark, path)[1]


@query("job_objects", JOBS)
def job_objects(spark, d):
    """Jobs as one JSON object each, and back."""
    schema = "url string, `order` bigint, priority double, depth int, host string, metadata map<string,string>"
    return shown(fr.jobs_from_json(fr.jobs_to_json(jobs(spark, d)), schema))


@query("inflight_lookup", "SELECT 'http://h' || s_nationkey || '/' || s_suppkey AS url, CASE WHEN s_acctbal > 5000 THEN s_name END AS name FROM supplier")
def inflight_lookup(spark, d):
    """Metadata of the jobs in flight (here: those of a high priority) for every URL."""
    j = jobs(spark, d)
    return fr.inflight_metadata(j.where("priority > 5000"), j).select("url", F.col("metadata")["name"].alias("name"))


WAITS = "SELECT event_id, user_id, CASE WHEN user_id % 3 = 0 THEN greatest(value, 10.0 + user_id % 7) ELSE value END AS available_at FROM events"


def held_jobs(spark, d):
    """Jobs of which every third host must wait."""
    e = table(spark, d, "events").select(F.col("event_id").alias("order"), F.col("user_id").alias("host"), F.col("value").alias("available_at"))
    waits = e.select("host").distinct().where("host % 3 = 0").select("host", (F.col("host") % 7).cast("double").alias("wait"))
    return fr.promoted(fr.delayed(e, waits, F.lit(10.0)), F.lit(12.0))


@query("frontier_delay", f"WITH w AS ({WAITS}) SELECT event_id AS \"order\", user_id AS host, round(available_at, 6) AS available_at, available_at <= 12 AS ready FROM w")
def frontier_delay(spark, d):
    """Jobs that are ready at second 12, and those held back, after hosts were delayed at second 10."""
    ready, held = held_jobs(spark, d)
    return fr.pending(ready.withColumn("ready", F.lit(True)), held.withColumn("ready", F.lit(False))).select("order", "host", F.round("available_at", 6).alias("available_at"), "ready")


@query("frontier_length", f"WITH w AS ({WAITS}) SELECT user_id AS host, count(*) AS jobs FROM w GROUP BY 1")
def frontier_length(spark, d):
    """How many jobs of each host wait, ready or held."""
    return fr.pending(*held_jobs(spark, d)).groupBy("host").agg(F.count("*").alias("jobs"))


@query("failure_file", f"WITH {FAILS} SELECT CAST(url AS VARCHAR) AS url, status, reason, count FROM u WHERE epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(date_trunc('second', last_recorded_at)) < 30000")
def failure_file(spark, d):
    """A saved failure cache without what is expired or can't be read; the same cache isn't written a second time."""
    path = place(spark, "failures")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    entries = fr.failure_entries(fails(spark, d)).select(F.col("url").cast("string").alias("url"), "status", "reason", stamp("first_recorded_at"), stamp("last_recorded_at"), "count")
    if not sinks.swapped(entries, path, "json") or sinks.swapped(entries, path, "json"):
        raise ValueError("a snapshot is written once")
    spark.range(1).select(F.lit('{"url": "half').alias("value")).write.mode("append").text(path)
    return files.failure_cache(spark, path, F.lit("2024-01-31 00:00:00").cast("timestamp"), 30_000).select("url", "status", "reason", "count")


@query("block_file", "WITH b AS (SELECT user_id, max(ts) + INTERVAL 1 HOUR AS until FROM events GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS host, CASE user_id % 3 WHEN 0 THEN 'illegal: x' ELSE 'slow' END AS reason FROM b WHERE user_id % 3 < 2 OR date_trunc('second', until) > TIMESTAMP '2024-01-30 12:00:00'")
def block_file(spark, d):
    """Active blocks of a saved list: no end, an end that can't be read, or one to come."""
    path = place(spark, "blocks")
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    until = F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd HH:mm:ss")
    kind = F.col("user_id") % 3
    sinks.swapped(last.select(F.col("user_id").cast("string").alias("host"), F.when(kind == 1, "some day").when(kind == 2, until).alias("blocked_until"), F.when(kind == 0, "illegal: x").otherwise("slow").alias("reason")), path, "json")
    return files.blocklist(spark, path, F.lit("2024-01-30 12:00:00").cast("timestamp")).select("host", "reason")


def saved_graph(spark, d):
    path, s = place(spark, "graph"), table(spark, d, "supplier")
    url = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    nodes = s.select(url.alias("node"), F.create_map(F.lit("title"), F.col("s_name")).alias("attributes"))
    edges = s.select(url.alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"), F.col("s_acctbal").alias("weight"), F.lit("2024-01-01T00:00:00").alias("last_seen"), F.array("s_name").alias("anchor_texts"), F.array(F.lit("nofollow")).alias("rel"))
    sinks.link_graph(nodes, edges, path)
    return files.link_graph(spark, path)


@query("graph_file_nodes", "SELECT 's' || s_suppkey AS node, s_name AS title FROM supplier")
def graph_file_nodes(spark, d):
    """Nodes of a saved node-link graph."""
    return saved_graph(spark, d)[0].select("node", F.col("attributes")["title"].alias("title"))


@query("graph_file_edges", "SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, round(s_acctbal, 2) AS weight, s_name AS anchor, 'nofollow' AS rel FROM supplier")
def graph_file_edges(spark, d):
    """Edges of a saved node-link graph."""
    return saved_graph(spark, d)[1].select("src", "dst", F.round("weight", 2).alias("weight"), F.col("anchor_texts")[0].alias("anchor"), F.col("rel")[0].alias("rel"))


LINE = r"trim(regexp_replace(text, '[\r\n]', ' ', 'g'))"


@query("document_lines", f"SELECT sha256({LINE}) AS line, count(*) AS n FROM documents WHERE {LINE} <> '' GROUP BY 1")
def document_lines(spark, d):
    """Documents of a file with one in each line."""
    path = place(spark, "lines")
    table(spark, d, "documents").where("text IS NOT NULL").select(F.regexp_replace("text", r"[\r\n]", " ").alias("value")).write.text(path)
    return files.documents(spark, path).groupBy(F.sha2("text", 256).alias("line")).agg(F.count("*").alias("n"))


@query("document_object", "SELECT n_name AS text FROM nation")
def document_object(spark, d):
    """Documents of a JSON object."""
    path = place(spark, "object")
    table(spark, d, "nation").agg(F.to_json(F.struct(F.collect_list("n_name").alias("documents"))).alias("value")).coalesce(1).write.text(path)
    return files.documents(spark, path)


@query("metadata_file", "SELECT s_suppkey AS vec_id, s_name AS name FROM supplier")
def metadata_file(spark, d):
    """Metadata of a JSON list of objects with an id; an id that is no number is left out."""
    path = place(spark, "metadata")
    s = table(spark, d, "supplier").select(F.create_map(F.lit("id"), F.col("s_suppkey").cast("string"), F.lit("name"), F.col("s_name")).alias("m"))
    odd = spark.range(1).select(F.create_map(F.lit("id"), F.lit("x"), F.lit("name"), F.lit("?")).alias("m"))
    s.unionByName(odd).agg(F.to_json(F.collect_list("m")).alias("value")).coalesce(1).write.text(path)
    return files.metadata(spark, path).select("vec_id", F.col("meta")["name"].alias("name"))


@query("host_file", f"SELECT DISTINCT {NETLOC.format('url')} AS host FROM pages WHERE {NETLOC.format('url')} <> '' ORDER BY 1 LIMIT 100")
def host_file(spark, d):
    """The first hundred hosts (the list's own limit) of a text file with repeats, blanks, capitals and a comment."""
    path = place(spark, "hosts")
    lines = table(spark, d, "pages").select(F.concat(F.lit("  "), F.upper(netloc(F.col("url")))).alias("value"))
    lines.unionByName(spark.range(1).select(F.lit("# hosts").alias("value"))).write.text(path)
    return files.host_list(spark, path, 100)


@query("vector_file", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def vector_file(spark, d):
    """A saved vector store, its dimension checked when it is read."""
    path = place(spark, "vectors")
    sinks.snapshot(table(spark, d, "embeddings"), path)
    v = files.vectors(spark, path, 64)
    return v.select("vec_id", F.size("embedding").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("metrics_file", "SELECT count(*) AS pages, 0 AS llm_calls, 'none' AS last_error FROM events")
def metrics_file(spark, d):
    """Saved metrics with defaults for what wasn't saved."""
    path = place(spark, "metrics")
    sinks.snapshot(table(spark, d, "events").agg(F.count("*").alias("pages"), F.lit(None).cast("string").alias("last_error")), path, "json")
    return files.metrics_restored(spark.read.schema("pages bigint, last_error string").json(path), {"llm_calls": 0, "last_error": "none"})


@query("hourly_cap", "SELECT count(*) FILTER (event_type = 'error') AS cap_hits, 0.0::DOUBLE AS last_wait_seconds FROM events")
def hourly_cap(spark, d):
    """How often the hourly cap was met, of metrics that don't know the last wait."""
    return te.hourly_cap(table(spark, d, "events").agg(F.count_if(F.col("event_type") == "error").alias("llm_hourly_cap_hits")))


@query("run_folders", "SELECT CASE WHEN r_regionkey % 2 = 0 THEN r_name ELSE 'run' || r_regionkey END AS run_id, CASE WHEN r_regionkey = 1 THEN NULL WHEN r_regionkey % 2 = 0 THEN r_regionkey * 10 ELSE r_regionkey END AS pages, '2024-01-0' || (r_regionkey + 1) AS updated FROM region")
def run_folders(spark, d):
    """Runs of a folder: values of the summary, else of the metrics; run1's metrics lack pages, run3's summary can't be read."""
    root = place(spark, "runs")
    for r in table(spark, d, "region").collect():  # a region is a run here, there are five
        k, run = r["r_regionkey"], f"{root}/run{r['r_regionkey']}"
        pages = "" if k == 1 else f'"pages": {k}, '
        put_text(spark, f"{run}/metrics.json", f'{{{pages}"updated": "2024-01-0{k + 1}"' + (f', "run_id": "{r["r_name"]}"}}' if k % 2 == 0 else "}"))
        if k % 2 == 0:
            put_text(spark, f"{run}/reports/summary.json", f'{{"run_id": "{r["r_name"]}", "pages": {k * 10}}}')
        if k == 3:
            put_text(spark, f"{run}/reports/summary.json", '{"pages": ')
    return files.run_rows(spark, root)


@query("raw_page_store", "SELECT left(sha256(url), 2) AS shard, '20250301T000000_' || sha256(url) AS name, CAST(length(html) AS INTEGER) AS chars FROM pages")
def raw_page_store(spark, d):
    """Raw pages by shard and name."""
    path = place(spark, "raw")
    p = table(spark, d, "pages").select(F.sha2("url", 256).alias("url_hash"), F.lit("2025-03-01 00:00:00").cast("timestamp").alias("fetched_at"), "html", F.lit("{}").alias("headers"))
    if sinks.raw_pages(p, path) or not sinks.raw_pages(p, path, enabled=True):
        raise ValueError("raw pages are stored where it is asked for")
    return spark.read.schema("name string, html string, shard string").parquet(path).select("shard", "name", F.length("html").alias("chars"))


@query("excerpt_store", "SELECT doc_id, left(text, 120) AS text_excerpt FROM documents")
def excerpt_store(spark, d):
    """Observations without raw content and with their excerpts cut."""
    path = place(spark, "excerpts")
    o = table(spark, d, "documents").select("doc_id", F.col("text").alias("text_excerpt"), F.col("text").alias("raw_html"), F.col("text").alias("content"))
    sinks.excerpts(o, path, 120)
    if set(spark.read.json(path).columns) - {"doc_id", "text_excerpt"}:
        raise ValueError("raw content is never stored")
    return spark.read.schema("doc_id bigint, text_excerpt string").json(path)


@query("breadcrumb_store", "SELECT strftime(ts, '%Y-%m-%d') AS observed_date, count(*) AS crumbs, min(sha256(CAST(event_id AS VARCHAR))) AS first_hash FROM events GROUP BY 1")
def breadcrumb_store(spark, d):
    """Breadcrumbs in a folder for each day."""
    path = place(spark, "crumbs")
    sinks.breadcrumbs(table(spark, d, "events").select(F.sha2(F.col("event_id").cast("string"), 256).alias("url_hash"), F.col("ts").alias("observed_at"), F.col("event_type").alias("category")), path)
    back = spark.read.schema("url_hash string, category string, observed_date string").json(path)
    return back.groupBy("observed_date").agg(F.count("*").alias("crumbs"), F.min("url_hash").alias("first_hash"))


@query("breadcrumb_faults", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'url_hash' WHEN length(repeat('x', CAST(floor(value * 10) AS INTEGER))) > 200 THEN 'excerpt' WHEN event_type = 'error' THEN 'observed_at' END AS fault FROM events")
def breadcrumb_faults(spark, d):
    """Why a breadcrumb is invalid."""
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, "h").alias("url_hash"), F.repeat(F.lit("x"), F.floor(F.col("value") * 10).cast("int")).alias("excerpt_redacted"), F.when(F.col("event_type") != "error", F.col("ts")).alias("observed_at"))
    return e.select("event_id", op.breadcrumb_fault().alias("fault"))


@query("url_hash_choice", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a' || page_id WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE sha256(url) END AS url_hash FROM pages")
def url_hash_choice(spark, d):
    """The first hash that isn't empty, else that of the URL."""
    k = F.col("page_id") % 4
    p = table(spark, d, "pages").select("page_id", "url", F.when(k == 0, F.concat(F.lit("a"), F.col("page_id").cast("string"))).otherwise("").alias("url_sha256"), F.when(k <= 1, "b").alias("url_sha1"), F.when(k <= 2, "c").otherwise("").alias("url_md5"))
    return p.select("page_id", op.url_hash().alias("url_hash"))


@query("telemetry_store", "SELECT event_type AS action, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def telemetry_store(spark, d):
    """Telemetry appended twice, and read as a whole."""
    path, e = place(spark, "telemetry"), table(spark, d, "events").select("event_id", F.col("event_type").alias("action"), "value")
    for part in (0, 1):
        sinks.telemetry(e.where(F.col("event_id") % 2 == part), path)
    return spark.read.schema("action string, value double").json(path).groupBy("action").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("cluster_csv", "SELECT e.vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 4) AS x, round(CAST(embedding[2] AS DOUBLE), 4) AS y, e.label AS cluster, nullif(p.url, '') AS url FROM embeddings e LEFT JOIN pages p ON p.page_id = e.vec_id")
def cluster_csv(spark, d):
    """The table of clusters as CSV, with the metadata there is."""
    from pagesieve.operators.vectors import cluster_table

    path, e = place(spark, "clusters"), table(spark, d, "embeddings")
    at = lambda i, c: F.round(F.col("embedding")[i].cast("double"), 4).alias(c)
    rows = cluster_table(e.select("vec_id", at(0, "x"), at(1, "y")), e.select("vec_id", F.col("label").alias("cluster")), table(spark, d, "pages").select(F.col("page_id").alias("vec_id"), "url"))
    sinks.table_csv(rows, path)
    return spark.read.schema("id bigint, x double, y double, cluster int, url string").csv(path, header=True)


@query("topic_file", "SELECT lang AS topic, count(*) AS documents FROM documents GROUP BY 1")
def topic_file(spark, d):
    """Topic summaries as JSON."""
    path = place(spark, "topics")
    sinks.summaries(table(spark, d, "documents").groupBy(F.col("lang").alias("topic")).agg(F.count("*").alias("documents")), path)
    return spark.read.schema("topic string, documents bigint").json(path)


ROBOTS = f"(length({NETLOC.format('url')}) % 2 = 0 AND regexp_matches(url, '^[A-Za-z]+://[^/?#]*/fr/'))"


def with_robots(spark, d):
    """Pages under robots that close /fr/ on hosts with a name of even length; the others have none."""
    p = table(spark, d, "pages").select("page_id", "url", netloc(F.col("url")).alias("host"))
    closed = p.select("host").distinct().where("length(host) % 2 = 0")
    return files.robots_allowed(p, closed.withColumn("robots", F.lit("User-agent: *\nDisallow: /fr/\n")), "bot")


@query("robots_gate", f"SELECT page_id, NOT {ROBOTS} AS allowed FROM pages")
def robots_gate(spark, d):
    return with_robots(spark, d).select("page_id", "allowed")


def echo(url):
    """Stands in for the network: the answer is the URL, and hosts with a digit in the URL's last place refuse it."""
    return (403 if url[-1:].isdigit() else 200), {"content-type": "text/plain"}, url.encode()


@query("fetch_allowed", f"SELECT url, sha256(url) AS url_hash, CASE WHEN regexp_matches(url, '[0-9]$') THEN 403 ELSE 200 END AS status, CASE WHEN regexp_matches(url, '[0-9]$') THEN 'status 403' END AS error, CAST(octet_length(encode(url)) AS BIGINT) AS bytes FROM pages WHERE NOT {ROBOTS}")
def fetch_allowed(spark, d):
    """What robots allow, fetched by a plugged-in callable."""
    allowed = with_robots(spark, d).where("allowed")
    return fetch.fetched(allowed, echo, retries=0).select("url", "url_hash", "status", "error", F.col("bytes_downloaded").alias("bytes"))
