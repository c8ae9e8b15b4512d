"""Sources: seeds, documents, metadata, states, lists, telemetry and run directories, with explicit schemas.

Readers take paths of any file system that Spark reads. Corrupt records become nulls (PERMISSIVE) and are dropped or
reported, never fatal, unless a state file isn't an object at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEEDS = "hosts array<struct<url:string, why:string>>"
JOB = "struct<priority:double, `order`:bigint, host:string, url:string, depth:int, discovered_from:string, metadata:map<string,string>, available_at:double>"
FRONTIER = f"jobs array<{JOB}>, seen array<string>"
FAILURES = "url string, status int, reason string, first_recorded_at string, last_recorded_at string, count bigint"
BLOCKS = "host string, blocked_until string, reason string"


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """(url, why) of a seeds file; entries without a URL are left out."""
    j = spark.read.schema(SEEDS).json(path, multiLine=True)
    return j.select(F.inline("hosts")).where("trim(url) <> ''")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(text) of a JSON list, an object with ``documents``, or a file with a document per line."""
    whole = spark.read.text(path, wholetext=True)
    t = F.trim("value")
    as_list, as_object = F.from_json(t, "array<string>"), F.from_json(t, "documents array<string>")["documents"]
    structured = whole.where(F.try_parse_json(t).isNotNull() & (F.startswith(t, F.lit("[")) | F.startswith(t, F.lit("{"))))
    if structured.limit(1).count():
        return structured.select(F.explode(F.coalesce(F.when(F.startswith(t, F.lit("[")), as_list), as_object)).alias("text"))
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text <> ''")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, meta) of an object from ids to objects, or a list of objects with an id."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"))
    by_id = whole.where(F.startswith("v", F.lit("{"))).select(F.explode(F.from_json("v", "map<string,map<string,string>>")).alias("k", "meta")).select(F.col("k").try_cast("long").alias("vec_id"), "meta")
    listed = whole.where(F.startswith("v", F.lit("["))).select(F.explode(F.from_json("v", "array<map<string,string>>")).alias("meta")).select(F.col("meta")["id"].try_cast("long").alias("vec_id"), F.map_filter("meta", lambda k, _: k != "id").alias("meta"))
    return by_id.unionByName(listed).where("vec_id IS NOT NULL")


def frontier_state(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(jobs, seen) of a saved frontier; a state that isn't an object is a ValueError. Defaults fill what is missing."""
    whole = spark.read.text(path, wholetext=True)
    if whole.where(~F.startswith(F.trim("value"), F.lit("{"))).limit(1).count():
        raise ValueError("a frontier state must be a JSON object")
    s = whole.select(F.from_json("value", FRONTIER).alias("s"))
    jobs = s.select(F.inline("s.jobs")).fillna({"priority": 0.0, "depth": 0, "available_at": 0.0, "host": "", "url": ""})
    return jobs, s.select(F.explode("s.seen").alias("url"))


NODE_LINK = "nodes array<map<string,string>>, links array<struct<source:string, target:string, weight:double, last_seen:string, anchor_texts:array<string>, rel:array<string>>>"


def link_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node-link JSON object: node with its attributes as a map, and src, dst with the link's own."""
    g = spark.read.text(path, wholetext=True).select(F.from_json("value", NODE_LINK).alias("g"))
    nodes = g.select(F.explode("g.nodes").alias("a")).select(F.col("a")["id"].alias("node"), F.map_filter("a", lambda k, _: k != "id").alias("attributes")).where("node IS NOT NULL")
    edges = g.select(F.inline("g.links")).withColumnsRenamed({"source": "src", "target": "dst"}).where("src IS NOT NULL AND dst IS NOT NULL")
    return nodes, edges.withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def artefacts(spark: SparkSession, run: str) -> dict[str, str]:
    """Paths of a run's artefacts that exist, by name."""
    places = {"summary": "reports/summary.json", "metrics": "metrics.json", "telemetry": "telemetry.jsonl", "frontier": "state/frontier.json"}
    return {name: f"{run}/{place}" for name, place in places.items() if exists(spark, f"{run}/{place}")}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def contained(root: str, path: str) -> str:
    """``path`` with its dots resolved, if it is inside ``root``; else a ValueError."""
    import posixpath

    top, p = posixpath.normpath(root), posixpath.normpath(path if "://" in path or path.startswith("/") else posixpath.join(root, path))
    if p != top and not p.startswith(top.rstrip("/") + "/"):
        raise ValueError(f"{path} is outside {root}")
    return p


def run_rows(spark: SparkSession, root: str) -> DataFrame:
    """Runs below ``root`` (run_id, pages, updated), latest first: of each value the summary's, else the metrics'.

    A run is a folder with metrics.json or reports/summary.json; files that can't be read count as missing.
    """
    fields = "run_id string, pages bigint, updated string"

    def of(place):
        found = spark.read.option("pathGlobFilter", place.rpartition("/")[2]).option("recursiveFileLookup", "true").text(root, wholetext=True)
        name = F.regexp_extract(F.input_file_name(), rf"([^/]+)/{place}$", 1)
        read = found.select(name.alias("folder"), F.from_json(json_object(F.col("value")), fields).alias("j")).where("folder <> ''")
        return read.select(F.coalesce("j.run_id", "folder").alias("run_id"), "j.pages", "j.updated")

    s, m = of("reports/summary.json").alias("s"), of("metrics.json").alias("m")
    pick = lambda c: F.coalesce(f"s.{c}", f"m.{c}").alias(c)
    return s.join(m, "run_id", "full_outer").select("run_id", pick("pages"), pick("updated")).orderBy(F.desc_nulls_last("updated"), "run_id")


def run_row(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """The row of one run; a KeyError if there is none."""
    found = run_rows(spark, root).where(F.col("run_id") == run_id)
    if not found.limit(1).count():
        raise KeyError(run_id)
    return found


def failure_cache(spark: SparkSession, path: str, now, expiry_seconds: float | None = None) -> DataFrame:
    """Unexpired failure entries from JSON lines; corrupt lines are left out."""
    j = spark.read.schema(FAILURES).json(path, mode="DROPMALFORMED").where("url IS NOT NULL")
    if expiry_seconds is None:
        return j
    at = F.try_to_timestamp("last_recorded_at")
    return j.where(at.isNotNull() & (F.unix_timestamp(now) - F.unix_timestamp(at) < expiry_seconds))


def blocklist(spark: SparkSession, path: str, now) -> DataFrame:
    """Active blocks from JSON lines: without an end, with an unreadable one, or with one to come."""
    until = F.try_to_timestamp("blocked_until")
    return spark.read.schema(BLOCKS).json(path, mode="DROPMALFORMED").where("host IS NOT NULL").where(until.isNull() | (until > now))


def host_list(spark: SparkSession, path: str, cap: int | None = None) -> DataFrame:
    """Distinct hosts of a text file (comments and blanks left out), sorted; ``cap`` is the list's documented limit."""
    h = spark.read.text(path).select(F.lower(F.trim("value")).alias("host")).where("host <> '' AND NOT startswith(host, '#')").distinct().orderBy("host")
    return h if cap is None else h.limit(cap)


def telemetry_stream(spark: SparkSession, folder: str, schema: str = "ts timestamp, url string, action string, score double") -> DataFrame:
    """A telemetry folder of JSON lines as a stream."""
    return spark.readStream.schema(schema).json(folder)


def vectors(spark: SparkSession, path: str, dim: int | None = None) -> DataFrame:
    """(vec_id, embedding) of a Parquet store; a vector of another length than ``dim`` is an error when it is read."""
    v = spark.read.parquet(path).select("vec_id", "embedding")
    if dim is None:
        return v
    return v.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector must have {dim} components")).cast(v.schema["embedding"].dataType)))


def json_object(value):
    """A JSON object from a text column: the whole text, else from the first brace to the last; null if neither can be read."""
    inner = F.regexp_extract(value, r"(?s)\{.*\}", 0)
    whole = F.when(F.startswith(F.trim(value), F.lit("{")) & F.try_parse_json(value).isNotNull(), value)
    return F.coalesce(whole, F.when((inner != "") & F.try_parse_json(inner).isNotNull(), inner))


def metrics_restored(df: DataFrame, defaults: dict) -> DataFrame:
    """Saved metrics with defaults for what is missing."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k.lower() in have else F.lit(v) for k, v in defaults.items()})


def robots_allowed(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """Append allowed: pages (url, host) under robots (host, robots text); no or an unreadable text allows everything."""
    joined = pages.join(robots.select("host", "robots"), "host", "left")
    schema = T.StructType([*joined.schema.fields, T.StructField("allowed", T.BooleanType())])

    def judge(batches):
        from urllib.robotparser import RobotFileParser

        known: dict = {}
        for b in batches:
            out = []
            for url, text in zip(b["url"], b["robots"]):
                if not text:
                    out.append(True)
                    continue
                if text not in known:
                    known[text] = RobotFileParser()
                    known[text].parse(text.splitlines())
                out.append(known[text].can_fetch(agent, url))
            b["allowed"] = out
            yield b

    return joined.mapInPandas(judge, schema).drop("robots")
