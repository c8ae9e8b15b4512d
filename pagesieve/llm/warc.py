"""WARC archives: write captures, read them back, and assemble transactions.

``write_archives`` writes a request, a response (or revisit) and a metadata record for each page, one gzip member a
record. Of pages with equal payloads of at least ``revisit_bytes`` bytes, the one with the largest page_id is a
response and the others are revisits of it. Which page is which is decided on (digest, page_id) alone, aggregated per
digest before it is joined, so a payload that a third of all pages share is a join whose hot side Spark splits.

``read_archives`` parses archives into one row per record. ``assemble`` joins request and metadata records to their
response or revisit through WARC-Concurrent-To within an archive file, and emits one nested row per capture.

A task writes its archive under a name of its own and moves it into place, so a task that runs again leaves a whole
file. Archives are streamed in both directions; memory is one record and one batch.

Cases: a null html is an empty payload (always a response); a null url has no target URI; control characters, spaces
and non-ASCII characters of a url are percent-encoded in headers; repeated page_ids are captures of their own, and if
the largest page_id of a group of equal payloads is repeated, each of its rows is a response; a null page_id is never
referred to unless all of its group are null, and then each row is a response; an empty table gives no archive and an
empty result; extra columns are not read; a capture without request or metadata has nulls there.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.llm._common import delete, filesystem, new_path, release, small_steps, tune, write_file, written


@dataclass(frozen=True)
class WarcParams:
    revisit_bytes: int = 1000
    #: pages have no time of capture; all records carry this one
    date: str = "2000-01-01T00:00:00Z"
    level: int = 1


REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(map(str, parts)).encode()).digest())}>"


def record(kind: str, ident: str, headers: list[tuple[str, str | None]], block: bytes, level: int) -> bytes:
    """One record as a gzip member."""
    lines = [f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {ident}\r\n"]
    lines += [f"{k}: {v}\r\n" for k, v in headers if v is not None]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("".join([*lines, f"Content-Length: {len(block)}\r\n\r\n"]).encode() + block + b"\r\n\r\n") + z.flush()


def header_url(url: str | None) -> str | None:
    from urllib.parse import quote

    return None if url is None else quote(url, safe="%:/?#[]@!$&'()*+,;=-._~")


def roles(pages: DataFrame, p: WarcParams) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses)."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    large = base.where(F.octet_length("payload") >= p.revisit_bytes)
    shared = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    joined = base.join(shared, F.col("digest") == F.col("d"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"), F.col("first").isNotNull().alias("shared"))


def write_archives(pages: DataFrame, out: str, params: WarcParams = WarcParams()) -> list[str]:
    """Write ``pages`` (page_id, url, html) to ``out``; returns the names of the archives."""
    tune(pages.sparkSession)

    def archive(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        copies: dict[str, int] = {}
        counts = [0]

        def members():
            for b in small_steps(batches, ["payload"]):
                for page_id, url, payload, digest, refers_to, shared in zip(*[c.to_pylist() for c in b.columns]):
                    counts[0] += 1
                    body, target = payload.encode(), header_url(url)
                    b32 = f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"
                    if shared and refers_to is None:  # others refer to it: its name follows from page and payload
                        copy = copies[digest] = copies.get(digest, -1) + 1
                        own = record_id(page_id, digest, *([copy] if copy else []))
                    else:
                        own = record_id(name, counts[0])
                    common = [("WARC-Date", params.date), ("WARC-Target-URI", target)]
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
                    if refers_to is None:
                        yield record("response", own, [*common, ("WARC-Payload-Digest", b32), ("Content-Type", "application/http;msgtype=response")], head + body, params.level)
                    else:
                        yield record("revisit", own, [*common, ("WARC-Payload-Digest", b32), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Profile", REVISIT_PROFILE), ("Content-Type", "application/http;msgtype=response")], head, params.level)
                    host, _, path = (target or "").partition("://")[2].partition("/")
                    ask = f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
                    yield record("request", record_id(name, counts[0], "request"), [*common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request")], ask, params.level)
                    about = "".join(f"{k}: {v}\r\n" for k, v in (("page-id", page_id), ("payload-bytes", len(body))) if v is not None).encode()
                    yield record("metadata", record_id(name, counts[0], "metadata"), [*common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], about, params.level)

        made = members()
        first = next(made, None)
        if first is not None:

            def everything():
                yield first
                yield from made

            write_file(f"{out}/{name}", everything())
            yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    return sorted(r["name"] for r in roles(pages, params).mapInArrow(archive, "name string").collect())


RECORDS = "file string, record_id string, kind string, concurrent_to string, refers_to string, target_uri string, status int, request_line string, payload_bytes long, payload_digest string, digest_ok boolean, fields map<string,string>"


def parse_records(stream):
    """(headers, block) of each record of an archive; ``stream`` yields the uncompressed bytes as a file."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"no WARC record begins with {line[:40]!r}")
            continue
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode().partition(":")
            headers[k.strip().lower()] = v.strip()
        n = int(headers["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("the archive ends within a record")
        yield headers, block


def read_archives(spark: SparkSession, folder: str, names: list[str], with_payload: bool = False) -> DataFrame:
    """One row per record of the archives ``names`` in ``folder``."""
    tune(spark)
    schema = RECORDS + (", payload binary" if with_payload else "")
    if not names:
        return spark.createDataFrame([], schema)

    def read(batches):
        import gzip
        import io

        import pyarrow as pa

        kinds = {"status": pa.int32(), "payload_bytes": pa.int64(), "digest_ok": pa.bool_(), "fields": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        columns = [x.split()[0] for x in schema.split(", ")]
        types = [kinds.get(c, pa.string()) for c in columns]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=columns)

        for b in batches:
            for i in b.column(0).to_pylist():
                fs, path = filesystem(f"{folder}/{names[i]}")
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw)) as stream:
                    for h, block in parse_records(stream):
                        kind, status, line, payload, fields, ok = h["warc-type"], None, None, None, {}, None
                        if h.get("content-type", "").startswith("application/http"):
                            head, _, rest = block.partition(b"\r\n\r\n")
                            first = head.split(b"\r\n", 1)[0].decode("latin-1")
                            if kind == "request":
                                line = first
                            else:
                                status = int(first.split(" ")[1])
                                payload = rest if kind == "response" else None
                        elif kind == "metadata":
                            fields = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
                        digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                        digest = base64.b32decode(digest).hex() if digest else None
                        if payload is not None:
                            found = hashlib.sha1(payload).hexdigest()
                            ok, digest = digest in (None, found), found
                        row = [names[i], h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), status, line, None if payload is None else len(payload), digest, ok, list(fields.items())]
                        rows.append([*row, payload] if with_payload else row)
                        size += len(block) if with_payload else 500
                        if size > 8_000_000 or len(rows) >= 5000:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return spark.range(0, len(names), 1, len(names)).mapInArrow(read, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, kind, target_uri, refers_to, request, response, metadata."""
    main = records.where(F.col("kind").isin("response", "revisit"))
    payload = ["payload"] if "payload" in records.columns else []
    main = main.select("file", F.col("record_id").alias("capture_id"), "kind", "target_uri", "refers_to", F.struct("status", "payload_bytes", "payload_digest", "digest_ok", *payload).alias("response"))
    request = records.where("kind = 'request' and concurrent_to is not null").select("file", F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "request_line").alias("request"))
    metadata = records.where("kind = 'metadata' and concurrent_to is not null").select("file", F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "fields").alias("metadata"))
    return main.join(request, ["file", "capture_id"], "left").join(metadata, ["file", "capture_id"], "left")


def op5_warc_transactions(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = new_path(spark, "warc")
    names = write_archives(pages, out)
    # Written once: the joins read it several times, and Spark sees its true size and doesn't broadcast it.
    between = [new_path(spark, "warc-records"), new_path(spark, "warc-captures")]
    captures = assemble(written(read_archives(spark, out, names), between[0]))
    field = lambda k: F.col("metadata.fields")[k].cast("long")
    flat = captures.select(field("page-id").alias("page_id"), "capture_id", F.coalesce("response.payload_bytes", field("payload-bytes")).alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_to").alias("refers_to_id"))
    flat = written(flat, between[1])
    revisited = flat.where("record_type = 'response'").select(F.col("capture_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    first = revisited.join(flat.where("refers_to_id is not null").select("refers_to_id").distinct(), "refers_to_id", "left_semi").groupBy("refers_to_id").agg(F.max("refers_to").alias("refers_to"))
    # responses refer to nothing: they stay out of the join, where they would all share the null key
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = flat.where("refers_to_id is not null").join(first, "refers_to_id", "left").select(*columns)
    result = written(revisits.unionByName(flat.where("refers_to_id is null").select(*columns[:-1], F.lit(None).cast("long").alias("refers_to"))), new_path(spark, "warc-digests"))
    release(spark)
    delete(spark, *between)
    return result


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS digest, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND last <> page_id THEN last END AS refers_to
FROM g
"""
