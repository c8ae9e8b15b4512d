"""Packing into length buckets that minimise padding.

Lengths are the texts' words (or a given column). Their global histogram has a row for each length that occurs, so what
reaches the driver is bounded by the longest text, not by the corpus. Dynamic programming over it chooses at most
``buckets`` boundaries (lengths that occur) with the least padding of all choices. Batches of at most ``budget`` padded
tokens form inside a bucket.

A bucket can hold most of the corpus, so it is dealt out in shards by a hash of the row and its place in the input, as
many as its count in the histogram asks for (``shard_rows`` each); rows are numbered within a shard, and each shard ends
with at most one batch that isn't full. Nothing is numbered globally, and rows that are equal in all columns spread too.

Cases: a null or empty text has length 0 and is packed with the shortest; a null or repeated doc_id is a row of its
own (ties are broken by a hash of the text, and equal rows may take each other's place); a text longer than the budget
is a batch of its own; an empty table gives an empty result; other columns pass through, and those named like an
output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PackingParams:
    buckets: int = 16
    budget: int = 8192
    shard_rows: int = 4096


ADDED = ("n_tokens", "bucket", "bucket_tokens", "batch_id", "batch_row", "padding")


def text_length(col: str = "text"):
    """Words between ASCII white space, counted without building them."""
    t = F.coalesce(F.col(col), F.lit(""))
    return F.regexp_count(t, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def histogram(lengths: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The lengths that occur, in order, and how often; ``lengths`` has a column n_tokens."""
    got = lengths.groupBy("n_tokens").agg(F.count("*").alias("rows")).toArrow()
    length, rows = (got.column(c).to_numpy().astype(np.int64) for c in ("n_tokens", "rows"))
    order = np.argsort(length)
    return length[order], rows[order]


def best_boundaries(length: np.ndarray, rows: np.ndarray, buckets: int) -> list[int]:
    """Bucket lengths with the least padding over the histogram (``length`` ascending).

    The best last bucket of the first j lengths never begins earlier when j grows, so each layer of the dynamic
    programme halves its ranges instead of trying all pairs.
    """
    n = len(length)
    if not n:
        return []
    count, tokens = (np.concatenate([[0], np.cumsum(x)]) for x in (rows, length * rows))
    best = np.append(0, np.full(n, np.iinfo(np.int64).max // 4))  # least padding of the first j lengths, no bucket yet
    came, costs = [], []
    for _ in range(min(buckets, n)):
        new, begin = best.copy(), np.zeros(n + 1, dtype=np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            padding = best[i] + length[j - 1] * (count[j] - count[i]) - (tokens[j] - tokens[i])
            at = int(np.argmin(padding))
            new[j], begin[j] = padding[at], i[at]
            todo += [(lo, j - 1, first, int(i[at])), (j + 1, hi, int(i[at]), last)]
        best = new
        best[0] = np.iinfo(np.int64).max // 4  # a bucket holds a length at least
        came.append(begin)
        costs.append(best[n])
    out, j = [], n
    for begin in came[int(np.argmin(costs)) :: -1]:
        out.append(int(length[j - 1]))
        j = int(begin[j])
    return out[::-1]


def pack_documents(docs: DataFrame, params: PackingParams = PackingParams(), length=None) -> DataFrame:
    """Append n_tokens, bucket, bucket_tokens, batch_id, batch_row and padding to ``docs`` (doc_id, text)."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ADDED]).withColumn("n_tokens", text_length() if length is None else length.cast("long"))
    length, count = histogram(docs.select("n_tokens"))
    bounds = best_boundaries(length, count, params.buckets) or [0]
    rows = np.bincount(np.searchsorted(bounds, length), count, minlength=len(bounds)).astype(np.int64).tolist()
    n = F.col("n_tokens")
    bucket, tokens, shards = F.lit(len(bounds) - 1), F.lit(bounds[-1]).cast("long"), F.lit(max(1, -(-rows[-1] // params.shard_rows)))
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(n <= bounds[i], F.lit(i)).otherwise(bucket)
        tokens = F.when(n <= bounds[i], F.lit(bounds[i]).cast("long")).otherwise(tokens)
        shards = F.when(n <= bounds[i], F.lit(max(1, -(-rows[i] // params.shard_rows)))).otherwise(shards)
    dealt = docs.withColumns({"bucket": bucket.cast("int"), "bucket_tokens": tokens, "__key": F.xxhash64("doc_id", "text"), "__n": shards.cast("long")})
    dealt = dealt.withColumn("__shard", F.pmod(F.xxhash64(F.lit(7), "__key", F.monotonically_increasing_id()), F.col("__n")))
    w = Window.partitionBy("bucket", "__shard").orderBy(F.asc_nulls_first("doc_id"), "__key")
    fit = F.greatest(F.lit(1), F.floor(F.lit(params.budget) / F.greatest(F.col("bucket_tokens"), F.lit(1)))).cast("int")
    numbered = dealt.withColumns({"__at": F.row_number().over(w) - 1, "__fit": fit})
    batch = F.format_string("%d-%d-%d", "bucket", "__shard", F.floor(F.col("__at") / F.col("__fit")).cast("long"))
    out = numbered.withColumns({"batch_id": batch, "batch_row": (F.col("__at") % F.col("__fit")).cast("int"), "padding": F.col("bucket_tokens") - F.col("n_tokens")})
    return out.drop("__key", "__n", "__shard", "__at", "__fit")


def op4_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs).select("doc_id", *ADDED)
