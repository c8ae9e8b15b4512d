"""Benchmark decontamination: size-partitioned MinHash containment search, by DataFrame operations only.

Items are short and documents long, so their Jaccard similarity says nothing; what counts is the share of an item's
word shingles that a document holds. Items are partitioned by size (powers of two of their distinct shingles), and
each size class has its own MinHash sketch and rule: the sketch is the ``k`` smallest shingle hashes (all of them for
small items), and a document is a candidate if it holds at least ``m`` of them, where m is the largest number for which
an item at the threshold is missed with a probability of at most ``miss``. Candidates are verified by exact shingle
containment, on the words themselves.

The search is one scan of the documents: each shingle is hashed and looked up in the sketches; only hits are shuffled
(partially counted before), and candidate pairs are written. A second scan picks the candidates' texts. Sketches, item
shingles and candidate ids are broadcast only if they have at most ``broadcast_rows`` rows, which is counted first;
beyond that Spark joins by shuffle. A passage that a third of the documents holds gives one pair per document and item,
dealt by document.

An item of one to four words is one shingle of its own length, and documents are cut into shingles of the lengths that
items have. A row's shingles are made of shifted views of its words, five numbers a word at a time, however long it is.

Cases: rows with equal doc_id are one document (null is an id of its own), as are benchmark rows with equal item_id;
null and empty texts, and those without a word, match nothing; ties at the threshold count; an empty table on either
side gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm._common import new_path, union_all, written


@dataclass(frozen=True)
class DecontaminationParams:
    words: int = 5
    threshold: float = 0.8
    sketch: int = 16
    miss: float = 1e-6
    broadcast_rows: int = 1_000_000


def words_of(col: str = "text"):
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def needed_hits(k: int, p: DecontaminationParams) -> int:
    """The largest m with P(fewer than m of k sketch members are held | containment = threshold) <= miss; at least 1."""
    m, below = 0, 0.0
    while m < k:
        below += comb(k, m) * p.threshold**m * (1 - p.threshold) ** (k - m)
        if below > p.miss:
            break
        m += 1
    return max(1, m)


def shingle_columns(df: DataFrame, keys: list[str], p: DecontaminationParams, words: str, sizes: list[int]) -> DataFrame:
    """One row per shingle of each of ``sizes`` of the array column ``words``: the keys and w0, w1, ... (null beyond its size)."""
    n, parts = F.size(words), []
    for k in sizes:
        shifted = [F.col(words) if i == 0 else F.slice(words, F.lit(i + 1), F.greatest(n - i, F.lit(0))) for i in range(k)]
        long = df.where(n >= k).select(*keys, F.explode(F.slice(F.arrays_zip(*[s.alias(f"w{i}") for i, s in enumerate(shifted)]), F.lit(1), n - (k - 1))).alias("s"))
        fields, kind = long.schema["s"].dataType.names, df.schema[words].dataType.elementType
        parts.append(long.select(*keys, *[F.col(f"s.`{f}`").alias(f"w{i}") for i, f in enumerate(fields)], *[F.lit(None).cast(kind).alias(f"w{i}") for i in range(k, p.words)]))
    return union_all(parts)


def hashed_shingles(df: DataFrame, key: str, p: DecontaminationParams, sizes: list[int]) -> DataFrame:
    """(key, h) of every shingle of the column text."""
    coded = df.select(key, F.transform(words_of(), lambda w: F.xxhash64(w)).alias("words"))
    return shingle_columns(coded, [key], p, "words", sizes).select(key, F.xxhash64(*[f"w{i}" for i in range(p.words)]).alias("h"))


def of_items(benchmark: DataFrame, p: DecontaminationParams, sizes: list[int], cut) -> DataFrame:
    """``cut(rows, sizes)`` of the items: those of fewer than ``words`` words as one shingle of their length."""
    n = F.size(words_of())
    return union_all([cut(benchmark.where(n >= p.words if k == p.words else n == k), [k]) for k in sizes])


def sketches(benchmark: DataFrame, p: DecontaminationParams, sizes: list[int]) -> DataFrame:
    """(item_id, h, size_class, needed): the sketch members of each item under its class's rule."""
    each = of_items(benchmark, p, sizes, lambda rows, k: hashed_shingles(rows, "item_id", p, k)).distinct()
    sized = each.groupBy("item_id").agg(F.array_sort(F.collect_list("h")).alias("hs"))  # an item is short
    k = F.least(F.size("hs"), F.lit(p.sketch))
    needed = F.lit(1)
    for i in range(1, p.sketch + 1):
        needed = F.when(k == i, F.lit(needed_hits(i, p))).otherwise(needed)
    classed = sized.select("item_id", F.floor(F.log2(F.size("hs").cast("double"))).cast("int").alias("size_class"), needed.alias("needed"), F.slice("hs", F.lit(1), k).alias("hs"))
    return classed.select("item_id", "size_class", "needed", F.explode("hs").alias("h"))


def search_containment(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of each pair with containment >= threshold."""
    p, spark = params, docs.sparkSession
    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text")
    sizes = sorted(r[0] for r in benchmark.select(F.least(F.size(words_of()), F.lit(p.words))).distinct().collect() if r[0] > 0) or [p.words]  # words at most
    small = lambda df, n: F.broadcast(df) if n <= p.broadcast_rows else df
    sketch = sketches(benchmark, p, sizes)
    hits = hashed_shingles(docs, "doc_id", p, sizes).join(small(sketch, sketch.count()), "h").groupBy("doc_id", "item_id", "size_class", "needed").agg(F.count_distinct("h").alias("hits"))
    candidates = written(hits.where("hits >= needed").select(F.col("doc_id").alias("c_doc"), F.col("item_id").alias("c_item")), new_path(spark, "leak-candidates"))
    # verification, on words
    item_words = of_items(benchmark, p, sizes, lambda rows, k: shingle_columns(rows.select("item_id", words_of().alias("words")), ["item_id"], p, "words", k)).distinct()
    per_item = item_words.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    wanted = candidates.select("c_doc").distinct()
    among = docs.join(small(wanted, wanted.count()), F.col("doc_id").eqNullSafe(F.col("c_doc")), "left_semi")
    doc_words = shingle_columns(among.select("doc_id", words_of().alias("words")), ["doc_id"], p, "words", sizes)
    n_items = per_item.agg(F.sum("n_shingles")).first()[0] or 0
    ws = [f"w{i}" for i in range(p.words)]
    blank = lambda df: df.select(*[c for c in df.columns if c not in ws], *[F.coalesce(w, F.lit("")).alias(w) for w in ws])
    found = blank(doc_words).join(small(blank(item_words), n_items), ws).groupBy("doc_id", "item_id").agg(F.count_distinct(*ws).alias("n_found"))
    pair = F.col("doc_id").eqNullSafe(F.col("c_doc")) & F.col("item_id").eqNullSafe(F.col("c_item"))
    verified = found.join(candidates, pair, "left_semi").join(per_item.withColumnRenamed("item_id", "s_item"), F.col("item_id").eqNullSafe(F.col("s_item")))
    return verified.select("doc_id", "item_id", "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment")).where(F.col("containment") >= p.threshold)


def op8_decontamination(spark, sf_dir):
    found = search_containment(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("containment", F.round("containment", 6))


OP8_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark),
k AS (SELECT DISTINCT least(len(ws), 5) AS k FROM bw WHERE len(ws) > 0),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(len(ws) - k + 1), lambda i: array_to_string(ws[i + 1:i + k], ' '))) AS s FROM dw JOIN k ON len(ws) >= k),
b5 AS (SELECT item_id, ws, least(len(ws), 5) AS k FROM bw WHERE len(ws) > 0),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(len(ws) - k + 1), lambda i: array_to_string(ws[i + 1:i + k], ' '))) AS s FROM b5),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_found, round(n_found / n_shingles, 6) AS containment
FROM f JOIN n USING (item_id) WHERE n_found / n_shingles >= 0.8
"""
