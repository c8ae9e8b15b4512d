"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is fitted in numpy from confirmed toxic texts (P) and
unlabelled texts (U) with the class-prior-corrected, non-negative risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),      l(z) = log(1 + exp(-z)).

Whenever the second term falls below zero its gradient is reversed, as the method demands. Negative labels never
enter the risk; they are counted once, to estimate the class prior.

Features are those whose frequencies in P and U differ significantly, in either direction, so weights can speak for and
against toxicity; which of them matter, and the intercept, is left to the risk.

Fitting reads a bounded sample (``max_positive`` and ``max_unlabelled`` texts, documented parameters). Scoring is one
Arrow pass over whole texts without a shuffle; the model is at most ``max_features`` weights.

Cases: a null or empty text has no features and gets the score of the intercept; a null or repeated doc_id is scored
row by row; repeated label rows of a document count as toxic if one of them does; null labels are ignored; without a
positive label every score is 0; an empty table gives an empty result; columns of the input pass through, and those
named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesieve.llm._common import bounded_sample, crc_mod, delete, new_path, partitions, small_steps, tune, with_columns_from_arrow, written
from pagesieve.llm._words import letter_words

PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class ToxicityParams:
    max_positive: int = 6_000
    max_unlabelled: int = 12_000
    max_features: int = 4_000
    #: a feature is used if so many texts of the sample hold it and its shares of P and U are so many standard errors apart
    min_texts: int = 3
    min_z: float = 3.0
    steps: int = 400
    rate: float = 0.1
    l2: float = 1e-5
    threshold: float = 0.5


@dataclass
class ToxicityModel:
    features: dict[int, int] = field(default_factory=dict)  #: feature hash -> index
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = -1e9
    prior: float = 0.0


def word_features(word: str) -> list[int]:
    """Hashes of a word and its beginnings."""
    import xxhash

    own = [xxhash.xxh64_intdigest(word)]
    own += [xxhash.xxh64_intdigest(f"^{word[:n]}") for n in PREFIXES if len(word) >= n]
    return [h >> 1 for h in own]


def _doc_features(texts, cache: dict, pick) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, count) of each pair that occurs, and the words of each document."""
    n = len(texts)
    doc, code, words = letter_words(texts)
    if len(cache) > 400_000:
        cache.clear()
    lists = []
    for w in words:
        f = cache.get(w)
        if f is None:
            f = cache[w] = pick(word_features(w)) if w else ()
        lists.append(f)
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.fromiter((x for f in lists for x in f), dtype=np.int64, count=int(sizes.sum()))
    start = np.concatenate([[0], np.cumsum(sizes)])[:-1] if len(sizes) else np.zeros(0, np.int64)
    total = np.bincount(doc, minlength=n)
    k = sizes[code] if len(code) else np.zeros(0, np.int64)
    hit = k > 0
    doc, code, k = doc[hit], code[hit], k[hit]
    if not len(doc):
        z = np.zeros(0, np.int64)
        return z, z, z, total
    at = np.repeat(start[code] - (np.cumsum(k) - k), k) + np.arange(k.sum())
    pair_doc, pair_f = np.repeat(doc, k), flat[at]
    order = np.lexsort((pair_f, pair_doc))
    pair_doc, pair_f = pair_doc[order], pair_f[order]
    first = np.flatnonzero(np.concatenate([[True], (pair_doc[1:] != pair_doc[:-1]) | (pair_f[1:] != pair_f[:-1])]))
    return pair_doc[first], pair_f[first], np.diff(np.append(first, len(pair_doc))), total


def feature_value(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How much of a text a feature makes up: rises with its share, not with the text's length, and is at most 1."""
    return np.minimum(1.0, 6.0 * np.sqrt(count / np.maximum(words, 1)))


def nnpu_fit(rows_p, rows_u, n_features: int, prior: float, p: ToxicityParams) -> tuple[np.ndarray, float]:
    """Fit by Adam. ``rows_*``: lists of (indices, values)."""

    def csr(rows):
        ptr = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
        cat = lambda k, kind: np.concatenate([np.asarray(r[k], kind) for r in rows]) if rows else np.zeros(0, kind)
        return len(rows), ptr, cat(0, np.int64), cat(1, np.float64)

    mp, mu = csr(rows_p), csr(rows_u)
    w, b = np.zeros(n_features), 0.0
    m1, m2 = np.zeros(n_features + 1), np.zeros(n_features + 1)
    score = lambda m: np.bincount(m[1], m[3] * w[m[2]], minlength=m[0]) + b
    sig = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
    loss = lambda z: np.logaddexp(0.0, -z)

    def pulled(m, dz):
        dz = dz / max(m[0], 1)
        return np.append(np.bincount(m[2], m[3] * dz[m[1]], minlength=n_features), dz.sum())

    for step in range(1, p.steps + 1):
        zp, zu = score(mp), score(mu)
        negative = loss(-zu).mean() - prior * loss(-zp).mean()
        g_negative = pulled(mu, sig(zu)) - prior * pulled(mp, sig(zp))
        if negative >= 0:
            g = prior * pulled(mp, -sig(-zp)) + g_negative
        else:
            g = -g_negative
        g[:-1] += p.l2 * w
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.999 * m2 + 0.001 * g * g
        move = p.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn=None, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); only rows for which ``learn`` holds are used."""
    spark = tune(docs.sparkSession)
    learn = F.lit(True) if learn is None else learn
    known = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior, n_pos = known.agg(F.avg("toxic"), F.sum(F.col("toxic").cast("long"))).first()
    if not n_pos:
        return ToxicityModel()
    prior = float(min(max(prior, 1e-4), 0.9))
    positive = bounded_sample(known.where("toxic = 1").select("doc_id"), params.max_positive, "doc_id")
    text = docs.where(learn).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # The ids are at most max_positive longs: a proven bound, so they may be broadcast.
    p_rows = text.join(F.broadcast(positive), "doc_id", "left_semi").select("text", F.lit(1).alias("pos"))
    u_rows = bounded_sample(text, params.max_unlabelled, "doc_id").select("text", F.lit(0).alias("pos"))
    path = new_path(spark, "toxicity-sample")
    sample = written(p_rows.unionByName(u_rows).repartition(max(8, min(64, partitions(spark)))), path)

    def count(batches):
        import pyarrow as pa

        cache: dict = {}
        for b in small_steps(batches, ["text"]):
            doc, f, _, _ = _doc_features(b.column(0), cache, tuple)
            pos = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            u, inv = np.unique(f, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(np.bincount(inv, pos[doc], minlength=len(u)).astype(np.int64)), pa.array(np.bincount(inv, ~pos[doc], minlength=len(u)).astype(np.int64))], names=["f", "p", "u"])

    sizes = {r["pos"]: r["n"] for r in sample.groupBy("pos").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(1, 0), max(1, sizes.get(0, 0))
    if not n_p:
        delete(spark, path)
        return ToxicityModel(prior=prior)
    share = (F.col("p") + F.col("u")) / (n_p + n_u)
    apart = F.abs(F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)
    best = sample.mapInArrow(count, "f long, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).withColumn("z", apart).where((F.col("p") + F.col("u") >= params.min_texts) & (F.col("z") >= params.min_z))
    picked = [r["f"] for r in best.orderBy(F.desc("z"), "f").limit(params.max_features).collect()]
    index = {f: i for i, f in enumerate(picked)}

    def rows(batches):
        import pyarrow as pa

        cache: dict = {}
        for b in small_steps(batches, ["text"]):
            doc, f, c, total = _doc_features(b.column(0), cache, lambda fs: tuple(index[x] for x in fs if x in index))
            v = feature_value(c, total[doc])
            at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            parts = list(zip(at[:-1], at[1:]))
            yield pa.RecordBatch.from_arrays([b.column(1), *[pa.array([x[i:j].astype(kind).tobytes() for i, j in parts], pa.binary()) for x, kind in ((f, "<i4"), (v, "<f8"))]], names=["pos", "i", "v"])

    got = sample.mapInArrow(rows, "pos int, i binary, v binary").collect()  # bounded by the sample
    delete(spark, path)
    got.sort(key=lambda r: (r["pos"], bytes(r["i"]), bytes(r["v"])))  # the order of the sample's partitions doesn't matter
    some = lambda pos: [(np.frombuffer(r["i"], "<i4"), np.frombuffer(r["v"], "<f8")) for r in got if r["pos"] == pos]
    w, b = nnpu_fit(some(1), some(0), len(index), prior, params)
    return ToxicityModel(index, w, float(b), prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, params: ToxicityParams = ToxicityParams(), keep: list[str] | None = None) -> DataFrame:
    """Append score (0 to 1) and predicted (1 if score >= threshold) to ``docs``."""
    tune(docs.sparkSession)
    threshold = params.threshold

    # the model travels as arrays; each Python worker makes its dictionary once
    hashes, weights, intercept = np.array(list(model.features), dtype=np.int64), np.asarray(model.weights), model.intercept
    shared = docs.sparkSession.sparkContext.broadcast((hashes, weights, intercept))

    def fn(cols):
        import pyarrow as pa

        hashes, weights, intercept = shared.value
        if "at" not in state:
            state["at"] = {int(h): i for i, h in enumerate(hashes)}
        at = state["at"]
        texts = cols["text"]
        doc, f, c, total = _doc_features(texts, state.setdefault("cache", {}), lambda fs: tuple(at[x] for x in fs if x in at))
        z = np.bincount(doc, feature_value(c, total[doc]) * weights[f], minlength=len(texts)) if len(doc) else np.zeros(len(texts))
        s = 1.0 / (1.0 + np.exp(-np.clip(z + intercept, -60, 60)))
        s = np.where(intercept < -1e8, 0.0, s)
        return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]

    state: dict = {}
    return with_columns_from_arrow(docs, fn, ["text"], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], keep)


def learnable(col: str = "doc_id"):
    """Rows that labels may be learned from; the others are held out."""
    return crc_mod(col, 5) != 0


def op2_toxicity(spark, sf_dir):
    """Scores of all documents, learned without the held-out fifth."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels, learnable())
    scored = score_toxicity(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", (~learnable()).alias("held_out"), "score", "predicted")
