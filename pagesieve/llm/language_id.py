"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed 1- to 3-grams of lower-case letters (runs of other characters are one space) per language. It
reads at most about ``max_docs`` labelled texts (a documented parameter; all of them if there are fewer), counts them
in Arrow tasks, and sums per (language, bucket) in Spark. The log-probability matrix, ``2**bits`` rows by languages, is
broadcast: its size is fixed by the parameters. Scoring gathers matrix rows for the n-grams of a batch and sums them
per document in numpy; it needs no shuffle.

Cases: a null text, or one without a letter, gives ``und`` and score 0; null and repeated ids are kept row by row; rows
with a null language teach nothing; without a labelled row every text gives ``und``; ties go to the first language in
alphabetical order; an empty table gives an empty result; other columns pass through, and those named like an output
column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesieve.llm._common import bounded_sample, crc_mod, small_steps, tune, with_columns_from_arrow


@dataclass(frozen=True)
class LanguageParams:
    bits: int = 15
    orders: tuple[int, ...] = (1, 2, 3)
    max_docs: int = 30_000
    smoothing: float = 0.5
    #: characters that are handled at once; longer texts are handled in pieces that overlap by an n-gram
    piece: int = 1_000_000


@dataclass
class LanguageModel:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  #: (buckets, languages), float32


_LETTER = None


def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a space."""
    global _LETTER
    if _LETTER is None:
        t = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):  # all planes: letters go beyond the second one
            if chr(c).isalpha():
                t[c] = c
        _LETTER = t
    return _LETTER


def ngrams(texts: list[str], p: LanguageParams):
    """(document, bucket) of every n-gram, piece by piece, and whether each text has a letter."""
    table, has = _letters(), np.zeros(len(texts), dtype=bool)
    todo, size = [], 0
    longest = max(p.orders)

    def flush():
        codes = table[np.frombuffer("".join(t for _, t, _ in todo).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        lengths = np.array([len(t) for _, t, _ in todo])
        starts = np.array([s for _, _, s in todo])  # n-grams may begin in the first so many characters of a piece
        doc = np.repeat(np.array([i for i, _, _ in todo]), lengths)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters up to the piece's end
        begins = np.repeat(lengths, lengths) - left < np.repeat(starts, lengths)
        has[np.unique(doc[codes != 32])] = True
        out = []
        h = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, longest + 1):
            m = len(codes) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x100000001B3) + codes[n - 1 : n - 1 + m] + np.uint64(1)
            if n in p.orders:
                ok = (left[:m] >= n) & begins[:m] & (codes[:m] != 32)
                if n > 1:
                    ok |= (left[:m] >= n) & begins[:m] & (codes[1 : m + 1] != 32)  # no n-gram of two leading spaces
                x = h[ok] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)
                x ^= x >> np.uint64(29)
                x *= np.uint64(0xBF58476D1CE4E5B9)
                out.append((doc[:m][ok], (x >> np.uint64(64 - p.bits)).astype(np.int64)))
        return out

    for i, t in enumerate(texts):
        t = t.lower()
        for a in range(0, len(t), p.piece):
            todo.append((i, t[a : a + p.piece + longest - 1], min(p.piece, len(t) - a)))
            size += len(todo[-1][1])
            if size >= p.piece:
                yield from flush()
                todo, size = [], 0
    if todo:
        yield from flush()
    yield has


def fit_language(docs: DataFrame, learn=None, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Fit from ``docs`` (doc_id, text, lang)."""
    spark = tune(docs.sparkSession)
    known = docs.where((F.lit(True) if learn is None else learn) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = bounded_sample(known.select("doc_id", "text", "lang"), params.max_docs, "doc_id").select("lang", "text")
    buckets = 1 << params.bits

    def count(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for b in small_steps(batches, ["text"]):
            langs = b.column(0).to_pylist()
            for name in sorted(set(langs)):
                if name not in sums:
                    sums[name] = np.zeros(buckets + 1, dtype=np.int64)
                at = [i for i, x in enumerate(langs) if x == name]
                sums[name][buckets] += len(at)
                for got in ngrams([b.column(1)[i].as_py() for i in at], params):
                    if isinstance(got, tuple):
                        sums[name][:buckets] += np.bincount(got[1], minlength=buckets)
        for name, v in sums.items():
            i = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(v[i])], names=["lang", "i", "n"])

    def pack(key, pdf):  # at most 2**bits + 1 rows for a language
        import pandas as pd

        v = np.zeros(buckets + 1, dtype=np.int64)
        v[pdf["i"].to_numpy()] = pdf["n"].to_numpy()
        return pd.DataFrame({"lang": [key[0]], "v": [v.tobytes()]})

    summed = sample.mapInArrow(count, "lang string, i int, n long").groupBy("lang", "i").agg(F.sum("n").alias("n"))
    rows = sorted((r["lang"], np.frombuffer(r["v"], dtype=np.int64)) for r in summed.groupBy("lang").applyInPandas(pack, "lang string, v binary").collect())
    if not rows:
        return LanguageModel([], np.zeros(0), np.zeros((buckets, 0), dtype=np.float32))
    counts = np.stack([v[:buckets] for _, v in rows], axis=1) + params.smoothing
    prior = np.array([v[buckets] for _, v in rows], dtype=float)
    return LanguageModel([x for x, _ in rows], np.log(prior / prior.sum()), np.log(counts / counts.sum(axis=0)).astype(np.float32))


def predict_language(docs: DataFrame, model: LanguageModel, params: LanguageParams = LanguageParams(), keep: list[str] | None = None) -> DataFrame:
    """Append lang_pred and score to ``docs`` (text). The score is the posterior, tempered by the text's length."""
    spark = tune(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model.languages, model.log_prior, model.log_prob))

    def fn(cols):
        import pyarrow as pa

        languages, log_prior, log_prob = shared.value
        texts = cols["text"].fill_null("").to_pylist()
        n, k = len(texts), len(languages)
        if not k:
            return [pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n))]
        ll, grams, has = np.zeros((n, k)), np.zeros(n), np.zeros(n, dtype=bool)
        for got in ngrams(texts, params):
            if isinstance(got, tuple):
                doc, bucket = got
                if len(doc):
                    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    ids = doc[first]
                    for j in range(k):
                        ll[ids, j] += np.add.reduceat(log_prob[:, j][bucket], first, dtype=np.float64)
                    grams[ids] += np.diff(np.append(first, len(doc)))
            else:
                has = got
        z = (ll + log_prior) / np.sqrt(np.maximum(grams, 1.0))[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        best = z.argmax(axis=1)
        return [pa.array([languages[b] if h else "und" for b, h in zip(best, has)], pa.string()), pa.array(np.where(has, z[np.arange(n), best], 0.0))]

    return with_columns_from_arrow(docs, fn, ["text"], [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], keep)


def learnable(col: str = "doc_id"):
    """Rows that languages may be learned from; the others are held out."""
    return crc_mod(col, 4) != 2


def op9_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_language(docs, learnable())
    got = predict_language(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return got.select("doc_id", (~learnable()).alias("held_out"), "lang_pred", "score")
