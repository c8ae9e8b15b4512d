"""Language-model scores by stupid backoff, from n-gram counts of the corpus itself.

The count tables of all orders are partitioned by the hash of the n-gram and joined to the n-grams that each block of
documents explodes into (``_blocks.corpus_counts``: packed rows of n-grams, one row per block and hash partition); the
counts come back to the block, and logarithms are summed per document. A document's own n-grams are taken out of the
counts that score it, so a text isn't judged by itself:

    S(w | context) = c(context w) / c(context) if c(context w) > 0 else backoff * S(w | shorter context)
    S(w) = c(w) / N, and 1 / (N + 1) for a word that no other document holds

with c and N over all other documents. Words are runs of anything but ASCII white space, in lower case.

Nothing is broadcast and nothing corpus-wide reaches the driver but the number of words. Blocks are written to the
shared folder. Cases: a null or empty text has 0 words, log_score 0 and a null mean; null and repeated ids are
documents of their own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm._blocks import Block, BlockParams, corpus_counts, make_blocks, mix, total_words, totals_of
from pagesieve.llm._common import delete, new_path, release, union_all, written


@dataclass(frozen=True)
class LmParams:
    order: int = 3
    backoff: float = 0.4
    blocks: BlockParams = BlockParams(block_words=1_000_000)


def grams(block: Block, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..order: (index of the n-gram that ends at each word, -1 if the document began less than n ago; hashes)."""
    n, doc = len(block.codes), block.doc
    out = [(block.codes, mix(block.words, 1))]
    for k in range(2, order + 1):
        before, hashes = out[-1]
        index = np.full(n, -1, dtype=np.int64)
        ok = np.flatnonzero((doc[1:] == doc[:-1]) & (before[:-1] >= 0)) + 1
        pair = before[ok - 1] * max(len(block.words), 1) + block.codes[ok]
        distinct, inv = np.unique(pair, return_inverse=True)
        index[ok] = inv
        w = max(len(block.words), 1)
        out.append((index, mix(mix(hashes[distinct // w], k), block.words[distinct % w])))
    return out


def score_documents(docs: DataFrame, params: LmParams = LmParams()) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score, n_backed_off and n_unseen of every row of ``docs`` (doc_id, text)."""
    spark, paths = docs.sparkSession, []

    def store(df, name):
        paths.append(new_path(spark, f"lm-{name}"))
        return written(df, paths[-1])

    blocks, path = make_blocks(docs, "lm-blocks", params.blocks)
    paths.append(path)
    n_words = total_words(blocks)
    order, backoff = params.order, params.backoff

    def derive(k):
        def keys(row):
            index, hashes = grams(Block.of(row), k)[-1]
            by_hash, inv = np.unique(hashes, return_inverse=True)
            return by_hash, np.bincount(inv[index[index >= 0]], minlength=len(by_hash))

        return keys

    def score(key, left, right):
        import pandas as pd

        out = []
        for _, row in left.iterrows():
            block = Block.of(row)
            doc, n_docs = block.doc, len(block.ends)
            levels = grams(block, order)
            totals = []
            for k, (_, hashes) in enumerate(levels, 1):
                by_hash, inv = np.unique(hashes, return_inverse=True)
                totals.append(totals_of(by_hash, right[right["size"] == k])[inv])
            rest = []  # counts of the n-gram at each word in all other documents
            for (index, hashes), total in zip(levels, totals):
                ok = index >= 0
                pair = doc[ok] * max(len(hashes), 1) + index[ok]
                _, inv, own = np.unique(pair, return_inverse=True, return_counts=True)
                r = np.zeros(len(index), dtype=np.int64)
                r[ok] = total[index[ok]] - own[inv]
                rest.append(r)
            others = n_words - np.diff(np.append(0, block.ends))[doc]  # words of all other documents
            s = np.where(rest[0] > 0, np.log(np.maximum(rest[0], 1) / np.maximum(others, 1)), -np.log(others + 1.0))
            backed = np.zeros(len(s), dtype=bool)
            for k in range(1, order):
                has = levels[k][0] >= 0
                seen = has & (rest[k] > 0)
                context = np.append(0, rest[k - 1][:-1])
                s = np.where(seen, np.log(np.maximum(rest[k], 1) / np.maximum(context, 1)), np.where(has, np.log(backoff) + s, s))
                backed = has & ~seen
            n = np.bincount(doc, minlength=n_docs)
            total_score = np.bincount(doc, s, minlength=n_docs)
            out.append(
                pd.DataFrame(
                    {
                        "doc_id": pd.array(block.doc_ids, dtype="Int64"),
                        "n_words": n,
                        "log_score": total_score,
                        "mean_log_score": pd.array(np.where(n > 0, total_score / np.maximum(n, 1), np.nan)),
                        "n_backed_off": np.bincount(doc, backed, minlength=n_docs).astype(np.int64),
                        "n_unseen": np.bincount(doc, rest[0] <= 0, minlength=n_docs).astype(np.int64),
                    }
                )
            )
            out[-1].loc[block.no_id, "doc_id"] = pd.NA
        schema = ["doc_id", "n_words", "log_score", "mean_log_score", "n_backed_off", "n_unseen"]
        return pd.concat(out) if out else pd.DataFrame(columns=schema)

    # one order after the other, so that shuffle files of one order are held at a time
    counts = []
    for k in range(1, order + 1):
        counts.append(store(corpus_counts(blocks, derive(k), n_words, store, params.blocks).withColumn("size", F.lit(k)), f"counts{k}"))
        release(spark)
    scored = blocks.groupBy("block").cogroup(union_all(counts).groupBy("block")).applyInPandas(score, "doc_id long, n_words long, log_score double, mean_log_score double, n_backed_off long, n_unseen long")
    out = store(scored, "scores")
    release(spark)
    delete(spark, *paths[:-1])
    return out


def op3_lm_scores(spark, sf_dir):
    got = score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"), "n_backed_off", "n_unseen")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
b AS (SELECT r, i, w, lag(w) OVER k AS v, lag(w, 2) OVER k AS u FROM t WINDOW k AS (PARTITION BY r ORDER BY i)),
total AS (SELECT count(*) AS n FROM t),
g AS (
  SELECT r, i, 1 AS size, [w] AS gram FROM b
  UNION ALL SELECT r, i, 2, [v, w] FROM b WHERE v IS NOT NULL
  UNION ALL SELECT r, i, 3, [u, v, w] FROM b WHERE u IS NOT NULL),
own AS (SELECT r, gram, count(*) AS c FROM g GROUP BY r, gram),
everywhere AS (SELECT gram, sum(c) AS c FROM own GROUP BY gram),
rest AS (SELECT g.r, g.i, g.size, everywhere.c - own.c AS c FROM g JOIN own USING (r, gram) JOIN everywhere USING (gram)),
s AS (
  SELECT b.r, b.i, total.n - len(d.ws) AS n, c1.c AS c1, c2.c AS c2, c3.c AS c3, p1.c AS p1, p2.c AS p2
  FROM b JOIN d USING (r) CROSS JOIN total
  JOIN rest c1 ON c1.r = b.r AND c1.i = b.i AND c1.size = 1
  LEFT JOIN rest c2 ON c2.r = b.r AND c2.i = b.i AND c2.size = 2
  LEFT JOIN rest c3 ON c3.r = b.r AND c3.i = b.i AND c3.size = 3
  LEFT JOIN rest p1 ON p1.r = b.r AND p1.i = b.i - 1 AND p1.size = 1
  LEFT JOIN rest p2 ON p2.r = b.r AND p2.i = b.i - 1 AND p2.size = 2),
l AS (
  SELECT r, c3 IS NOT NULL AND c3 <= 0 AS backed, c1 <= 0 AS unseen,
    CASE WHEN c3 > 0 THEN ln(c3 / p2)
      ELSE (CASE WHEN c3 IS NULL THEN 0 ELSE ln(0.4) END) +
        CASE WHEN c2 > 0 THEN ln(c2 / p1)
          ELSE (CASE WHEN c2 IS NULL THEN 0 ELSE ln(0.4) END) + CASE WHEN c1 > 0 THEN ln(c1 / n) ELSE -ln(n + 1.0) END END END AS x
  FROM s)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, round(coalesce(sum(x), 0), 4) AS log_score,
  round(CASE WHEN len(d.ws) > 0 THEN sum(x) / len(d.ws) END, 6) AS mean_log_score,
  CAST(coalesce(sum(CASE WHEN backed THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_backed_off,
  CAST(coalesce(sum(CASE WHEN unseen THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_unseen
FROM d LEFT JOIN l USING (r) GROUP BY d.r, d.doc_id, d.ws
"""
