"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF word shingles.

1. Texts become blocks of word codes (``_blocks``). Shingles are five consecutive words (letters and digits, lower
   case); a text of one to four words is one shingle.
2. Document frequencies of all shingles of the corpus come from hash buckets and go back to the blocks. Weights are
   ``tf * (1 + idf_share * ln(N / df) / ln N)``.
3. Every document gets ``bands * rows`` samples by improved consistent weighted sampling (Ioffe 2010): two documents
   share a sample with the probability of their weighted Jaccard similarity. Samples are hashed into bands.
4. Documents with equal shingle counts are one node (similarity 1), however many they are.
5. Nodes that share a band are candidates of the band's leaders (its smallest and its largest node): leaders are
   aggregated, then joined back, so a band that a third of all documents share is a join whose hot side Spark splits,
   and candidates grow with the nodes, not with the square of a group.
6. Candidates are verified by exact weighted Jaccard similarity >= 0.8. Where a band still holds several components,
   further rounds compare one representative of each with other leaders, drawn by a hash. They only save work.
7. Where a band then still holds several components, every pair of its nodes from different components is settled: dealt
   in blocks against blocks, pairs without a common shingle in their rarest ones (prefix filter, which loses no pair of
   the threshold) or of too different weight are out, all others are verified.
8. Components of the verified links are the classes; a class is named by its smallest doc_id.

Written tables (blocks, frequencies, signatures, vectors, pairs) are in the shared folder, and shuffle files of finished
steps are released. Nothing of the corpus reaches the driver but counts.

Cases: a null or empty text, or one without a word, is nobody's duplicate and a class of its own; a null doc_id has the
class null and links nothing; rows with equal doc_id are one node; an empty table gives an empty result; extra columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm._blocks import U64, Block, BlockParams, corpus_counts, make_blocks, mix, packed, totals_of, unpacked
from pagesieve.llm._common import delete, new_path, release, small_steps, tune, written
from pagesieve.operators.components import connected_components


@dataclass(frozen=True)
class NearDedupParams:
    words: int = 5
    threshold: float = 0.8
    bands: int = 10
    rows: int = 3
    #: rounds of candidates after the first
    more_rounds: int = 2
    #: nodes (or so many times 4 KB of vectors) in one block of the last, complete step
    block_nodes: int = 1000
    #: weight of the idf; with a full idf the few shingles that an edit makes outweigh the many that copies share
    idf_share: float = 0.25
    seed: int = 1
    blocks: BlockParams = BlockParams()


def shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count), distinct and ordered by document, then hash."""
    doc, words = block.doc, mix(block.words, 1)[block.codes] if len(block.codes) else np.zeros(0, U64)
    n = len(words)
    lengths = np.diff(np.append(0, block.ends))
    left = np.repeat(block.ends, lengths) - np.arange(n)  # words from here to the document's end
    whole = np.flatnonzero(left >= k)
    h = np.full(len(whole), U64(k))
    for i in range(k):
        h = mix(h, words[whole + i])
    docs, keys = [doc[whole]], [h]
    for size in range(1, k):
        first = block.ends[lengths == size] - size
        h = np.full(len(first), U64(size))
        for i in range(size):
            h = mix(h, words[first + i])
        docs.append(np.flatnonzero(lengths == size))
        keys.append(h)
    d, key = np.concatenate(docs), np.concatenate(keys)
    order = np.lexsort((key, d))
    d, key = d[order], key[order]
    if not len(d):
        return d, key, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (key[1:] != key[:-1])]))
    return d[first], key[first], np.diff(np.append(first, len(d)))


def weights(tf: np.ndarray, df: np.ndarray, n_docs: int, share: float) -> np.ndarray:
    """TF-IDF with a damped idf: from 1 for a shingle of all documents to 1 + share for one of a single document."""
    return tf * (1.0 + share * np.log(np.maximum(n_docs, 1) / df) / max(np.log(max(n_docs, 1)), 1e-9))


def icws(doc_start: np.ndarray, key: np.ndarray, weight: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """(documents, samples) of 64-bit sample names; ``doc_start`` has where each document's shingles begin (none empty)."""
    n_docs = len(doc_start)
    out = np.zeros((n_docs, samples), dtype=U64)
    ends = np.append(doc_start[1:], len(key))
    log_w = np.log(weight).astype(np.float32)
    scale, low = np.float32(2.0**-21), U64((1 << 21) - 1)
    at = 0
    with np.errstate(over="ignore"):
        while at < n_docs:  # some documents at once, so that the arrays stay in the processor's cache
            stop = max(at + 1, int(np.searchsorted(ends, doc_start[at] + 16_384, side="right")))
            a, b = int(doc_start[at]), int(ends[stop - 1])
            k, lw, starts = key[a:b], log_w[a:b], doc_start[at:stop] - a
            sizes = ends[at:stop] - doc_start[at:stop]
            of = np.repeat(np.arange(stop - at), sizes)
            for j in range(samples):
                x = (k ^ U64(0x9E3779B97F4A7C15 * (2 * (j + samples * seed) + 1) & 0xFFFFFFFFFFFFFFFF)) * U64(0xBF58476D1CE4E5B9)
                x ^= x >> U64(31)
                x *= U64(0x94D049BB133111EB)
                y = x ^ (x >> U64(32))
                y *= U64(0xD6E8FEB86659FD93)
                u = lambda v, s: ((v >> U64(s)) & low).astype(np.float32) * scale + np.float32(2.0**-22)
                r = -np.log(u(x, 1) * u(x, 22))
                beta = u(x, 43)
                t = np.floor(lw / r + beta)
                log_a = np.log(-np.log(u(y, 1) * u(y, 22))) - r * (t - beta) - r
                least = np.minimum.reduceat(log_a, starts)
                hit = np.flatnonzero(log_a == least[of])
                first = hit[np.concatenate([[True], of[hit][1:] != of[hit][:-1]])]
                out[at:stop, j] = k[first] ^ (t[first].astype(np.int64).astype(U64) * U64(0x9E3779B97F4A7C15))
            at = stop
    return out


SIGNATURES = "doc_id long, block long, place int, c1 long, c2 long, bands array<long>"


def signatures(blocks: DataFrame, answers: DataFrame, n_docs: int, p: NearDedupParams) -> DataFrame:
    """One row per document of the blocks: its place, a name of its shingle counts (null without words), its bands."""

    def sign(key, left, right):
        import pandas as pd

        out = []
        for _, row in left.iterrows():
            block = Block.of(row)
            n = len(block.ends)
            d, k, tf = shingles(block, p.words)
            frame = {"doc_id": pd.array(block.doc_ids, dtype="Int64"), "block": np.full(n, block.block), "place": np.arange(n, dtype=np.int32), "c1": pd.array(np.zeros(n, np.int64), dtype="Int64"), "c2": pd.array(np.zeros(n, np.int64), dtype="Int64"), "bands": [None] * n}
            frame["doc_id"][block.no_id] = pd.NA
            if len(d):
                distinct, inv = np.unique(k, return_inverse=True)
                w = weights(tf, totals_of(distinct, right)[inv], n_docs, p.idf_share)
                start = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                s = icws(start, k, w, p.bands * p.rows, p.seed)
                bands = np.zeros((len(start), p.bands), dtype=U64)
                for i in range(p.rows):
                    bands = mix(bands, s[:, i :: p.rows])
                h1, h2 = mix(k, tf), mix(k, tf + 1_000_003)
                have = d[start]
                for name, h in (("c1", h1), ("c2", h2)):
                    frame[name][have] = np.add.reduceat(h, start).astype(np.int64)
                for i, b in zip(have, bands.astype(np.int64)):
                    frame["bands"][i] = b
                none = np.setdiff1d(np.arange(n), have)
            else:
                none = np.arange(n)
            frame["c1"][none] = pd.NA
            frame["c2"][none] = pd.NA
            out.append(pd.DataFrame(frame))
        return pd.concat(out) if out else pd.DataFrame(columns=[x.split()[0] for x in SIGNATURES.split(", ")])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(sign, SIGNATURES)


def vectors(blocks: DataFrame, answers: DataFrame, wanted: DataFrame, n_docs: int, p: NearDedupParams) -> DataFrame:
    """(node, bands, vec, size) of the documents in ``wanted`` (node, block, place, bands): packed shingles, counts and frequencies."""
    places = wanted.groupBy("block").agg(F.collect_list(F.struct("node", "place", "bands")).alias("want"))  # bounded by the block
    asked = blocks.join(places, "block")

    def pick(key, left, right):
        import pandas as pd

        nodes, bands, vecs = [], [], []
        for _, row in left.iterrows():
            block = Block.of(row)
            d, k, tf = shingles(block, p.words)
            distinct, inv = np.unique(k, return_inverse=True)
            df = totals_of(distinct, right)[inv]
            at = np.searchsorted(d, np.arange(len(block.ends) + 1))
            for w in row["want"]:
                a, b = at[w["place"]], at[w["place"] + 1]
                nodes.append(w["node"])
                bands.append(w["bands"])
                vecs.append(vector_bytes(k[a:b], tf[a:b], df[a:b]))
        return pd.DataFrame({"node": nodes, "bands": pd.Series(bands, dtype=object), "vec": pd.Series(vecs, dtype=object), "size": [len(x) for x in vecs]})

    return asked.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(pick, "node long, bands array<long>, vec binary, size int")


def vector_bytes(key: np.ndarray, tf: np.ndarray, df: np.ndarray) -> bytes:
    parts = [packed(np.diff(key, prepend=U64(0)), "<u8"), packed(tf, "<u4"), packed(df, "<u8")]
    return np.array([len(x) for x in parts], dtype="<u4").tobytes() + b"".join(parts)


def parts_of(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.frombuffer(b[:12], "<u4")
    at = 12 + np.append(0, np.cumsum(n.astype(np.int64)))
    key, tf, df = (unpacked(b[at[i] : at[i + 1]], kind) for i, kind in enumerate(("<u8", "<u4", "<u8")))
    return np.cumsum(key, dtype=U64), tf, df


def vector_of(b: bytes, n_docs: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    key, tf, df = parts_of(b)
    return key, weights(tf, df, n_docs, share)


def weighted_jaccard(a: tuple, b: tuple) -> float:
    (ka, wa), (kb, wb) = a, b
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both, low = wa.sum() + wb.sum(), np.minimum(wa[ia], wb[ib]).sum()
    return float(low / (both - low)) if both > low else 1.0


def verify(pairs: DataFrame, vecs: DataFrame, n_docs: int, p: NearDedupParams) -> DataFrame:
    """Those of ``pairs`` (a, b) whose similarity reaches the threshold: (a, b, similarity)."""
    both = pairs.join(vecs.select(F.col("node").alias("b"), F.col("vec").alias("vb")), "b").join(vecs.select(F.col("node").alias("a"), F.col("vec").alias("va")), "a")

    def compare(batches):
        import pyarrow as pa

        for b in small_steps(batches, ["va", "vb"]):
            a_ids, b_ids, va, vb = (c.to_pylist() for c in b.columns)
            known, out = {}, []
            for i, x, y in zip(a_ids, va, vb):
                if i not in known:
                    known = {i: vector_of(x, n_docs, p.idf_share)}
                out.append(weighted_jaccard(known[i], vector_of(y, n_docs, p.idf_share)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return both.select("a", "b", "va", "vb").mapInArrow(compare, "a long, b long, similarity double").where(F.col("similarity") >= p.threshold)


def rarest(key: np.ndarray, weight: np.ndarray, df: np.ndarray, threshold: float) -> np.ndarray:
    """The rarest shingles, without which less than ``threshold`` of the weight is left: similar vectors share one of them."""
    order = np.lexsort((key, df))
    left = np.cumsum(weight[order][::-1])[::-1]
    return key[order[left >= threshold * left[0] * (1 - 1e-9)]]


def block_links(key, pdf, n_docs: int, p: NearDedupParams):
    """Links (a, b) between the rows of slot i and those of slot j of one band bucket, for pairs of different components.

    A pair is settled in the first band that both share. Pairs that links found here already connect are not compared.
    """
    import pandas as pd

    band, i, j = int(key[0]), int(key[2]), int(key[3])
    pdf = pdf.sort_values("node")
    node, bands = pdf["node"].to_numpy(), np.array(pdf["bands"].tolist(), dtype=np.int64)
    label = np.unique(pdf["component"], return_inverse=True)[1]
    vecs, prefixes = [], []
    for b in pdf["vec"]:
        k, tf, df = parts_of(b)
        w = weights(tf, df, n_docs, p.idf_share)
        vecs.append((k, w))
        prefixes.append(rarest(k, w, df, p.threshold))
    total = np.array([w.sum() for _, w in vecs])
    left, right = (np.flatnonzero(pdf["slot"].to_numpy() == x) for x in (i, j))
    found = []
    if len(left) and len(right):
        keys, of = np.concatenate([prefixes[x] for x in right]), np.repeat(right, [len(prefixes[x]) for x in right])
        order = np.argsort(keys, kind="stable")
        keys, of = keys[order], of[order]
        for a in left:
            lo, hi = np.searchsorted(keys, prefixes[a], "left"), np.searchsorted(keys, prefixes[a], "right")
            other, common = np.unique(np.concatenate([of[x:y] for x, y in zip(lo, hi)]), return_counts=True)
            ok = (label[other] != label[a]) & (np.minimum(total[other], total[a]) >= p.threshold * np.maximum(total[other], total[a]) * (1 - 1e-9)) & ((other > a) | (i != j))
            other, common = other[ok], common[ok]
            first = (bands[other] == bands[a]).argmax(axis=1) == band
            for b in other[first][np.argsort(-common[first], kind="stable")]:
                if label[a] != label[b] and weighted_jaccard(vecs[a], vecs[b]) >= p.threshold:
                    found.append((min(node[a], node[b]), max(node[a], node[b])))
                    label[label == label[b]] = label[a]
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def remaining(there: DataFrame, vecs: DataFrame, n_docs: int, p: NearDedupParams) -> DataFrame:
    """All links (a, b) that are missing between components of a band bucket; ``there`` has node, band, h, component.

    The largest component of a bucket is dealt in blocks only against blocks of the others, never against itself.
    """
    sized = there.join(vecs.select("node", (1 + F.col("size") / 4096).alias("size")), "node")
    per = sized.groupBy("band", "h", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    slots = lambda c: F.ceil(c / p.block_nodes).cast("int")
    most = F.max(F.struct("size", "component"))
    # of three nodes or fewer each pair has had the smallest or the largest in it
    open_ = per.groupBy("band", "h").agg(most.alias("most"), F.sum("size").alias("all"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1 AND n > 3")
    open_ = open_.select("band", "h", F.col("most.component").alias("big"), slots(F.col("all") - F.col("most.size")).alias("few"), slots(F.col("most.size")).alias("many"))
    rows = there.join(open_, ["band", "h"])
    draw = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), F.col(n)).cast("int")
    rows = rows.withColumn("slot", F.when(F.col("component") == F.col("big"), F.col("few") + draw("many")).otherwise(draw("few")))
    others = F.when(F.col("slot") < F.col("few"), F.sequence(F.lit(0), F.col("few") + F.col("many") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") - 1))
    rows = rows.select("band", "h", "node", "component", "slot", F.explode(others).alias("other"))
    rows = rows.select("band", "h", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "node", "component", "slot")
    dealt = rows.join(vecs.drop("size"), "node")
    return dealt.groupBy("band", "h", "i", "j").applyInPandas(lambda key, pdf: block_links(key, pdf, n_docs, p), "a long, b long")


def near_duplicates(docs: DataFrame, params: NearDedupParams = NearDedupParams()) -> DataFrame:
    """(doc_id, class_id) of every row of ``docs`` (doc_id, text); class_id is the smallest doc_id of its class."""
    spark, p = tune(docs.sparkSession), params
    paths = []

    def store(df, name):
        paths.append(new_path(spark, f"near-{name}"))
        return written(df, paths[-1])

    blocks, path = make_blocks(docs, "near-blocks", p.blocks, letters_and_digits=True)
    paths.append(path)
    n_docs, n_words = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()

    def derive(row):
        _, k, _ = shingles(Block.of(row), p.words)
        return np.unique(k, return_counts=True)

    answers = store(corpus_counts(blocks, derive, n_words, store, p.blocks), "answers")
    release(spark)
    signed = store(signatures(blocks, answers, n_docs, p), "signatures")
    release(spark)
    # one node for all documents with equal shingle counts
    alike = signed.where("doc_id IS NOT NULL AND c1 IS NOT NULL").groupBy("c1", "c2").agg(F.min("doc_id").alias("node"), F.min(F.struct("doc_id", "block", "place", "bands")).alias("m"))
    nodes = store(alike.select("c1", "c2", "node", "m.block", "m.place", "m.bands"), "nodes")
    banded = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    leaders = banded.groupBy("band", "h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    shared = store(banded.join(leaders, ["band", "h"]), "shared")
    wanted = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "block", "place", "bands")
    vecs = store(vectors(blocks, answers, wanted, n_docs, p), "vectors")
    release(spark)
    star = shared.select(F.least("node", "lo").alias("a"), F.greatest("node", "lo").alias("b")).union(shared.select(F.least("node", "hi"), F.greatest("node", "hi"))).where("a <> b").distinct()
    links = store(verify(star, vecs, n_docs, p), "links")
    same_id = signed.where("doc_id IS NOT NULL AND c1 IS NOT NULL").select("doc_id", "c1", "c2").join(nodes.select("c1", "c2", "node"), ["c1", "c2"])
    same_id = store(same_id.select("doc_id", "node"), "members")
    for k in range(p.more_rounds):
        there = with_components(shared, components(store, links, f"r{k}"))
        reps = there.groupBy("band", "h", "component").agg(F.min_by("node", F.xxhash64("node", F.lit(k))).alias("node"))
        drawn = reps.groupBy("band", "h").agg(F.min_by("node", F.xxhash64("node", F.lit(1000 + k))).alias("lead"), F.count("*").alias("n")).where("n > 1")
        pairs = reps.join(drawn, ["band", "h"]).where("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
        more = store(verify(pairs.join(star, ["a", "b"], "left_anti"), vecs, n_docs, p), f"links{k}")
        release(spark)
        if not more.limit(1).count():
            break
        links = links.unionByName(more)
    else:
        there = with_components(shared, components(store, links, "all"))
    there = store(there, "open")
    links = links.select("a", "b").unionByName(store(remaining(there, vecs, n_docs, p), "rest"))
    release(spark)
    # documents of equal content hang on their node; rows with equal doc_id hang together
    edges = links.select("a", "b").unionByName(same_id.select(F.least("doc_id", "node").alias("a"), F.greatest("doc_id", "node").alias("b")).where("a <> b").distinct())
    final = store(components(store, edges, "end"), "classes")
    got = signed.select("doc_id").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    out = store(got.select("doc_id", F.coalesce("component", "doc_id").alias("class_id")), "result")
    release(spark)
    delete(spark, *paths[:-1])
    return out


def with_components(shared: DataFrame, label: DataFrame) -> DataFrame:
    return shared.select("node", "band", "h").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))


def components(store, links: DataFrame, name: str) -> DataFrame:
    """(node, component) of the nodes in ``links`` (a, b), a < b.

    A forest of one link a node is contracted first; of the other links those between its trees are left.
    """
    settle = lambda e, step: connected_components(e, lambda df, k: store(df, f"components-{name}-{step}-{k}"), "a", "b")
    trees = settle(links.groupBy("b").agg(F.min("a").alias("a")), "forest")
    of = lambda end: trees.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    between = links.select("a", "b").join(of("a"), "a").join(of("b"), "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    between = store(between, f"between-{name}")
    if not between.limit(1).count():
        return trees
    roots = settle(between, "trees").withColumnRenamed("component", "root")
    return trees.join(roots.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))


def op10_near_duplicates(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
