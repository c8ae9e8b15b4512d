"""Near-duplicate embeddings by range search on a robust-pruned flat graph.

1. Equal vectors are one node with a multiplicity, so copies cost nothing and are never paired off. A node is named by a
   hash of its vector, made anew if two vectors share it; vec_id names rows only.
2. Centroids are fitted on a bounded sample (``sample`` vectors); every node joins its ``overlap`` nearest clusters.
   Their broadcast is bounded by ``max_clusters`` times the dimension. A shard of more than ``shard_limit`` nodes (a dense
   region, or more nodes than so many clusters can divide) is compared exactly, block by block, instead of by graph.
3. Each cluster shard builds a flat graph: nearest candidates of each member, robust pruning (a candidate is dropped if
   a kept one is ``alpha`` times nearer to it than the member is), reverse edges, and links from separate parts to the
   medoid. The adjacency lists of a node's shards are united.
4. Every member searches its shard with the united lists: greedy beam search from medoids, then range expansion (every
   node within range, the member's own among them, is expanded until none is new).
5. Found pairs are verified by cosine >= threshold in double precision. A pair is counted in the first shard that both
   ends share; links leave a shard as counts and a local component's smallest node, never as pairs.
6. Recall is audited against brute force for a bounded sample of nodes against all nodes (``similar_vectors`` reports it
   to a list); below ``min_recall`` the overlap is widened and the search repeated.
7. Where ``attempts`` searches stay below it, the links are found exactly: a node meets each cluster whose cell its range
   can touch (angle to the centroid at most the range plus the cell's radius), clusters being dealt in blocks.

Cases: a vector that is null, empty, zero or holds null or non-finite components, and a row without vec_id, links with
nothing; vectors of different dimensions never link (routing pads them); rows with equal vec_id and vector are copies,
rows with equal vec_id and different vectors are vectors of their own;
ties at the threshold link; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm._common import bounded_sample, delete, new_path, release, tune, written
from pagesieve.operators.components import connected_components


@dataclass(frozen=True)
class EmbeddingParams:
    threshold: float = 0.95
    shard_rows: int = 1500
    overlap: int = 3
    sample: int = 10_000
    max_clusters: int = 8192
    candidates: int = 48
    degree: int = 24
    alpha: float = 1.2
    beam: int = 32
    entries: int = 24
    audit: int = 500
    min_recall: float = 0.98
    attempts: int = 3
    #: members of a shard that is searched by graph
    shard_limit: int = 6000
    #: vectors in one block of the exact search
    block_rows: int = 4000


def unit(rows, dim: int | None = None) -> np.ndarray:
    """Unit vectors in double precision, cut or padded to ``dim`` if it is given."""
    if dim is None:
        m = np.array([np.asarray(r, dtype=np.float64) for r in rows]).reshape(len(rows), -1)
    else:
        m = np.zeros((len(rows), dim))
        for i, r in enumerate(rows):
            k = min(dim, len(r))
            m[i, :k] = np.asarray(r, dtype=np.float64)[:k]
    scale = np.abs(m).max(axis=1, keepdims=True) if m.size else np.ones((len(rows), 1))
    m = m / np.where(scale > 0, scale, 1.0)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1.0)


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), size=min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(sample[a : a + 2000] @ c.T).argmax(axis=1) for a in range(0, len(sample), 2000)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1.0), c)
    return c


def dots(m: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 100_000) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", m[a[i : i + step]], m[b[i : i + step]]) for i in range(0, max(len(a), 1), step)])


def build_graph(m: np.ndarray, p: EmbeddingParams) -> list[np.ndarray]:
    """Neighbours of each row of the unit vectors ``m``: robust-pruned, undirected, one part."""
    n = len(m)
    if n == 1:
        return [np.zeros(0, np.int64)]
    m32, k = m.astype(np.float32), min(p.candidates, n - 1)
    src, dst = [], []
    for a in range(0, n, 256):
        rows = np.arange(a, min(a + 256, n))
        s = m32[rows] @ m32.T
        s[np.arange(len(rows)), rows] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(s, top, axis=1)
        order = np.argsort(-near, axis=1, kind="stable")
        top, near = np.take_along_axis(top, order, axis=1), np.take_along_axis(near, order, axis=1)
        far = np.sqrt(np.maximum(2 - 2 * near, 0))
        vectors, alive = m32[top], np.ones(top.shape, dtype=bool)
        for _ in range(min(p.degree, k)):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = alive.argmax(axis=1)
            src.append(rows[some])
            dst.append(top[some, pick[some]])
            chosen = vectors[np.arange(len(rows)), pick]
            apart = np.sqrt(np.maximum(2 - 2 * np.einsum("ikd,id->ik", vectors, chosen), 0))
            alive &= p.alpha * apart > far
            alive[np.arange(len(rows)), pick] = False
    s, d = np.concatenate(src), np.concatenate(dst)
    s, d = np.concatenate([s, d]), np.concatenate([d, s])
    part = local_components(n, s, d)
    medoid = int((m @ m.mean(axis=0)).argmax())
    for q in np.unique(part):
        if q != part[medoid]:
            members = np.flatnonzero(part == q)
            own = members[(m[members] @ m[members].mean(axis=0)).argmax()]
            s, d = np.append(s, [own, medoid]), np.append(d, [medoid, own])
    pair = np.unique(s * n + d)
    return np.split(pair % n, np.searchsorted(pair // n, np.arange(1, n)))


def local_components(n: int, s: np.ndarray, d: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while len(s):
        low = label.copy()
        np.minimum.at(low, s, label[d])
        np.minimum.at(low, d, label[s])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return label


def medoids(m: np.ndarray, k: int) -> np.ndarray:
    """Entry points: the member nearest to the mean of each of k groups around spread-out members."""
    rng = np.random.default_rng(len(m))
    pivots = m[rng.choice(len(m), size=min(k, len(m)), replace=False)]
    near = (m @ pivots.T).argmax(axis=1)
    return np.unique([g[(m[g] @ m[g].mean(axis=0)).argmax()] for g in (np.flatnonzero(near == i) for i in range(len(pivots))) if len(g)])


def range_search(m: np.ndarray, adjacency: list[np.ndarray], p: EmbeddingParams) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, found) of rows with a cosine of about the threshold or more, each row being a query."""
    n = len(m)
    m32 = m.astype(np.float32)
    degree = np.array([len(x) for x in adjacency])
    flat = np.concatenate([np.zeros(0, np.int64), *adjacency])
    start = np.cumsum(degree) - degree
    seen, within = np.zeros((n, n), dtype=bool), np.zeros((n, n), dtype=bool)
    cut = np.float32(p.threshold - 1e-4)

    def expand(q, node):
        """New (query, node, cosine) next to the given (query, node) pairs."""
        k = degree[node]
        who = np.repeat(q, k)
        to = flat[np.repeat(start[node] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        new = ~seen[who, to]
        pair = np.unique(who[new] * n + to[new])
        who, to = pair // n, pair % n
        seen[who, to] = True
        s = dots(m32, who, to) if len(who) else np.zeros(0, np.float32)
        within[who, to] |= s >= cut
        return who, to, s

    enter = medoids(m, p.entries)
    seen[:, enter] = True
    first = m32 @ m32[enter].T
    within[:, enter] |= first >= cut
    width = p.beam
    ids, sims = np.full((n, width), -1), np.full((n, width), -np.inf, dtype=np.float32)
    k = min(width, len(enter))
    best = np.argsort(-first, axis=1, kind="stable")[:, :k]
    ids[:, :k], sims[:, :k] = enter[best], np.take_along_axis(first, best, axis=1)
    done = ids < 0
    while True:
        active = np.flatnonzero(~done.all(axis=1))
        if not len(active):
            break
        at = np.where(done[active], -np.inf, sims[active]).argmax(axis=1)
        done[active, at] = True
        who, to, s = expand(active, ids[active, at])
        if not len(who):
            continue
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        queries = np.unique(who)
        wide = int(rank.max()) + 1
        row = np.searchsorted(queries, who)
        new_ids, new_sims = np.full((len(queries), wide), -1), np.full((len(queries), wide), -np.inf, dtype=np.float32)
        new_ids[row, rank], new_sims[row, rank] = to, s
        all_ids, all_sims = np.concatenate([ids[queries], new_ids], axis=1), np.concatenate([sims[queries], new_sims], axis=1)
        all_done = np.concatenate([done[queries], new_ids < 0], axis=1)
        top = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
        ids[queries], sims[queries], done[queries] = (np.take_along_axis(x, top, axis=1) for x in (all_ids, all_sims, all_done))
    own = np.arange(n)
    seen[own, own] = within[own, own] = True  # a query is a member: the range also grows from its own node
    todo = np.nonzero(within)
    while len(todo[0]):
        found = []
        for a in range(0, len(todo[0]), 50_000):
            who, to, s = expand(todo[0][a : a + 50_000], todo[1][a : a + 50_000])
            found.append((who[s >= cut], to[s >= cut]))
        todo = tuple(np.concatenate(x) for x in zip(*found))
    within |= within.T
    np.fill_diagonal(within, False)
    return np.nonzero(within)


def by_dimension(pdf):
    """Groups of rows with vectors of one length."""
    sizes = pdf["embedding"].map(len)
    for d in sorted(sizes.unique()):
        yield pdf[sizes == d]


def build_shard(key, pdf, p: EmbeddingParams):
    import pandas as pd

    out = []
    for g in by_dimension(pdf.sort_values("node")):
        ids = g["node"].to_numpy()
        out.append(pd.DataFrame({"node": ids, "near": [ids[x] for x in build_graph(unit(g["embedding"].tolist()), p)]}))
    return pd.concat(out)


def padded(homes) -> np.ndarray:
    """Lists of shards as rows of one array, -1 beyond their ends."""
    width = max(map(len, homes))
    return np.array([list(x) + [-1] * (width - len(x)) for x in homes], dtype=np.int64)


def first_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest shard of each row of ``x`` that the same row of ``y`` has too."""
    shared = ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0)).any(axis=2)
    return np.where(shared, x, np.iinfo(np.int64).max).min(axis=1)


def search_shard(key, pdf, p: EmbeddingParams):
    import pandas as pd

    shard, out = int(key[0]), []
    for g in by_dimension(pdf.sort_values("node")):
        ids, copies = g["node"].to_numpy(), g["copies"].to_numpy()
        m = unit(g["embedding"].tolist())
        adjacency = []
        for near in g["near"]:
            near = np.asarray(near, dtype=np.int64)
            at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
            adjacency.append(at[ids[at] == near])
        a, b = range_search(m, adjacency, p)
        ok = dots(m, a, b) >= p.threshold if len(a) else np.zeros(0, bool)
        a, b = a[ok], b[ok]
        h = padded(g["shards"])
        mine = np.zeros(len(a), dtype=bool)
        for i in range(0, len(a), 100_000):
            mine[i : i + 100_000] = first_common(h[a[i : i + 100_000]], h[b[i : i + 100_000]]) == shard
        links = np.bincount(a[mine], copies[b[mine]], minlength=len(ids)).astype(np.int64)
        root = ids[local_components(len(ids), a, b)]
        out.append(pd.DataFrame({"node": ids, "links": links, "root": root}))
    return pd.concat(out)


def similar_vectors(vectors: DataFrame, params: EmbeddingParams = EmbeddingParams(), audits: list | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding).

    ``audits`` gets the recall that was measured after each search.
    """
    spark, p = tune(vectors.sparkSession), params
    paths, audits = [], [] if audits is None else audits

    def store(df, name):
        paths.append(new_path(spark, f"embed-{name}"))
        return written(df, paths[-1])

    # single-precision vectors travel as they are; all arithmetic is in double precision
    kind = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select("vec_id", F.col("embedding").cast(kind if kind == "array<float>" else "array<double>").alias("embedding"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    for seed in range(0, 100, 2):
        named = rows.where("fine").withColumns({"node": F.xxhash64(F.lit(seed), "embedding"), "check": F.xxhash64(F.lit(seed + 1), "embedding")})
        nodes = store(named.groupBy("node", "check").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), f"nodes{seed}")
        n, names, dim = nodes.agg(F.count("*"), F.count_distinct("node"), F.mode(F.size("embedding"))).first()
        if n == names:
            break
    if n:
        some = bounded_sample(nodes.select("node", "embedding"), p.sample, "node").orderBy("node").collect()
        sample = unit([r["embedding"] for r in some], dim)
        clusters = int(min(p.max_clusters, max(1, -(-n * p.overlap // p.shard_rows))))
        centroids = fit_centroids(sample, clusters).astype(np.float32)
        queries = [(r["node"], r["embedding"]) for r in bounded_sample(nodes.select("node", "embedding"), p.audit, "node").collect()]
        for attempt in range(p.attempts):
            counted = store(search(nodes, centroids, dim, p, store, attempt), f"found{attempt}")
            recall = audit(nodes, counted, queries, p)
            audits.append(recall)
            if recall >= p.min_recall or p.overlap >= len(centroids):
                break
            p = replace(p, overlap=p.overlap * 2)
        if recall < p.min_recall:
            counted = store(exact_search(nodes, centroids, dim, p, store), "exact")
            audits.append(audit(nodes, counted, queries, p))
        links = counted.groupBy("node").agg(F.sum("links").alias("links"))
        parts = connected_components(counted.where("node <> root").select("node", "root").distinct(), lambda df, k: store(df, f"parts{k}"), "node", "root")
        known = nodes.select("node", "least", "copies").join(links, "node", "left").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
        known = store(known.select("node", "least", "part", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "known")
        ids = known.groupBy("part").agg(F.min("least").alias("component_id"))
        linked = named.select("vec_id", "node").join(known.join(ids, "part"), "node").select("vec_id", "n_links", "component_id")
    else:
        linked = named.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = store(linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "result")
    release(spark)
    delete(spark, *paths[:-1])
    return out


def search(nodes: DataFrame, centroids: np.ndarray, dim: int, p: EmbeddingParams, store, attempt: int) -> DataFrame:
    """(node, links, root) of each node in each of its shards."""
    shared = nodes.sparkSession.sparkContext.broadcast(centroids)
    overlap = min(p.overlap, len(centroids))

    def route(batches):
        import pyarrow as pa

        c = shared.value
        for b in batches:
            m = unit(b.column(0).to_pylist(), dim).astype(np.float32)
            near = np.sort(np.argsort(-(m @ c.T), axis=1, kind="stable")[:, :overlap], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(near.tolist(), pa.list_(pa.int32()))], names=["node", "shards"])

    routed = nodes.select("embedding", "node").mapInArrow(route, "node long, shards array<int>")
    members = store(nodes.select("node", "copies", "embedding").join(routed, "node").select("*", F.explode("shards").alias("shard")), f"members{attempt}")
    sizes = members.groupBy("shard").count().collect()  # one row a cluster
    large = {r["shard"]: -(-r["count"] // p.block_rows) for r in sizes if r["count"] > p.shard_limit}
    dense = members.where(F.col("shard").isin(list(large))) if large else None
    members = members.where(~F.col("shard").isin(list(large))) if large else members
    lists = members.select("shard", "node", "embedding").groupBy("shard").applyInPandas(lambda key, pdf: build_shard(key, pdf, p), "node long, near array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # overlap * degree or so
    found = members.join(united, "node").groupBy("shard").applyInPandas(lambda key, pdf: search_shard(key, pdf, p), FOUND)
    if not large:
        return found
    blocks = F.element_at(F.create_map(*[F.lit(x) for pair in large.items() for x in pair]), F.col("shard"))
    dealt = dense.withColumn("blocks", blocks).withColumn("own", F.pmod("node", "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "copies", "embedding", "shards", "shard", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return found.unionByName(dealt.groupBy("i", "j", "shard").applyInPandas(lambda key, pdf: compare_blocks(key, pdf, p), FOUND))


FOUND = "node long, links long, root long"


def exact_search(nodes: DataFrame, centroids: np.ndarray, dim: int, p: EmbeddingParams, store) -> DataFrame:
    """(node, links, root) of all links, each found in the one pair of blocks that its ends are in."""
    spark, c = nodes.sparkSession, unit(centroids)
    odd = len(c)  # the cluster of vectors of another dimension: padding or cutting would change their angles
    shared = spark.sparkContext.broadcast(c)

    def angles(vs, c):
        return np.arccos(np.clip(unit(vs) @ c.T, -1, 1))

    def home(batches):
        import pyarrow as pa

        for b in batches:
            vs = b.column(0).to_pylist()
            cluster, away = np.full(len(vs), odd, np.int32), np.zeros(len(vs))
            at = np.array([i for i, v in enumerate(vs) if len(v) == dim], dtype=np.int64)
            if len(at):
                far = angles([vs[i] for i in at], shared.value)
                cluster[at], away[at] = far.argmin(axis=1), far.min(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(0), pa.array(cluster), pa.array(away)], names=["node", "copies", "embedding", "cluster", "away"])

    homes = store(nodes.select("embedding", "node", "copies").mapInArrow(home, f"node long, copies long, embedding {nodes.schema['embedding'].dataType.simpleString()}, cluster int, away double"), "homes")
    blocks, radius = np.zeros(odd + 1, np.int64), np.zeros(odd + 1)
    for r in homes.groupBy("cluster").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect():  # one row a cluster
        blocks[r["cluster"]], radius[r["cluster"]] = -(-r["n"] // p.block_rows), r["radius"]
    start = np.cumsum(blocks) - blocks
    reach = float(np.arccos(p.threshold)) + 1e-6
    layout = spark.sparkContext.broadcast((blocks, start, radius))

    def meet(batches):
        import pyarrow as pa

        blocks, start, radius = layout.value
        slots = lambda ks: np.concatenate([np.arange(start[k], start[k] + blocks[k]) for k in ks])
        for b in batches:
            cluster, vs = b.column(2).to_numpy(), b.column(1).to_pylist()
            own = start[cluster] + b.column(3).to_numpy() % blocks[cluster]
            to = [slots([odd])] * len(vs)
            at = np.flatnonzero(cluster != odd)
            if len(at):
                near = angles([vs[i] for i in at], shared.value) <= reach + radius[:odd]
                for i, row in zip(at, near):
                    to[i] = slots(np.flatnonzero(row))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.int64()), pa.array([x.tolist() for x in to], pa.list_(pa.int64()))], names=["node", "own", "others"])

    draw = F.xxhash64("node").bitwiseAND((1 << 30) - 1).alias("draw")
    met = homes.select("node", "embedding", "cluster", draw).mapInArrow(meet, "node long, own long, others array<long>")
    met = met.select("node", "own", F.explode("others").alias("other")).select("node", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    dealt = met.join(homes.select("node", "copies", "embedding"), "node")
    return dealt.groupBy("i", "j").applyInPandas(lambda key, pdf: compare_blocks(key, pdf, p), "node long, links long, root long")


def compare_blocks(key, pdf, p: EmbeddingParams):
    """(node, links, root) of the links between block i and block j (the key), for nodes that have any.

    In a shard (the third part of the key) a pair counts only if this is the first shard that both ends share.
    """
    import pandas as pd

    out = [pd.DataFrame({"node": [], "links": [], "root": []}, dtype="int64")]
    for g in by_dimension(pdf.sort_values("node")):
        ids, copies, own = g["node"].to_numpy(), g["copies"].to_numpy(), g["own"].to_numpy()
        m = unit(g["embedding"].tolist())
        homes = padded(g["shards"]) if len(key) > 2 else None
        left, right = np.flatnonzero(own == key[0]), np.flatnonzero(own == key[1])
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for a in range(0, len(left), 128):
            rows = left[a : a + 128]
            x, y = np.nonzero((m[rows] @ m[right].T >= p.threshold) & (rows[:, None] != right[None, :]))
            x, y = rows[x], right[y]
            if homes is not None and len(x):
                mine = first_common(homes[x], homes[y]) == key[2]
                x, y = x[mine], y[mine]
            links += np.bincount(x, copies[y], minlength=len(ids)).astype(np.int64)
            if key[0] != key[1]:
                links += np.bincount(y, copies[x], minlength=len(ids)).astype(np.int64)
            if len(x):  # earlier links are in the labels
                label = local_components(len(ids), np.concatenate([np.arange(len(ids)), x]), np.concatenate([label, y]))
        some = links > 0
        out.append(pd.DataFrame({"node": ids[some], "links": links[some], "root": ids[label][some]}))
    return pd.concat(out)


def audit(nodes: DataFrame, counted: DataFrame, queries: list, p: EmbeddingParams) -> float:
    """Share of the links of ``queries`` (a bounded sample) that were found, against brute force over all nodes."""
    by_dim: dict[int, list] = {}
    for node, v in queries:
        by_dim.setdefault(len(v), []).append((node, v))
    packs = {d: (np.array([q for q, _ in qs]), unit([v for _, v in qs])) for d, qs in by_dim.items()}

    def compare(batches):
        import pyarrow as pa

        for b in batches:
            node, copies, vs = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            total: dict[int, int] = {}
            for d, (ids, q) in packs.items():
                at = np.array([i for i, v in enumerate(vs) if len(v) == d], dtype=np.int64)
                if len(at):
                    hit = (q @ unit([vs[i] for i in at]).T >= p.threshold) & (ids[:, None] != node[at][None, :])
                    for i, x in zip(ids, hit @ copies[at]):
                        total[int(i)] = total.get(int(i), 0) + int(x)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["node", "truth"])

    truth = nodes.select("node", "copies", "embedding").mapInArrow(compare, "node long, truth long").groupBy("node").agg(F.sum("truth").alias("truth"))
    found = counted.groupBy("node").agg(F.sum("links").alias("links"))
    t, f = truth.join(found, "node", "left").agg(F.sum("truth"), F.sum(F.least("truth", F.coalesce("links", F.lit(0))))).first()
    return 1.0 if not t else f / t


def op6_embedding_dedup(spark, sf_dir):
    return similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links,
       (SELECT min(r.b) FROM r WHERE r.a = v.vec_id) AS component_id,
       v.vec_id = (SELECT min(r.b) FROM r WHERE r.a = v.vec_id) AS kept
FROM v
"""
