"""Vector operators: exact search, upserts, centroid gates, text embedding, layout and density clusters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesieve.operators.components import connected_components
from pagesieve.storage import stored

#: Queries of one pass; more are searched in as many passes as it takes.
QUERY_BLOCK = 20_000
#: Queries and vectors that are compared at once: a block of distances has at most their product in cells (4 MB), however many rows there are.
QUERY_STEP, VECTOR_STEP = 512, 1024
#: Pairs whose values are computed from the vectors themselves at once.
EXACT_STEP = 8192


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def knn(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, vec_id, value, rank): the k nearest of each query by squared L2 (ascending) or cosine (descending).

    ``vectors`` and ``queries`` have vec_id and embedding. Queries travel in blocks of a bounded size; every partition
    of the vectors keeps the k best of each query, so what is shuffled is queries times k for each partition. Vectors
    are compared in blocks too, so a worker's memory depends neither on the number of queries nor on that of vectors.
    Of equal distances (cosines: equal to twelve places) the smallest ids are nearest.
    """
    n = queries.count()
    passes = max(1, -(-n // block))
    out = None
    for i in range(passes):
        part = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i)
        rows = part.where("embedding IS NOT NULL").select("vec_id", "embedding").collect()
        ids, q = np.array([r["vec_id"] for r in rows], dtype=np.int64), np.array([r["embedding"] for r in rows], dtype=np.float64) if rows else np.zeros((0, 0))
        got = _pass(vectors, ids, q, k, metric)
        out = got if out is None else out.unionByName(got)
    order = F.col("value").asc() if metric == "l2" else F.round("value", 12).desc()
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "vec_id")))
    return ranked.where(F.col("rank") <= k)


def _moderate(norms: np.ndarray) -> bool:
    """Whether vectors of these squared lengths can be compared in single precision without overflow or loss."""
    return bool(((norms > 1e-30) & (norms < 1e30)).all())


class Nearest:
    """The k best of each query among the vectors seen so far, by key (small is near) and id."""

    def __init__(self, q: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric = q, k, metric
        self.norm = np.einsum("ij,ij->i", q, q)
        self.key, self.value = np.full((len(q), k), np.inf), np.zeros((len(q), k))
        self.id, self.held = np.zeros((len(q), k), dtype=np.int64), np.zeros(len(q), dtype=np.int64)

    def see(self, v: np.ndarray, vid: np.ndarray) -> None:
        for at in range(0, len(v), VECTOR_STEP):
            block, ids = v[at : at + VECTOR_STEP], vid[at : at + VECTOR_STEP]
            norm = np.einsum("ij,ij->i", block, block)
            side = None
            if _moderate(norm):
                side = (block * -2 if self.metric == "l2" else -block / np.sqrt(norm)[:, None]).astype(np.float32)
            for a in range(0, len(self.q), QUERY_STEP):
                rows = slice(a, min(a + QUERY_STEP, len(self.q)))
                hit = None if side is None else self._coarse(rows, norm, side)
                if hit is None or np.count_nonzero(hit) > 4 * self.k * len(hit):
                    hit = self._fine(rows, block, norm)
                self._put(rows, block, norm, ids, hit)

    def _coarse(self, rows: slice, vn: np.ndarray, side: np.ndarray) -> np.ndarray | None:
        """What single precision, with all its error allowed for, can't rule out; for queries that hold k already."""
        q, qn, cut = self.q[rows], self.norm[rows], self.key[rows, -1]
        if not (self.held[rows] == self.k).all() or not _moderate(qn):
            return None
        error = (q.shape[1] + 16) * 2.0**-23  # of a product, twice what rounding can make, as a share of both squared lengths
        if self.metric == "l2":
            near = q.astype(np.float32) @ side.T
            near += vn.astype(np.float32)
            cut = cut - qn + 1e-9 + error * (qn + vn.max())
        else:
            near = (q / np.sqrt(qn)[:, None]).astype(np.float32) @ side.T
            cut = cut + 1e-9 + 2 * error
        with np.errstate(over="ignore"):
            return near <= cut.astype(np.float32)[:, None]

    def _fine(self, rows: slice, v: np.ndarray, vn: np.ndarray) -> np.ndarray:
        near, qn = self.q[rows] @ v.T, self.norm[rows, None]
        if self.metric == "l2":
            near *= -2
            near += qn
            near += vn
            near[np.isnan(near)] = np.inf
            slack = 1e-9 + 1e-12 * (qn[:, 0] + np.nanmax(vn, initial=0.0))
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                near /= np.sqrt(qn)
                near /= np.sqrt(vn)
            near = np.negative(np.nan_to_num(near, copy=False, nan=-1.0), out=near)
            slack = 1e-9
        # all that may be among the k best or tie with the last of them are looked at exactly
        full = self.held[rows] == self.k
        cut = np.where(full, self.key[rows, -1], np.inf) + slack
        hit = near <= cut[:, None]
        if np.count_nonzero(hit) > 4 * self.k * len(near):
            m = min(self.k, near.shape[1])
            cut = np.minimum(cut, np.partition(near, m - 1, axis=1)[:, m - 1] + slack)
            hit = near <= cut[:, None]
        return hit

    def _put(self, rows: slice, v: np.ndarray, vn: np.ndarray, vid: np.ndarray, hit: np.ndarray) -> None:
        some, qn = np.flatnonzero(hit.any(axis=1)), self.norm[rows, None]
        i, j = np.nonzero(hit[some])
        i = some[i]
        if not len(i):
            return
        value = np.empty(len(i))
        for at in range(0, len(i), EXACT_STEP):
            part = slice(at, at + EXACT_STEP)
            x, y = self.q[rows][i[part]], v[j[part]]
            if self.metric == "l2":
                value[part] = np.einsum("ij,ij->i", x - y, x - y)
            else:
                with np.errstate(divide="ignore", invalid="ignore"):
                    value[part] = np.nan_to_num(np.einsum("ij,ij->i", x, y) / (np.sqrt(qn[i[part], 0]) * np.sqrt(vn[j[part]])), nan=-1.0)
        # the held ones of the queries that were hit stand in line with the new ones
        mine = np.unique(i)
        o, c = np.nonzero(np.arange(self.k) < self.held[rows][mine, None])
        o, r = mine[o], rows.start + mine[o]
        i = np.concatenate([o, i])
        ids, value = np.concatenate([self.id[r, c], vid[j]]), np.concatenate([self.value[r, c], value])
        key = value if self.metric == "l2" else -np.round(value, 12)
        order = np.lexsort((ids, key, i))
        i, ids, key, value = i[order], ids[order], key[order], value[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        best = place < self.k
        r, c = rows.start + i[best], place[best]
        self.key[r, c], self.value[r, c], self.id[r, c] = key[best], value[best], ids[best]
        self.held[rows.start + mine] = np.minimum(np.bincount(i, minlength=rows.stop - rows.start)[mine], self.k)


def _pass(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, metric: str) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def search(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, q = shared.value
        if not len(q):
            return
        near, last = Nearest(q, k, metric), np.iinfo(np.int64).max  # a null id comes after all others
        for b in batches:
            e, vid = b.column("embedding"), pc.fill_null(b.column("vec_id"), int(last))
            fits = pc.fill_null(pc.equal(pc.list_value_length(e), q.shape[1]), False)
            e, vid = e.filter(fits), vid.filter(fits).to_numpy(zero_copy_only=False)
            if len(vid):
                near.see(e.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vid), -1), vid)
        for a in range(0, len(q), 10_000):
            r, c = np.nonzero(np.arange(k) < near.held[a : a + 10_000, None])
            r += a
            found = near.id[r, c]
            yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(found, mask=found == last), pa.array(near.value[r, c])], ["query_id", "vec_id", "value"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(search, "query_id long, vec_id long, value double")


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """Store with ``new`` (vec_id or null, embedding) in it: the new vector wins; null ids continue after the largest.

    Vectors of another length than the store's are an error.
    """
    top, size = store.agg(F.coalesce(F.max("vec_id"), F.lit(-1)), F.max(F.size("embedding"))).first()
    given = new.where("vec_id IS NOT NULL")
    top = max(top, given.agg(F.coalesce(F.max("vec_id"), F.lit(-1))).first()[0])
    # new ids are one sequence in the order of a hash: numbered within ranges of it, from where the range before ends
    ranged = new.where("vec_id IS NULL").select("embedding", F.xxhash64("embedding").alias("h")).repartitionByRange("h").withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "new-vectors")
    sizes = sorted((r["part"], r["count"]) for r in ranged.groupBy("part").count().collect())  # one row a range
    start, first = {}, top
    for part, count in sizes:
        start[part], first = first, first + count
    base = F.element_at(F.create_map(*[F.lit(x) for pair in start.items() for x in pair]), F.col("part")) if start else F.lit(top)
    fresh = ranged.select((F.row_number().over(Window.partitionBy("part").orderBy("h")) + base).cast("long").alias("vec_id"), "embedding")
    added = given.select("vec_id", "embedding").unionByName(fresh)
    if size:
        added = added.withColumn("embedding", F.when(F.size("embedding") == size, F.col("embedding")).otherwise(F.raise_error(F.lit(f"a vector must have {size} components")).cast(added.schema["embedding"].dataType)))
    return store.select("vec_id", "embedding").join(added.select("vec_id"), "vec_id", "left_anti").unionByName(added)


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Mean vector of each label, by position."""
    each = vectors.where("embedding IS NOT NULL").select(label, F.posexplode("embedding").alias("i", "x"))
    mean = each.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def centroid_gate(vectors: DataFrame, odd: list[list[float]], boring: list[list[float]], odd_cut: float = 0.55, boring_cut: float = 0.70) -> DataFrame:
    """Append odd_score, boring_score and gate: pass, boring_embedding or open. Centroids are settings, given as literals."""
    most = lambda rows: F.greatest(*[dot(F.col("embedding"), F.lit([float(x) for x in r])) for r in rows], F.lit(float("-inf"))) if rows else F.lit(None).cast("double")
    v = vectors.withColumns({"odd_score": most(odd), "boring_score": most(boring)})
    return v.withColumn("gate", F.when(F.col("odd_score") >= odd_cut, "pass").when(F.col("boring_score") >= boring_cut, "boring_embedding").otherwise("open"))


def hashing_encoder(dim: int = 64) -> Callable:
    """A text encoder that needs no model: signed hashed word counts, of unit length. Any pandas UDF of text may take its place."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(texts):
        import zlib

        import pandas as pd

        out = np.zeros((len(texts), dim), dtype=np.float32)
        for v, t in zip(out, texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h & 0x80000000 else -1.0
            n = float(np.linalg.norm(v))
            if n:
                v /= n
        return pd.Series(list(out))

    return encode


def search_texts(texts: DataFrame, queries: DataFrame, k: int, encoder: Callable | None = None) -> DataFrame:
    """kNN of query texts (vec_id, text) among texts (vec_id, text) by cosine."""
    enc = encoder or hashing_encoder()
    embed = lambda df: df.select("vec_id", enc(F.col("text")).alias("embedding"))
    return knn(embed(texts), embed(queries), k, "cosine")


def layout(vectors: DataFrame, k: int = 2) -> DataFrame:
    """(vec_id, x, y, ...) by principal components; stands in for a neighbour-graph layout, which it isn't equal to."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.where("embedding IS NOT NULL").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    got = PCA(k=k, inputCol="v", outputCol="p").fit(v).transform(v).select("vec_id", vector_to_array("p").alias("p"))
    names = ["x", "y", "z"] + [f"c{i}" for i in range(3, k)]
    return got.select("vec_id", *[F.col("p")[i].alias(names[i]) for i in range(k)])


def density_clusters(vectors: DataFrame, keep: Callable, min_size: int = 5, reach: float | None = None) -> DataFrame:
    """(vec_id, cluster): parts of the mutual-reachability graph of nearest neighbours; small parts are noise (-1).

    Every vector is a query of the blocked search. An edge's length is the larger of its distance and both ends' core
    distances; edges longer than ``reach`` (by default mean plus one deviation of the core distances) are cut.
    """
    near = keep(knn(vectors, vectors, min_size + 1, "l2").where("query_id <> vec_id").select("query_id", "vec_id", F.sqrt("value").alias("d")), -10)
    core = near.groupBy("query_id").agg(F.max("d").alias("core"))
    if reach is None:
        m, s = core.agg(F.avg("core"), F.coalesce(F.stddev_pop("core"), F.lit(0.0))).first()
        reach = (m or 0.0) + (s or 0.0)
    e = near.join(core, "query_id").join(core.select(F.col("query_id").alias("vec_id"), F.col("core").alias("other")), "vec_id")
    edges = e.where(F.greatest("d", "core", "other") <= reach).select(F.col("query_id").alias("src"), F.col("vec_id").alias("dst"))
    parts = connected_components(edges, keep)
    size = parts.groupBy("component").agg(F.count("*").alias("n"))
    named = parts.join(size, "component").select(F.col("node").alias("vec_id"), F.when(F.col("n") >= min_size, F.col("component")).alias("cluster"))
    return vectors.select("vec_id").join(named, "vec_id", "left").select("vec_id", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


def cluster_table(points: DataFrame, clusters: DataFrame, metadata: DataFrame) -> DataFrame:
    """id, x, y, cluster and the metadata's columns in alphabetical order."""
    extra = sorted(c for c in metadata.columns if c != "vec_id")
    return points.join(clusters, "vec_id").join(metadata, "vec_id", "left").select(F.col("vec_id").alias("id"), "x", "y", "cluster", *extra)
