"""Queries of vector and topic operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesieve.functions.fingerprints import BloomFilter
from pagesieve.operators import topics as tp
from pagesieve.operators import vectors as ve
from pagesieve.plans.pages import table
from pagesieve.storage import keeper

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


def searched(spark, d, metric):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    got = ve.knn(v, v.where("vec_id % 100 = 0"), 5, metric)
    return got.select("query_id", "vec_id", F.round("value", 6).alias("value"), "rank")


KNN = "WITH {v}, d AS (SELECT q.vec_id AS query_id, v.vec_id, {f} AS x FROM v q JOIN v ON q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {o}, vec_id) AS k FROM d) SELECT query_id, vec_id, round(x, 6) AS value, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 5"


@query("knn_l2", KNN.format(v=V, f="list_sum(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))", o="x"))
def knn_l2(spark, d):
    """The five nearest of every hundredth vector, among all."""
    return searched(spark, d, "l2").withColumn("value", F.round(F.col("value") + 0.0, 6))


@query("knn_cosine", KNN.format(v=V, f="list_cosine_similarity(q.e, v.e)", o="round(x, 12) DESC"))
def knn_cosine(spark, d):
    return searched(spark, d, "cosine")


@query("vector_scan", f"WITH {V} SELECT vec_id, CAST(len(e) AS INTEGER) AS dim, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 5) AS norm FROM v")
def vector_scan(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.size(e).alias("dim"), F.round(F.sqrt(ve.dot(e, e)), 5).alias("norm"))


@query("centroids", f"WITH {V}, x AS (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS i FROM v) SELECT label, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS m FROM x GROUP BY 1, 2")
def centroids(spark, d):
    c = ve.centroids(table(spark, d, "embeddings"))
    return c.select("label", F.posexplode("centroid").alias("i", "m")).withColumn("m", F.round("m", 6))


GATE = ([[1.0] + [0.0] * 63, [0.0] * 8 + [1.0] + [0.0] * 55], [[0.0, 1.0] + [0.0] * 62])


@query("centroid_gate", f"WITH {V} SELECT vec_id, CASE WHEN greatest(e[1], e[9]) >= 0.2 THEN 'pass' WHEN e[2] >= 0.1 THEN 'boring_embedding' ELSE 'open' END AS gate FROM v")
def centroid_gate(spark, d):
    return ve.centroid_gate(table(spark, d, "embeddings"), *GATE, odd_cut=0.2, boring_cut=0.1).select("vec_id", "gate")


@query("vector_upsert", "SELECT vec_id, round(CAST(CASE WHEN vec_id % 2 = 0 THEN embedding[64] ELSE embedding[1] END AS DOUBLE), 6) AS first FROM embeddings UNION ALL SELECT (SELECT max(vec_id) FROM embeddings) + 1, 0.5")
def vector_upsert(spark, d):
    """Even vectors are replaced by their reverse, and one without an id is added."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    new = v.where("vec_id % 2 = 0").select("vec_id", F.reverse("embedding").alias("embedding"))
    extra = spark.range(1).select(F.lit(None).cast("long").alias("vec_id"), F.array_repeat(F.lit(0.5).cast("float"), 64).alias("embedding"))
    return ve.upsert(v, new.unionByName(extra)).select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query("vector_metadata", "SELECT e.vec_id, e.label, coalesce(p.url, '') AS url FROM embeddings e LEFT JOIN pages p ON p.page_id = e.vec_id")
def vector_metadata(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    return v.join(table(spark, d, "pages").select(F.col("page_id").alias("vec_id"), "url"), "vec_id", "left").withColumn("url", F.coalesce("url", F.lit("")))


WORDS = r"unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))"
CT = "t{x} AS (SELECT lang AS topic, " + WORDS + " AS term FROM documents {w}), f{x} AS (SELECT topic, term, count(*) AS tf FROM t{x} GROUP BY 1, 2), a{x} AS (SELECT sum(tf) / count(DISTINCT topic) AS a FROM f{x}), w{x} AS (SELECT topic, term, tf * ln(1 + a / sum(tf) OVER (PARTITION BY term)) AS weight FROM f{x}, a{x}), r{x} AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 6) DESC, term) AS rank FROM w{x})"


@query("ctfidf_terms", "WITH " + CT.format(x="", w="") + " SELECT topic, term, round(weight, 4) AS weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def ctfidf_terms(spark, d):
    return tp.ctfidf(table(spark, d, "documents"), "lang", 10).withColumn("weight", F.round("weight", 4))


def windows(spark, d):
    docs = table(spark, d, "documents")
    old, new = docs.where("doc_id % 2 = 0 AND lang <> 'es'"), docs.where("doc_id % 2 = 1 AND lang <> 'fr'")
    return tuple(tp.summaries(tp.ctfidf(x, "lang", 5), x, "lang") for x in (old, new))


SETS = "WITH " + CT.format(x="1", w="WHERE doc_id % 2 = 0 AND lang <> 'es'") + ", " + CT.format(x="2", w="WHERE doc_id % 2 = 1 AND lang <> 'fr'") + ", o AS (SELECT topic, list(term ORDER BY rank) AS ts FROM r1 WHERE rank <= 5 GROUP BY 1), n AS (SELECT topic, list(term ORDER BY rank) AS ts FROM r2 WHERE rank <= 5 GROUP BY 1)"


@query("topic_drift", SETS + ", c AS (SELECT lang AS topic, count(*) FILTER (doc_id % 2 = 1 AND lang <> 'fr') - count(*) FILTER (doc_id % 2 = 0 AND lang <> 'es') AS diff FROM documents GROUP BY 1) SELECT topic, CASE WHEN o.ts IS NULL THEN 'new' WHEN n.ts IS NULL THEN 'retired' ELSE 'updated' END AS state, coalesce(round(len(list_intersect(o.ts, n.ts)) / len(n.ts), 3), -1) AS overlap, coalesce(array_to_string(list_sort(list_filter(n.ts, lambda x: NOT list_contains(o.ts, x))), ','), '') AS new_terms, coalesce(array_to_string(list_sort(list_filter(o.ts, lambda x: NOT list_contains(n.ts, x))), ','), '') AS dropped_terms, diff AS count_change FROM o FULL JOIN n USING (topic) JOIN c USING (topic)")
def topic_drift(spark, d):
    got = tp.drift(*windows(spark, d))
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return got.select("topic", "state", F.coalesce("overlap", F.lit(-1.0)).alias("overlap"), text("new_terms"), text("dropped_terms"), "count_change")


@query("topic_sets", "WITH o AS (SELECT DISTINCT source FROM documents WHERE lang = 'en'), n AS (SELECT DISTINCT source FROM documents WHERE lang = 'es') SELECT source, 'new' AS state FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT source, 'retired' FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT source, 'shared' FROM (SELECT * FROM o INTERSECT SELECT * FROM n)")
def topic_sets(spark, d):
    docs = table(spark, d, "documents")
    o, n = docs.where("lang = 'en'").select("source"), docs.where("lang = 'es'").select("source")
    tag = lambda df, s: df.withColumn("state", F.lit(s))
    return tag(n.subtract(o), "new").unionByName(tag(o.subtract(n), "retired")).unionByName(tag(o.intersect(n), "shared"))


@query("bloom_membership", "SELECT doc_id, source, source IS NOT NULL AS member, coalesce(source || '?' IN (SELECT source FROM documents WHERE source IS NOT NULL), false) AS other FROM documents")
def bloom_membership(spark, d):
    """Which words of the benchmark may occur as source names or languages of documents: no false negatives."""
    docs = table(spark, d, "documents")
    f = BloomFilter.of(docs, "source", 10_000, 0.001)
    return docs.select("doc_id", "source", f.member()(F.col("source")).alias("member"), f.member()(F.concat("source", F.lit("?"))).alias("other"))


@query("cluster_layout")
def cluster_layout(spark, d):
    return ve.layout(table(spark, d, "embeddings"))


@query("cluster_density")
def cluster_density(spark, d):
    return ve.density_clusters(table(spark, d, "embeddings").select("vec_id", "embedding"), keeper("density"))


@query("text_search")
def text_search(spark, d):
    """Every hundredth document as a query among all documents, by hashed word counts."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return ve.search_texts(t, t.where("vec_id % 100 = 0"), 3)
