"""Queries of graph operators, with their SQL.

Two graphs: links between pages, and a denser one in which a supplier points to the parts it delivers and a part that
was returned points back. Parts have ids of their own range.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesieve.operators import graph as gr
from pagesieve.operators import pages as op
from pagesieve.plans.pages import LINKS, table
from pagesieve.storage import keeper, stored

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


#: Where the ids of parts begin.
PARTS_FROM = 1_000_000_000_000
LINES = f"(SELECT l_suppkey AS src, l_partkey + {PARTS_FROM} AS dst, l_shipdate, l_returnflag, l_linestatus FROM lineitem UNION ALL SELECT l_partkey + {PARTS_FROM}, l_suppkey, l_shipdate, l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag = 'R')"
DENSE = f"e AS (SELECT DISTINCT src, dst FROM {LINES})"
PAGE = f"{LINKS}, e AS (SELECT DISTINCT url AS src, target AS dst FROM l WHERE url <> target)"


def dense(spark, d):
    return lines(spark, d).select("src", "dst")


def lines(spark, d):
    """A sighting of a link for each delivery, and one of the way back for each return."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("src"), (F.col("l_partkey") + PARTS_FROM).alias("dst"), "l_shipdate", "l_returnflag", "l_linestatus")
    return li.unionByName(li.where("l_returnflag = 'R'").withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def linked(spark, d):
    return op.page_links(table(spark, d, "pages")).select(F.col("url").alias("src"), F.col("target").alias("dst")).where("src <> dst")


SEEN = f"s AS (SELECT src, dst, l_shipdate AS at_, l_returnflag AS t, l_linestatus AS r FROM {LINES})"


@query("edge_upsert", f"WITH {SEEN}, b AS (SELECT src, dst, count(*) AS weight, max(at_) AS last_seen, string_agg(DISTINCT r, ',' ORDER BY r) AS rel FROM s GROUP BY 1, 2), x AS (SELECT src, dst, t, min(at_) AS at_ FROM s GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY at_ DESC, t) AS k FROM x) SELECT src, dst, weight, CAST(last_seen AS VARCHAR) AS last_seen, rel, (SELECT string_agg(t, ',' ORDER BY k.k DESC) FROM k WHERE k.src = b.src AND k.dst = b.dst AND k.k <= 2) AS anchors FROM b")
def edge_upsert(spark, d):
    s = lines(spark, d).select("src", "dst", F.col("l_shipdate").alias("seen_at"), F.col("l_returnflag").alias("anchor_text"), F.array("l_linestatus").alias("rel"))
    e = gr.edges_of(s, 2)
    return e.select("src", "dst", "weight", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), F.array_join("rel", ",").alias("rel"), F.array_join("anchor_texts", ",").alias("anchors"))


@query("node_upsert", "SELECT l_suppkey AS url, CAST(min(l_shipdate) AS VARCHAR) AS first_seen, CAST(max(l_shipdate) AS VARCHAR) AS last_seen, count(*) AS observations, CAST(sum(l_linenumber) AS BIGINT) AS webring_hits FROM lineitem GROUP BY 1")
def node_upsert(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("url"), F.col("l_shipdate").alias("seen_at"), F.lit(200).alias("status"), F.lit("").alias("title"), F.col("l_linenumber").alias("webring_hits"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return gr.nodes_of(v).select("url", day("first_seen"), day("last_seen"), "observations", "webring_hits")


DEGREES = "g AS (SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e) GROUP BY 1)"
RECIPROCAL = "q AS (SELECT src AS node, count(*) AS reciprocal_links FROM e WHERE EXISTS (SELECT 1 FROM e b WHERE b.src = e.dst AND b.dst = e.src) GROUP BY 1)"
ODD = "o AS (SELECT src AS node, count(*) FILTER (dst % 7 = 0 OR dst % 5 = 0) / count(*) AS odd_neighbor_ratio FROM e GROUP BY 1)"


@query("link_degrees", f"WITH {DENSE}, {DEGREES} SELECT * FROM g")
def link_degrees(spark, d):
    return gr.degrees(dense(spark, d))


@query("link_reciprocity", f"WITH {DENSE}, {RECIPROCAL} SELECT * FROM q")
def link_reciprocity(spark, d):
    return gr.reciprocity(dense(spark, d))


PARTS = "und AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), c(node, r) AS (SELECT a, a FROM und UNION SELECT und.b, c.r FROM c JOIN und ON und.a = c.node), p AS (SELECT node, min(r) AS component FROM c GROUP BY 1)"


@query("link_components", f"WITH RECURSIVE {PAGE}, {PARTS} SELECT node, component FROM p")
def link_components(spark, d):
    return gr.component_metrics(stored(linked(spark, d), "links"), keeper("parts")).select("node", "component")


@query("component_density", f"WITH RECURSIVE {PAGE}, {PARTS}, z AS (SELECT component, count(*) AS size FROM p GROUP BY 1), m AS (SELECT component, count(*) AS m FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e) JOIN p ON p.node = a GROUP BY 1) SELECT component, size, round(2.0 * m / (size * (size - 1)), 6) AS density FROM z JOIN m USING (component)")
def component_density(spark, d):
    return gr.component_metrics(stored(linked(spark, d), "links"), keeper("parts")).select("component", "size", F.round("density", 6).alias("density")).distinct()


@query("component_names", f"WITH RECURSIVE {PAGE}, {PARTS} SELECT component, left(sha256(concat_ws(':', CAST(sum(CAST('0x' || left(md5(node), 8) AS BIGINT)) AS VARCHAR), count(*))), 8) AS name FROM p GROUP BY 1")
def component_names(spark, d):
    parts = gr.component_metrics(stored(linked(spark, d), "links"), keeper("parts")).select("node", "component")
    return gr.component_names(parts)


def rank_sql(rounds: int) -> str:
    out = [DENSE, "n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)", "c AS (SELECT count(*) AS n FROM n)", "w AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS p FROM e)", "r0 AS (SELECT node, CAST(1.0 AS DOUBLE) / (SELECT n FROM c) AS rank FROM n)"]
    for k in range(1, rounds + 1):
        out.append(f"l{k} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS lost FROM r{k - 1} WHERE node NOT IN (SELECT src FROM e))")
        out.append(f"r{k} AS MATERIALIZED (SELECT n.node, CAST(0.15 AS DOUBLE) / c.n + CAST(0.85 AS DOUBLE) * (coalesce(g.given, 0) + l{k}.lost / c.n) AS rank FROM n CROSS JOIN c CROSS JOIN l{k} LEFT JOIN (SELECT dst, sum(rank * CAST(p AS DOUBLE)) AS given FROM w JOIN r{k - 1} ON r{k - 1}.node = w.src GROUP BY 1) g ON g.dst = n.node)")
    return ", ".join(out)


@query("link_pagerank", f"WITH {rank_sql(5)} SELECT node, round(rank, 9) AS rank FROM r5")
def link_pagerank(spark, d):
    e = stored(gr.pairs_of(dense(spark, d)).withColumn("w", F.lit(1)), "dense")
    return gr.pagerank(e, keeper("rank"), 5, tolerance=None, weights=e).select("node", F.round("rank", 9).alias("rank"))


def odd_scores(edges):
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return nodes.withColumn("last_score", F.when((F.col("node") % 7 == 0) | (F.col("node") % 5 == 0), 0.5).otherwise(0.1))


@query("odd_neighbor_ratio", f"WITH {DENSE}, {ODD} SELECT node, round(odd_neighbor_ratio, 6) AS odd_neighbor_ratio FROM o")
def odd_neighbor_ratio(spark, d):
    e = dense(spark, d)
    return gr.odd_neighbor_ratio(e, odd_scores(e)).withColumn("odd_neighbor_ratio", F.round("odd_neighbor_ratio", 6))


@query("graph_score", f"WITH {rank_sql(5)}, {DEGREES}, {RECIPROCAL}, {ODD}, z AS (SELECT count(*) AS size FROM n) SELECT n.node, round(least(1.0, least(out_degree / 15, 0.2) + least(coalesce(reciprocal_links, 0) / 5, 0.15) + least(z.size / 12, 0.15) + least(rank * 5, 0.1) + least(coalesce(odd_neighbor_ratio, 0) * 0.2, 0.2)), 6) AS graph_score FROM n JOIN g USING (node) JOIN r5 USING (node) LEFT JOIN q USING (node) LEFT JOIN o USING (node) CROSS JOIN z")
def graph_score(spark, d):
    """All metrics together; the dense graph is one component."""
    e = stored(dense(spark, d).distinct(), "dense")
    return gr.graph_metrics(e, odd_scores(e), keeper("metrics"), 5, tolerance=None).select("node", F.round("graph_score", 6).alias("graph_score"))


@query("ego_neighborhoods", f"WITH {DENSE.replace('SELECT DISTINCT', 'SELECT')}, d AS (SELECT src, dst, count(*) AS weight FROM e GROUP BY 1, 2), s AS (SELECT node, CASE WHEN node % 7 = 0 OR node % 5 = 0 THEN 0.5 ELSE 0.1 END AS score FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)), g AS (SELECT node, (SELECT count(*) FROM d WHERE src = node) AS od FROM s), c AS (SELECT s.node, s.score FROM s JOIN g USING (node) ORDER BY s.score DESC, od DESC, node LIMIT 5) SELECT c.node, CAST(c.score AS DOUBLE) AS score, coalesce(string_agg(d.dst || ':' || d.weight || ':' || (b.src IS NOT NULL), ',' ORDER BY s.score DESC, d.dst), '') AS neighbors FROM c LEFT JOIN d ON d.src = c.node LEFT JOIN s ON s.node = d.dst LEFT JOIN d b ON b.src = d.dst AND b.dst = d.src GROUP BY 1, 2")
def ego_neighborhoods(spark, d):
    e = dense(spark, d)
    got = gr.neighborhoods(e, odd_scores(e).withColumn("graph_score", F.lit(0.0)), 5)
    one = F.transform("neighbors", lambda x: F.concat_ws(":", x["url"].cast("string"), x["weight"].cast("string"), x["reciprocal"].cast("string")))
    return got.select(F.col("src").alias("node"), "score", F.array_join(one, ",").alias("neighbors"))
