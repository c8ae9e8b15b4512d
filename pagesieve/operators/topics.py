"""Topic operators: class-based TF-IDF terms, drift between two windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.functions.text import word_tokens


def ctfidf(docs: DataFrame, topic: str, top_n: int = 10) -> DataFrame:
    """(topic, term, weight, rank) of the top terms per topic: tf * ln(1 + A / f).

    tf counts a term in the topic, f in all topics, A is the average number of words per topic.
    """
    each = docs.where(F.col(topic).isNotNull()).select(F.col(topic).alias("topic"), F.explode(word_tokens(F.col("text"))).alias("term"))
    tf = each.groupBy("topic", "term").agg(F.count("*").alias("tf"))
    f = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    average = tf.agg(F.sum("tf") / F.count_distinct("topic")).first()[0] or 0.0
    w = tf.join(f, "term").withColumn("weight", F.col("tf") * F.ln(1 + F.lit(float(average)) / F.col("f")))
    ranked = w.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.round("weight", 6).desc(), "term")))
    return ranked.where(F.col("rank") <= top_n).select("topic", "term", "weight", "rank")


def summaries(terms: DataFrame, docs: DataFrame, topic: str) -> DataFrame:
    """(topic, representation, count): terms with weights, best first, and the topic's documents; topic -1 is left out."""
    rep = terms.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term", "weight"))), lambda x: F.struct(x["term"].alias("term"), x["weight"].alias("weight"))).alias("representation"))
    n = docs.groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("count"))
    return rep.join(n, "topic").where(F.col("topic").cast("string") != "-1")


def top_terms(representation: Column, n: int) -> Column:
    return F.transform(F.slice(representation, 1, n), lambda x: x["term"])


def drift(before: DataFrame, now: DataFrame, n: int = 5) -> DataFrame:
    """One row per topic: state (updated, new or retired), overlap, new and dropped terms (sorted, at most n) and change of count.

    Overlap is the share of the current terms that were there before.
    """
    b = before.select("topic", top_terms(F.col("representation"), n).alias("old"), F.col("count").alias("old_count"))
    c = now.select("topic", top_terms(F.col("representation"), n).alias("cur"), F.col("count").alias("cur_count"))
    j = b.join(c, "topic", "full_outer")
    both = F.col("old").isNotNull() & F.col("cur").isNotNull()
    return j.select(
        "topic", F.when(both, "updated").when(F.col("old").isNull(), "new").otherwise("retired").alias("state"),
        F.when(both, F.round(F.size(F.array_intersect("old", "cur")) / F.greatest(F.size("cur"), F.lit(1)), 3)).alias("overlap"),
        F.when(both, F.slice(F.array_sort(F.array_except("cur", "old")), 1, n)).alias("new_terms"), F.when(both, F.slice(F.array_sort(F.array_except("old", "cur")), 1, n)).alias("dropped_terms"),
        (F.coalesce("cur_count", F.lit(0)) - F.coalesce("old_count", F.lit(0))).alias("count_change"),
    )
