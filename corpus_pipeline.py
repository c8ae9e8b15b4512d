"""The corpus pipeline: toxicity, language, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. ``run``
writes each stage's result as Parquet in the shared folder and reads it again for the next.

Rows are only dropped by a stage's own decision. Where an operator wants an id, a row is named by a hash of its doc_id
and text, so a null or repeated doc_id neither joins different texts nor loses one of them; rows with equal doc_id and
text are copies. Texts without a word are nobody's copy. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.llm._common import delete, new_path, release, written
from pagesieve.llm.decontamination import search_containment
from pagesieve.llm.language_id import fit_language, predict_language
from pagesieve.llm.near_dedup import near_duplicates
from pagesieve.llm.packing import pack_documents
from pagesieve.llm.toxicity import fit_toxicity, score_toxicity

#: A text without a letter, or whose language has a lower (tempered) posterior than this, is rejected.
MIN_LANGUAGE_SCORE = 0.4


def _whole_rows(docs: DataFrame) -> DataFrame:
    """The row as one struct beside its text, so that an operator's columns can't clash with the row's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are scored as toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(_whole_rows(docs), fit_toxicity(docs, labels), keep=["__row"])
    return scored.where("predicted = 0").select("__row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told."""
    found = predict_language(_whole_rows(docs), fit_language(docs), keep=["__row"])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("__row.*")


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` as __row (all columns), __id and text, with a name of each row from its doc_id and text."""
    return _whole_rows(docs).withColumns({"__id": F.col("__row.doc_id"), "__name": F.xxhash64("__row.doc_id", "text")})


def _as_documents(named: DataFrame) -> DataFrame:
    return named.select(F.col("__name").alias("doc_id"), "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near duplicates: the one with the smallest id, a null id being the largest."""
    named = _named(docs)
    wordless = ~F.coalesce("text", F.lit("")).rlike(r"[\p{L}\p{N}]")
    texts = named.where(~wordless)
    classes = near_duplicates(_as_documents(texts)).withColumnRenamed("doc_id", "__name").distinct()
    members = texts.groupBy("__name").agg(F.min("__id").alias("id"), F.count("*").alias("rows")).join(classes, "__name")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__name"))
    path = new_path(spark, "pipeline-kept")
    kept = written(members.groupBy("class_id").agg(first.alias("first")).select(F.col("first.__name").alias("__name")).join(members.select("__name", "rows"), "__name"), path)
    left = texts.join(kept, "__name")
    once = left.where("rows = 1").select("__row.*")
    # of equal rows that are kept, one: the smallest by all columns, so that every run takes the same
    again = left.where("rows > 1").groupBy("__name").agg(F.min_by("__row", F.to_json("__row")).alias("__row")).select("__row.*")
    return once.unionByName(again).unionByName(named.where(wordless).select("__row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    named = _named(docs)
    leaks = search_containment(_as_documents(named), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("__name")).distinct()
    return named.join(leaks, "__name", "left_anti").select("__row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of what is left."""
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("language_id", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Learned models and sampled hashes have no SQL form; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        docs = written(stage(spark, docs, sf_dir), path)
        release(spark)
        if last:
            delete(spark, last)
        last = path
    return docs
