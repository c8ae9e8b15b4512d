import corpus_pipeline as cp
from pagesieve.llm import registry
from tests.conftest import SF
from tests.llm.conftest import DOCS, sentences


def test_registry():
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(registry.queries()) | {"pipeline"} <= names
    assert sorted({int(n[2:].split("_")[0]) for n in registry.queries()}) == list(range(1, 11))


def test_stages_on_planted_cases(spark, tmp_path):
    clean = sentences(200, 31, 70)
    rows = [(i, t) for i, t in enumerate(clean)]
    bad = [t + " vile rotten vile rotten" for t in sentences(40, 32, 40)]
    rows += [(1000 + i, t) for i, t in enumerate(bad)]
    rows += [(2000 + i, clean[i] + " extra") for i in range(5)] + [(2100, clean[7]), (2100, clean[7]), (2200, "12345 !!!"), (2201, None)]
    item = sentences(1, 99, 30)[0]
    rows += [(3000, clean[20][:200] + " " + item + " " + sentences(1, 98, 300)[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    labels = spark.createDataFrame([(i, 0, int(1000 <= i < 2000)) for i, _ in rows if i % 2 == 0 and i < 2000], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame([(1, item)], "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    ids, now = {}, docs
    for k, (name, stage) in enumerate(cp.STAGES):
        now.write.parquet(str(tmp_path / f"s{k}"))
        now = stage(spark, spark.read.parquet(str(tmp_path / f"s{k}")), str(tmp_path))
        if k < len(cp.STAGES) - 1:
            assert now.columns == docs.columns
        ids[name] = sorted(r["doc_id"] for r in now.collect())
    everything = {i for i, _ in rows}
    assert sum(i in ids["toxicity"] for i in range(1000, 1040)) <= 2 and sum(i in ids["toxicity"] for i in range(200)) >= 192
    assert set(ids["toxicity"]) - set(ids["language_id"]) == {2200, 2201} & everything
    left = set(ids["near_dedup"])
    assert not left & {*range(2000, 2005), 2100}  # the smallest id of each class stays
    assert left >= {i for i in ids["language_id"] if i < 200} - {3000} and len(ids["near_dedup"]) == len(left)
    assert set(ids["near_dedup"]) - set(ids["decontamination"]) == {3000} & left
    assert ids["packing"] == ids["decontamination"]
    assert sorted(r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect()) == ids["packing"]


def odd_rows(spark, item):
    """Null and repeated ids with different texts, equal rows, ties, texts without a word, and clashing column names."""
    a, b, c, d = sentences(4, 5, 60)
    rows = [(7, a), (7, b), (7, b), (None, c), (None, d), (None, d), (3, c), (8, None), (8, None), (9, ""), (None, f"{item} and {b} {c}"), (None, None), (5, "..."), (6, a + " end")]
    return spark.createDataFrame([(i, t, "en", "s", 1, k % 3, "x", "y") for k, (i, t) in enumerate(rows)], DOCS + ", class_id int, `__name` string, `Bucket` string"), (a, b, c, d)


def test_stages_on_odd_rows(spark, tmp_path):
    item = sentences(1, 99, 30)[0]
    docs, (a, b, c, d) = odd_rows(spark, item)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(7, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = cp.near_dedup(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    leak = f"{item} and {b} {c}"
    # b of id 7 once, c of id 3 instead of no id, d once, a of id 6 (the smaller id); wordless texts all
    assert pairs(got) == sorted([(7, b), (3, c), (None, d), (6, a + " end"), (None, leak), (8, None), (8, None), (9, ""), (None, None), (5, "...")], key=str)
    clean = cp.decontamination(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and pairs(clean) == sorted(set_aside(pairs(docs), (None, leak)), key=str)
    for stage in (cp.toxicity, cp.language):
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert cp.toxicity(spark, docs, str(tmp_path)).count() == docs.count()
    assert cp.packing(spark, docs, str(tmp_path)).count() == docs.count()


def set_aside(rows, one):
    rows = list(rows)
    rows.remove(one)
    return rows


def test_pipeline_of_nothing(spark, tmp_path):
    for name, kind in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_the_smallest_tables(spark):
    n = cp.run(spark, SF).count()
    assert 100 < n < 200
