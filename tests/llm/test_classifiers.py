import collections
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from pagesieve.llm.language_id import LanguageParams, fit_language, ngrams, op9_language_id, predict_language
from pagesieve.llm.toxicity import ToxicityModel, ToxicityParams, fit_toxicity, nnpu_fit, op2_toxicity, score_toxicity, word_features
from pagesieve.llm.toxicity import learnable as toxicity_learnable
from tests.conftest import SF
from tests.llm.conftest import DOCS, sentences

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark):
    bad = [t + " vile rotten" + t[:20] for t in sentences(60, 1)]
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(bad + sentences(300, 2))], DOCS)


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    docs = corpus(spark)
    labels = spark.createDataFrame([(i, 0, int(i < 60)) for i in range(0, 360, 2)] + [(0, 0, 0), (7, None, None), (None, 1, 1)], LABELS)
    model = fit_toxicity(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in score_toxicity(docs, model).collect()}
    assert sum(got[i] for i in range(60)) >= 57 and sum(got[i] for i in range(60, 360)) <= 9


def test_toxicity_edges(spark, odd_docs, no_docs):
    docs = corpus(spark)
    labels = spark.createDataFrame([(i, 0, int(i < 60)) for i in range(0, 360, 2)], LABELS)
    model = fit_toxicity(docs, labels)
    got = score_toxicity(odd_docs, model)
    assert got.columns == ["doc_id", "text", "n_tokens", "block", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert len({r["score"] for r in rows if r["text"] == "one two three"}) == 1
    assert score_toxicity(no_docs, model).count() == 0
    for none in (labels.limit(0), labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert {r["score"] for r in score_toxicity(docs, fit_toxicity(docs, none)).collect()} == {0.0}
    assert fit_toxicity(no_docs, labels).features == {}
    assert ToxicityModel().prior == 0.0


def test_nnpu_keeps_the_negative_risk_from_going_below_zero():
    rng = np.random.default_rng(1)
    pos = [(np.array([0]), np.array([1.0])) for _ in range(20)]
    un = [(np.array([0] if rng.random() < 0.3 else [1]), np.array([1.0])) for _ in range(400)]
    w, b = nnpu_fit(pos, un, 2, 0.3, ToxicityParams())
    assert w[0] + b > 0 > w[1] + b


def test_nnpu_equals_a_plain_restatement():
    """Dense loop over the same risk, with its gradient by finite differences."""
    rng = np.random.default_rng(3)
    n, prior, p = 5, 0.3, ToxicityParams(steps=60)
    dense = lambda k, up: (rng.random((k, n)) < np.array([up, 0.5, 0.2, 0.4, 0.3])) * rng.random((k, n))
    xp, xu = dense(12, 0.9), dense(60, 0.3)
    rows = lambda x: [(np.flatnonzero(r), r[r > 0]) for r in x]
    loss = lambda x, v, sign: np.log1p(np.exp(-sign * (x @ v[:n] + v[n]))).mean()
    negative = lambda v: loss(xu, v, -1) - prior * loss(xp, v, -1)
    v, m1, m2, reversed_ = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1), 0
    for step in range(1, p.steps + 1):
        if negative(v) >= 0:
            f = lambda v: prior * loss(xp, v, 1) + negative(v)
        else:
            f, reversed_ = (lambda v: -negative(v)), reversed_ + 1
        g = np.array([(f(v + e) - f(v - e)) / 2e-5 for e in np.eye(n + 1) * 1e-5])
        g[:n] += p.l2 * v[:n]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        v = v - p.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    w, b = nnpu_fit(rows(xp), rows(xu), n, prior, p)
    assert np.allclose(np.append(w, b), v, atol=1e-4)


def test_toxicity_query_equals_plain_scores(spark):
    """Every score of the query from the model's weights by a plain loop over the words."""
    import re

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_toxicity(docs, labels, toxicity_learnable())
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    learned = [t for i, t in known.items() if zlib.crc32(str(i).encode()) % 5]
    assert abs(model.prior - sum(learned) / len(learned)) < 1e-12 and len(model.features) > 10
    got = {r["doc_id"]: r for r in op2_toxicity(spark, SF).collect()}
    for r in docs.collect():
        words = re.findall(r"[^\W\d_]+", (r["text"] or "").lower())
        counts = collections.Counter(f for w in words for f in word_features(w) if f in model.features)
        z = model.intercept + sum(model.weights[model.features[f]] * min(1.0, 6 * math.sqrt(c / len(words))) for f, c in counts.items())
        row = got[r["doc_id"]]
        assert abs(row["score"] - 1 / (1 + math.exp(-z))) < 1e-9 and row["predicted"] == int(row["score"] >= 0.5)
        assert row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_toxicity_of_held_out_rows(spark, sf="/root/testdata/sf0.1"):
    known = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(known[r["doc_id"]], r["predicted"]) for r in op2_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in known]
    recall = sum(t and p for t, p in rows) / sum(t for t, _ in rows)
    assert len(rows) > 500 and recall > 0.9 and sum(p and not t for t, p in rows) / sum(not t for t, _ in rows) < 0.02


def test_extra_columns_with_clashing_names_do_not_reach_the_fits(spark):
    docs, langs = corpus(spark), languages(spark)
    labels = spark.createDataFrame([(i, 0, int(i < 60)) for i in range(0, 360, 2)], LABELS)
    odd = lambda df: df.withColumns({c: F.lit("x") for c in ("toxic", "pos", "f", "p", "u", "i", "n", "v")})
    a, b = fit_toxicity(docs, labels), fit_toxicity(odd(docs), labels.withColumns({"text": F.lit("y"), "lang": F.lit(1)}))
    assert a.features == b.features and np.array_equal(a.weights, b.weights) and a.intercept == b.intercept
    a, b = fit_language(langs), fit_language(odd(langs))
    assert a.languages == b.languages and np.array_equal(a.log_prob, b.log_prob)


def test_held_out_fifth_is_not_learned_from(spark, tmp_path):
    docs = corpus(spark)
    labels = spark.createDataFrame([(i, 0, int(i < 60)) for i in range(360)], LABELS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    first = {r["doc_id"]: r["score"] for r in op2_toxicity(spark, str(tmp_path)).collect()}
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = tmp_path / "o"
    docs.write.parquet(str(other / "documents.parquet"))
    labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(str(other / "labels.parquet"))
    got = op2_toxicity(spark, str(other)).collect()
    assert {r["doc_id"]: r["score"] for r in got} == first
    assert {r["doc_id"] for r in got if r["held_out"]} == {r["doc_id"] for r in docs.where(held).collect()}


def languages(spark):
    rows = []
    for k, (lang, a) in enumerate((("aa", "abcdefg"), ("bb", "hijklmn"), ("cc", "äöüßéè"))):
        import random

        rng = random.Random(k)
        rows += [(k * 100 + i, " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(20)), lang, "s", 1) for i in range(50)]
    return spark.createDataFrame(rows, DOCS)


def test_language(spark):
    docs = languages(spark)
    model = fit_language(docs)
    assert model.languages == ["aa", "bb", "cc"]
    got = predict_language(docs.drop("source"), model).collect()
    assert all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in got)


def test_language_edges(spark, odd_docs, no_docs):
    docs = languages(spark)
    model = fit_language(docs)
    got = predict_language(odd_docs, model)
    assert got.columns == ["doc_id", "text", "n_tokens", "block", "lang_pred", "score"]
    for r in got.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == letters and (r["score"] > 0) == letters
    assert predict_language(no_docs, model).count() == 0
    empty = fit_language(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in predict_language(docs, empty).collect()} == {("und", 0.0)}
    assert fit_language(no_docs).languages == []


def test_pieces_of_a_long_text_have_the_same_ngrams():
    text = [" ".join(sentences(3, 3, 200)), "", "ab", "é 1"]
    count = lambda p: sorted((int(d), int(b)) for got in ngrams(text, p) if isinstance(got, tuple) for d, b in zip(*got))
    assert count(LanguageParams()) == count(LanguageParams(piece=97))


def plain_buckets(text, p):
    """Hashed n-grams of one text, one after the other; None if it has no letter."""
    t, full = "".join(c if c.isalpha() else " " for c in (text or "").lower()), (1 << 64) - 1
    if not t.strip():
        return None
    out = []
    for n in p.orders:
        for k in range(len(t) - n + 1):
            if t[k] == " " and (n == 1 or t[k + 1] == " "):
                continue
            h = 0
            for c in t[k : k + n]:
                h = (h * 0x100000001B3 + ord(c) + 1) & full
            x = (h * 0x9E3779B97F4A7C15 + n) & full
            x ^= x >> 29
            out.append((x * 0xBF58476D1CE4E5B9 & full) >> (64 - p.bits))
    return out


def test_language_query_equals_plain_naive_bayes(spark):
    """Counts, priors, predictions and scores of the whole query by plain loops."""
    p, docs = LanguageParams(), spark.read.parquet(f"{SF}/documents.parquet").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in docs}
    buckets = {r["doc_id"]: plain_buckets(r["text"], p) for r in docs}
    counts, texts = collections.defaultdict(lambda: np.full(1 << p.bits, p.smoothing)), collections.Counter()
    for r in docs:
        if not held[r["doc_id"]] and r["lang"] is not None and r["text"] is not None:
            texts[r["lang"]] += 1
            np.add.at(counts[r["lang"]], buckets[r["doc_id"]] or [], 1)
    langs = sorted(texts)
    logs = {x: np.log(counts[x] / counts[x].sum()) for x in langs}
    for r in op9_language_id(spark, SF).collect():
        b = buckets[r["doc_id"]]
        assert r["held_out"] == held[r["doc_id"]]
        if b is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        z = np.array([math.log(texts[x] / sum(texts.values())) + logs[x][b].sum() for x in langs]) / math.sqrt(len(b))
        share = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert abs(r["score"] - share.max()) < 1e-4 and (r["lang_pred"] == langs[int(z.argmax())] or np.diff(np.sort(share))[-1] < 1e-4)


def test_letters_of_all_planes(spark):
    docs = spark.createDataFrame([(1, "\U00030000\U00030001"), (2, "\U0001F600 \U000E0001")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in predict_language(docs, fit_language(languages(spark))).collect()}
    assert got[1] != "und" and got[2] == "und"


def test_very_long_texts_of_both_classifiers(spark):
    long = " ".join(sentences(1, 4, 500_000))
    docs = spark.createDataFrame([(1, long), (2, long + " vile rotten " * 200_000)], "doc_id long, text string")
    assert len(long) > 2_500_000
    labels = spark.createDataFrame([(i, 0, int(i < 60)) for i in range(0, 360, 2)], LABELS)
    got = {r["doc_id"]: r["predicted"] for r in score_toxicity(docs, fit_toxicity(corpus(spark), labels)).collect()}
    assert got == {1: 0, 2: 1}
    assert {r["lang_pred"] for r in predict_language(docs, fit_language(languages(spark))).collect()} <= {"aa", "bb"}


def test_held_out_languages_are_not_learned_from(spark, tmp_path):
    docs = languages(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    for name, df in (("a", docs), ("b", docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
    a, b = (sorted(map(tuple, op9_language_id(spark, str(tmp_path / n)).collect())) for n in "ab")
    assert a == b and sum(r[1] for r in a) == docs.where(held).count()
