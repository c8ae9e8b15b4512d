import collections
import math
import re

import numpy as np
import pytest

from pagesieve.llm._blocks import Block, BlockParams, make_blocks
from pagesieve.llm.decontamination import OP8_SQL, DecontaminationParams, needed_hits, op8_decontamination, search_containment
from pagesieve.llm.lm_scoring import OP3_SQL, LmParams, op3_lm_scores, score_documents
from pagesieve.llm.near_dedup import NearDedupParams, icws, near_duplicates, op10_near_duplicates, weighted_jaccard
from pagesieve.llm.packing import PackingParams, best_boundaries, pack_documents
from tests.conftest import SF
from tests.llm.conftest import sentences
from tests.oracle import same

#: small enough for several blocks, buckets and levels of the exchange
SMALL = BlockParams(block_words=300, bucket_bytes=4000, row_keys=100)


def test_lm_equals_sql(spark):
    same(spark, SF, op3_lm_scores, OP3_SQL)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_lm_equals_brute_force(spark, order):
    texts = sentences(12, 3, 30, 25) + ["", None, "x", "x x x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = [(t or "").lower().split() for t in texts]
    got = {r["doc_id"]: r for r in score_documents(docs, LmParams(order=order, blocks=SMALL)).collect()}
    for i, ws in enumerate(words):
        rest = collections.Counter(tuple(o[k : k + n]) for j, o in enumerate(words) if j != i for n in range(1, order + 1) for k in range(len(o) - n + 1))
        total = sum(len(o) for j, o in enumerate(words) if j != i)

        def s(gram, rest=rest, total=total):
            if len(gram) == 1:
                return rest[gram] / total if rest[gram] else 1 / (total + 1)
            return rest[gram] / rest[gram[:-1]] if rest[gram] else 0.4 * s(gram[1:])

        want = sum(math.log(s(tuple(ws[max(0, k - order + 1) : k + 1]))) for k in range(len(ws)))
        assert got[i]["n_words"] == len(ws) and abs(got[i]["log_score"] - want) < 1e-9


def test_lm_edges(spark, odd_docs, no_docs):
    rows = score_documents(odd_docs, LmParams(blocks=SMALL)).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["mean_log_score"] is None and r["log_score"] == 0 for r in rows if r["n_words"] == 0)
    assert sum(r["doc_id"] is None for r in rows) == 2 and sum(r["doc_id"] == 5 for r in rows) == 3
    assert score_documents(no_docs).count() == 0


def test_blocks_hold_all_words(spark, odd_docs):
    blocks, _ = make_blocks(odd_docs, "t", SMALL)
    got = [Block.of(r.asDict()) for r in blocks.collect()]
    assert sum(len(b.codes) for b in got) == sum(len((r["text"] or "").lower().split()) for r in odd_docs.collect())
    assert sum(len(b.ends) for b in got) == odd_docs.count()


def brute_classes(texts, threshold=0.8):
    vec = {}
    for i, t in texts.items():
        w = re.findall(r"[^\W_]+", (t or "").lower())
        vec[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else {}
    df = collections.Counter(s for v in vec.values() for s in v)
    wv = {i: {s: c * (1 + 0.25 * math.log(len(vec) / df[s]) / math.log(len(vec))) for s, c in v.items()} for i, v in vec.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids, total = sorted(texts), {i: sum(v.values()) for i, v in wv.items()}
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = wv[a].keys() & wv[b].keys()
            both = sum(min(wv[a][s], wv[b][s]) for s in common) if common else 0
            if both and both / (total[a] + total[b] - both) >= threshold:
                i, j = sorted((find(a), find(b)))
                parent[j] = i
    return {i: find(i) for i in texts}


def test_near_duplicates_equal_brute_force(spark):
    base = sentences(25, 8, 80)
    texts = dict(enumerate(base))
    for k, t in enumerate(base[:10]):
        w = t.split()
        texts[100 + k] = t.upper() + "!"
        texts[200 + k] = " ".join([*w[:-1], "changed"])
        texts[300 + k] = " ".join([*w[:20], "inserted", *w[20:]])
        texts[400 + k] = " ".join(w[: len(w) // 2])
    shared = sentences(1, 77, 40)[0]
    for k in range(15):
        texts[500 + k] = shared + " " + sentences(1, 1000 + k, 40)[0]
    texts |= {600: "short one", 601: "short one", 602: "", 603: None, 604: "..."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs, NearDedupParams(blocks=SMALL)).collect()}
    assert got == brute_classes(texts)


@pytest.mark.parametrize("block_nodes", [1000, 40])
def test_pairs_inside_a_template_are_all_found(spark, block_nodes):
    """Documents of a long template are just under the threshold; some pairs of them, far from every leader, are over it."""
    template, tails = sentences(1, 5, 100, 5000)[0], sentences(160, 6, 12, 5000)
    texts = {i: f"{template} {t}" for i, t in enumerate(tails)}
    for i in range(0, 120, 2):
        texts[i + 1] = f"{template} {' '.join(tails[i].split()[:4] + tails[i + 1].split()[4:])}"
    want = brute_classes(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(docs, NearDedupParams(block_nodes=block_nodes)).collect()}
    assert len(set(want.values())) == 100
    assert got == want


def test_near_duplicate_query_equals_brute_force(spark, sf="/root/testdata/sf0.01"):
    """The whole query on its whole table: recall of linked pairs is reported by the assertion, and must be 1."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["class_id"] for r in op10_near_duplicates(spark, sf).collect()}
    want = brute_classes(docs)
    classes = collections.defaultdict(list)
    for i, c in want.items():
        classes[c].append(i)
    pairs = [(c, i) for c, members in classes.items() for i in members if i != c]
    assert len(pairs) > 20 and sum(got[a] == got[b] for a, b in pairs) / len(pairs) == 1.0
    assert got == want


def test_near_duplicate_edges(spark, odd_docs, no_docs):
    rows = near_duplicates(odd_docs, NearDedupParams(blocks=SMALL)).collect()
    got = collections.defaultdict(set)
    for r in rows:
        got[r["doc_id"]].add(r["class_id"])
    assert len(rows) == odd_docs.count() and got[None] == {None}
    assert got[5] == got[8] == {5} and got[4] == got[9] == {4} and got[1] == {1} and got[2] == {2}
    assert near_duplicates(no_docs).count() == 0


def test_samples_agree_as_often_as_weights_overlap():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 400).astype(np.uint64)
    wa, wb = rng.gamma(2, 1, 300), rng.gamma(2, 1, 300)
    a, b = (np.sort(keys[:300]), wa), (np.sort(keys[100:]), wb)
    sig = icws(np.array([0, 300]), np.concatenate([a[0], b[0]]), np.concatenate([wa, wb]), 3000, 1)
    assert abs((sig[0] == sig[1]).mean() - weighted_jaccard(a, b)) < 0.04
    assert weighted_jaccard(a, a) == 1.0


def test_decontamination_equals_sql(spark):
    same(spark, SF, op8_decontamination, OP8_SQL)
    assert op8_decontamination(spark, SF)._jdf.queryExecution().toString().count("Python") == 0


def test_decontamination_edges(spark, no_docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long = " ".join(sentences(30, 5, 400))
    bench = spark.createDataFrame([(1, item, 0), (1, item, 0), (2, "too short", 0), (4, "...", 0), (5, "answer is forty two", 0), (3, None, 0), (None, "uno dos tres cuatro cinco seis", 0)], "item_id long, text string, h int")
    rows = [(1, f"{long} {item.upper()}, {long}"), (2, item.replace("alpha", "omega")), (3, "beta gamma delta epsilon zeta"), (4, None), (5, ""), (6, item), (6, item), (None, item), (7, "Uno-dos tres, cuatro cinco seis"), (8, "Too short"), (9, "so the answer is forty-two here"), (10, "answer was forty two"), (11, "short too")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item_id string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in search_containment(docs, bench).collect()}
    assert got == {(1, 1): 1.0, (2, 1): 5 / 6, (6, 1): 1.0, (None, 1): 1.0, (7, None): 1.0, (8, 2): 1.0, (9, 5): 1.0}
    by_shuffle = search_containment(docs, bench, DecontaminationParams(broadcast_rows=0)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in by_shuffle} == set(got)
    assert search_containment(no_docs, bench).count() == 0 and search_containment(docs, bench.limit(0)).count() == 0


def test_decontamination_of_a_very_long_text(spark):
    """A text of several million characters, with an item at its very end."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    long = " ".join(sentences(1, 5, 700_000)) + " " + item
    docs = spark.createDataFrame([(1, long), (2, long[: len(long) // 2])], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert len(long) > 3_000_000 and [(r["doc_id"], r["containment"]) for r in search_containment(docs, bench).collect()] == [(1, 1.0)]


def test_sketch_rule():
    p = DecontaminationParams()
    assert needed_hits(1, p) == 1 and 1 < needed_hits(16, p) < 16


def padding(lengths, bounds):
    return sum(next(b for b in bounds if b >= n) - n for n in lengths)


def boundaries(lengths, buckets):
    c = sorted(collections.Counter(lengths).items())
    return best_boundaries(np.array([n for n, _ in c]), np.array([k for _, k in c]), buckets)


def plain_least_padding(lengths, buckets):
    """The textbook recurrence over all pairs."""
    c = sorted(collections.Counter(lengths).items())
    n = len(c)
    rows, words = np.cumsum([0, *(k for _, k in c)]), np.cumsum([0, *(x * k for x, k in c)])
    best = [0.0] + [math.inf] * n
    least = math.inf
    for _ in range(min(buckets, n)):
        best = [math.inf] + [min(float(v) for v in np.array(best[:j]) + c[j - 1][0] * (rows[j] - rows[:j]) - (words[j] - words[:j])) for j in range(1, n + 1)]
        least = min(least, best[n])
    return least


def test_boundaries_are_optimal():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(30):
        lengths = [rng.randint(0, 12) for _ in range(rng.randint(1, 25))]
        c = collections.Counter(lengths)
        for buckets in (1, 2, 3, 4):
            best = min(padding(lengths, sorted({*s, max(c)})) for s in itertools.combinations(sorted(c), min(buckets - 1, len(c))))
            got = boundaries(lengths, buckets)
            assert padding(lengths, got) == best and len(got) <= buckets


def test_packing(spark, odd_docs, no_docs):
    p = PackingParams(buckets=3, budget=50, shard_rows=2)
    got = pack_documents(odd_docs, p)
    assert got.columns == ["doc_id", "text", "score", "block", "n_tokens", "bucket", "bucket_tokens", "batch_id", "batch_row", "padding"]
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    batches = collections.defaultdict(list)
    for r in rows:
        assert r["n_tokens"] == len((r["text"] or "").split()) and 0 <= r["padding"] == r["bucket_tokens"] - r["n_tokens"]
        batches[r["batch_id"]].append(r)
    for rs in batches.values():
        assert len({r["bucket"] for r in rs}) == 1 and sorted(r["batch_row"] for r in rs) == list(range(len(rs)))
        assert len(rs) == 1 or len(rs) * rs[0]["bucket_tokens"] <= p.budget
    assert pack_documents(no_docs).count() == 0


def test_packing_query_equals_brute_force(spark):
    from pagesieve.llm.packing import op4_packing

    rows = op4_packing(spark, SF).collect()
    lengths = [r["n_tokens"] for r in rows]
    docs = {r["doc_id"]: len(r["text"].split()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == docs
    assert sum(r["padding"] for r in rows) == plain_least_padding(lengths, 16)
    assert len({r["bucket_tokens"] for r in rows}) == 16


def test_boundaries_of_long_texts_are_optimal():
    rng = np.random.default_rng(5)
    lengths = np.concatenate([rng.integers(0, 300, 2000), rng.integers(4000, 90_000, 300)]).tolist()
    assert padding(lengths, boundaries(lengths, 16)) == plain_least_padding(lengths, 16)


def test_equal_rows_spread_over_shards(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 400, "doc_id long, text string").repartition(4)
    rows = pack_documents(docs, PackingParams(budget=30, shard_rows=20)).collect()
    sizes = collections.Counter(r["batch_id"].split("-")[1] for r in rows)
    assert len(rows) == 400 and len(sizes) > 10 and max(sizes.values()) < 60
