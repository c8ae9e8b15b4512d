import hashlib

import numpy as np
import pytest

from pagesieve.llm._common import new_path
from pagesieve.llm.embedding_dedup import OP6_SQL, EmbeddingParams, op6_embedding_dedup, similar_vectors
from pagesieve.llm.warc import OP5_SQL, assemble, op5_warc_transactions, parse_records, read_archives, write_archives
from tests.conftest import SF
from tests.oracle import same


def test_warc_equals_sql(spark):
    same(spark, SF, op5_warc_transactions, OP5_SQL)


def test_warc_edges(spark, tmp_path):
    big = "<p>é</p>" * 300
    rows = [(1, "http://a/x y", big), (2, "http://a/é?\n", big), (3, None, big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "http://b", None), (7, "http://b", ""), (None, "http://n", big), (8, "http://c", "x" * 3_000_000), (9, "http://d", "WARC/1.1\r\n\r\n"), (10, "e", "n" * 1000), (11, "f", "n" * 1000), (None, "g", "m" * 1000), (None, "g", "m" * 1000)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = op5_warc_transactions(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        refers = 3 if h == big and i != 3 else 11 if i == 10 else None
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if refers else "response", refers))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_captures_are_nested(spark):
    pages = spark.createDataFrame([(1, "http://h/p?q=1", "<p>"), (2, "http://h/", "z" * 2000), (3, "http://i/", "z" * 2000)], "page_id long, url string, html string")
    out = new_path(spark, "w")
    names = write_archives(pages, out)
    rows = assemble(read_archives(spark, out, names, with_payload=True)).collect()
    one = next(r for r in rows if r["metadata"]["fields"]["page-id"] == "1")
    assert one["request"]["request_line"] == "GET /p?q=1 HTTP/1.1" and one["response"]["status"] == 200 and bytes(one["response"]["payload"]) == b"<p>" and one["response"]["digest_ok"]
    first = next(r for r in rows if r["metadata"]["fields"]["page-id"] == "2")
    last = next(r for r in rows if r["metadata"]["fields"]["page-id"] == "3")
    assert first["kind"] == "revisit" and first["refers_to"] == last["capture_id"]


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    out = new_path(spark, "w")
    assert write_archives(empty, out) == [] and assemble(read_archives(spark, out, [])).count() == 0


def test_a_cut_archive_is_an_error():
    import io

    with pytest.raises(ValueError):
        list(parse_records(io.BytesIO(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc")))
    with pytest.raises(ValueError):
        list(parse_records(io.BytesIO(b"garbage\r\n")))


def test_embeddings_equal_sql(spark):
    same(spark, SF, op6_embedding_dedup, OP6_SQL)


def groups(seed=1, n=600, dim=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[100:220] = x[100] + 0.05 * rng.normal(size=(120, dim))  # near copies
    x[300:330] = x[300]  # copies
    for i in range(400, 420):  # a chain whose ends are far apart
        x[i] = x[i - 1] + 0.28 * rng.normal(size=dim) * np.linalg.norm(x[i - 1]) / np.sqrt(dim)
    return x.astype(np.float32)


def test_embeddings_equal_brute_force(spark):
    x = groups()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in similar_vectors(df, EmbeddingParams(shard_rows=200)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    while True:
        low = np.minimum(label, np.where(link, label[None, :], len(x)).min(axis=1))
        if (low == label).all():
            break
        label = low
    found = sum(r["n_links"] for r in got.values())
    assert all(got[i]["n_links"] <= link[i].sum() for i in range(len(x)))
    assert found >= 0.98 * link.sum()
    assert sum(got[i]["component_id"] == label[i] for i in range(len(x))) >= 0.98 * len(x)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


@pytest.mark.parametrize("more", [{}, {"block_rows": 50}])
def test_links_are_whole_when_routing_misses_them(spark, more):
    """A dense group of distinct vectors over many clusters; also vectors of another dimension, and copies."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16))
    x[:400] = x[0] + 0.17 * rng.normal(size=(400, 16))
    x[450:455] = x[5]
    y = rng.normal(size=8) + 0.1 * rng.normal(size=(30, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*x, *y])], "vec_id long, embedding array<double>")
    p = EmbeddingParams(shard_rows=20, overlap=1, attempts=1, candidates=8, **more)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in similar_vectors(df, p).collect()}
    want = {}
    for at, m in ((0, x), (700, y)):
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        link = u @ u.T >= 0.95
        np.fill_diagonal(link, False)
        label = np.arange(len(m))
        for _ in range(len(m)):
            label = np.minimum(label, np.where(link, label[None, :], len(m)).min(axis=1))
        want |= {at + i: (int(link[i].sum()), at + int(label[i])) for i in range(len(m))}
    assert got == want


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [0.0, 1e-30]), (12, [0.0, 3.0]), (None, [1.0, 0.0]), (13, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, node int, copies int")
    got = similar_vectors(df)
    rows_out = got.collect()
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and len(rows_out) == len(rows)
    by = {r["vec_id"]: tuple(r)[1:] for r in rows_out}
    assert by[1] == (3, 1, True) and by[2] == (3, 1, False) and by[3] == (3, 1, False)
    assert by[11] == (1, 11, True) and by[12] == (1, 11, False)
    for i in (4, 5, 6, 7, 8, 9, 10, 13):
        assert by[i] == (0, i, True)
    assert by[None][0] == 0
    assert similar_vectors(df.limit(0)).count() == 0
    assert similar_vectors(df.where("vec_id = 4")).count() == 1


def plain_links(rows):
    unit = {k: np.array(v) / np.linalg.norm(v) for k, (_, v) in enumerate(rows)}
    linked = {k: {j for j in unit if j != k and unit[j] @ unit[k] >= 0.95} for k in unit}
    out = []
    for k in unit:
        seen, todo = {k}, [k]
        while todo:
            new = linked[todo.pop()] - seen
            seen |= new
            todo += new
        out.append((rows[k][0], len(linked[k]), min(rows[j][0] for j in seen)))
    return sorted(out)


def test_repeated_ids_with_different_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [0.0, 1.0, 0.1]), (3, [0.0, 1.0, 0.1]), (4, [0.0, 0.0, 1.0]), (4, [1.0, 0.0, 0.1])]
    got = similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == plain_links(rows)


def test_large_shards_are_compared_in_blocks(spark):
    rng = np.random.default_rng(11)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * rng.choice([0.1, 0.3, 1.0])).tolist()) for i in range(300)]
    audits = []
    p = EmbeddingParams(shard_rows=100, overlap=2, shard_limit=60, block_rows=40)
    got = similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), p, audits).collect()
    want = plain_links(rows)
    assert audits[-1] >= p.min_recall and sum(n for _, n, _ in want) > 1000
    found = {r["vec_id"]: r["n_links"] for r in got}
    assert sum(found.values()) >= 0.98 * sum(n for _, n, _ in want) and all(found[i] <= n for i, n, _ in want)
