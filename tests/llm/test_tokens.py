import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pagesieve.llm._common import new_path
from pagesieve.llm.token_counts import TokenCountParams, count_chunked, count_spliced, count_tokens, load_tokenizer
from pagesieve.llm.token_files import Encoder, TokenShard, read_document, read_token_files, write_token_files
from tests.conftest import SF

WORD, BYTE, PIECE = (public_tokenizers.path(p) for p in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def test_files_round_trip(spark, odd_docs):
    out = new_path(spark, "t")
    shards = write_token_files(odd_docs, out, WORD)
    tok, start = load_tokenizer(WORD), 0
    rows = odd_docs.withColumn("h", F.xxhash64("text")).orderBy(F.asc_nulls_first("doc_id"), "h").collect()
    got = read_token_files(spark, out, shards, with_ids=True).orderBy("start").collect()
    assert len(got) == len(rows)
    for r, g in zip(rows, got):
        ids = np.array(tok.encode(r["text"] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()))
        assert g["ids"] == ids.tolist()
        start += len(ids)
    names = [s[0] for s in shards]
    assert read_document(out, names, 4).tolist() == next(g["ids"] for g in got if g["doc_id"] == 4)
    assert read_document(out, names, 999) is None


def test_no_documents(spark, no_docs):
    out = new_path(spark, "t")
    shards = write_token_files(no_docs, out, WORD)
    assert shards == [] and read_token_files(spark, out, shards).count() == 0
    assert count_tokens(no_docs, BYTE).count() == 0


def test_a_shard_of_another_dictionary_is_refused():
    with pytest.raises(Exception):
        TokenShard(b"x" * 100, b"")


def test_encoder_equals_library_on_any_text():
    import pyarrow as pa

    rng, tok = random.Random(4), load_tokenizer(WORD)
    pieces = ["a", "B", "stra", " ", "  ", "\n", "\v", "\x85", " ", "'s", "É", "é", "́", "Σ", "İ", "<|endoftext|>", "<|endo", "7", "!!", "~", "字", "क़", "×", "ﬁ", "\x00", "-", "don't"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [None]
    for path in (WORD, BYTE):
        tok = load_tokenizer(path)
        ids, ends = Encoder(path, 50)(pa.array(texts))
        for t, a, b in zip(texts, np.append(0, ends[:-1]), ends):
            assert tok.encode(t or "", add_special_tokens=False).ids == ids[a:b].tolist(), t


def test_spliced_counts_equal_the_library():
    rng, tok = random.Random(6), load_tokenizer(BYTE)
    texts = []
    for k in range(400):
        texts.append("".join(rng.choice(["a", "b", " ", "  ", "\n", "'s", "hello", "<|endoftext|>", "é", "7", "!!", " \n ", " ", "\x1c", "\x1f ", "\x85", "\u2003", "字"]) for _ in range(rng.randint(0, 400))))
        if k % 8 == 0:
            texts[-1] = "".join(texts[-1].split())  # nowhere to splice
    want = [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    for chunk, overlap in ((20, 3), (50, 10), (100, 20)):
        assert [count_spliced(tok, t, chunk, overlap) for t in texts] == want
        got, splices, widened = count_chunked(tok, texts, chunk, overlap)
        assert got == want and splices > 40 and 0 < widened < 400


def test_the_query_splices_its_own_long_texts(spark):
    p, tok = TokenCountParams(), load_tokenizer(BYTE)
    long = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r["text"] or "") > p.chunk_chars]
    got, splices, widened = count_chunked(tok, long, p.chunk_chars, p.overlap_chars)
    assert got == [len(tok.encode(t, add_special_tokens=False).ids) for t in long]
    assert splices == sum(-(-(len(t) - p.overlap_chars) // p.chunk_chars) - 1 for t in long) > 20 and not widened


def test_counts_from_pieces_equal_the_library():
    import pyarrow as pa

    from pagesieve.llm.token_counts import CUT, PieceCounter

    rng, tok = random.Random(8), load_tokenizer(BYTE)
    pieces = ["a", "B", "stra", " ", " ", "  ", "\n", "\r\n", "\t", "\v", "\f", "\x85", "\xa0", "\u2003", "\x1c", "'s", "é", "́", "<|endoftext|>", "<|endo", "7", "!!", "~", "字", "Ġ", "-", "don't", "\u200b"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    counter = PieceCounter(tok, 300)
    assert counter.fits and not PieceCounter(load_tokenizer(WORD)).fits and not any(CUT in t for t in texts)
    for a in range(0, len(texts), 500):
        got = counter(pa.array(texts[a : a + 500]))
        assert got.tolist() == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts[a : a + 500]]


@pytest.mark.parametrize("path", [BYTE, PIECE])
def test_counts(spark, odd_docs, path):
    p = TokenCountParams(chunk_chars=2000, overlap_chars=50)
    got = count_tokens(odd_docs, path, p)
    assert got.columns == ["doc_id", "text", "score", "block", "n_bytes", "n_tokens", "over_limit"]
    tok = load_tokenizer(path)
    for r in got.collect():
        t = r["text"] or ""
        n = len(tok.encode(t)) if path == PIECE else len(tok.encode(t, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(t.encode()), n > 512)


def test_queries(spark):
    from pagesieve.llm.token_counts import op7_token_counts
    from pagesieve.llm.token_files import op1_token_files

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tok = load_tokenizer(BYTE)
    for r in op7_token_counts(spark, SF).collect():
        assert r["n_tokens"] == len(tok.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
    tok, start = load_tokenizer(WORD), 0
    got = {r["doc_id"]: r for r in op1_token_files(spark, SF).collect()}
    for i in sorted(docs):
        ids = np.array(tok.encode(docs[i], add_special_tokens=False).ids + [1], dtype="<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
