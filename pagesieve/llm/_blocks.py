"""Texts as blocks of word codes, and counts of hashed keys over the whole corpus.

A block packs the words of some hundreds of documents as columns: the distinct words' 64-bit hashes, one small code per
word of text, and where each document ends. Blocks are written once and are the relation that later steps explode.

``corpus_counts`` answers, for keys that a function derives from each block (n-grams, shingles), how often each occurs
in the corpus: every block sends its distinct keys with their counts to the hash bucket of the key, the bucket sums
them, and the sums go back to the blocks. A key appears once per block in the exchange however frequent it is, so no
key is hot; a bucket holds about ``bucket_bytes`` of keys. All 64 bits of a key travel.

Rows of the exchange grow in proportion to the corpus: a block deals its keys to so few buckets that a row holds about
``row_keys`` of them. Where the corpus needs more buckets than that, rows of one bucket are merged in bounded chunks
(which sums what they share), and each chunk asks the buckets of the next level as a block does, and so on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.llm._common import new_path, partitions, small_steps, tune, written

BLOCKS = "block long, n_docs int, n_words long, doc_ids binary, no_id binary, ends binary, words binary, codes binary"
U64 = np.uint64


@dataclass(frozen=True)
class BlockParams:
    block_words: int = 500_000
    bucket_bytes: int = 24_000_000
    #: keys in a row of an exchange, about
    row_keys: int = 256
    #: buckets per shuffle partition at least, so that buckets spread evenly over tasks
    spread: int = 4


def packed(a: np.ndarray, kind: str) -> bytes:
    import zstandard

    raw = np.ascontiguousarray(a.astype(kind))
    planes = raw.view(np.uint8).reshape(-1, raw.itemsize).T  # bytes of the same weight together
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(b: bytes, kind: str) -> np.ndarray:
    import zstandard

    d = zstandard.ZstdDecompressor().decompress(b)
    w = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(d, np.uint8).reshape(w, -1).T).view(kind).reshape(-1)


def mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of pairs (splitmix-style finalizer)."""
    with np.errstate(over="ignore"):
        x = a.astype(U64) * U64(0x9E3779B97F4A7C15) + (np.asarray(b).astype(U64) ^ U64(0xD6E8FEB86659FD93))
        x ^= x >> U64(32)
        x *= U64(0xD6E8FEB86659FD93)
        x ^= x >> U64(29)
        x *= U64(0xBF58476D1CE4E5B9)
        return x ^ (x >> U64(32))


@dataclass
class Block:
    block: int
    doc_ids: np.ndarray
    no_id: np.ndarray
    ends: np.ndarray  #: where each document's words end
    words: np.ndarray  #: hash of each distinct word
    codes: np.ndarray  #: distinct word of each word

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends)), np.diff(np.append(0, self.ends)))

    @staticmethod
    def of(row) -> Block:
        get = row.get if isinstance(row, dict) else row.__getitem__
        return Block(int(get("block")), unpacked(get("doc_ids"), "<i8"), unpacked(get("no_id"), "u1").astype(bool), unpacked(get("ends"), "<i8"), np.cumsum(unpacked(get("words"), "<u8"), dtype=U64), unpacked(get("codes"), "<u4").astype(np.int64))


def make_blocks(docs: DataFrame, name: str, params: BlockParams = BlockParams(), letters_and_digits: bool = False) -> tuple[DataFrame, str]:
    """Write the words of ``docs`` (doc_id, text) as blocks; returns the table and its path."""
    spark = tune(docs.sparkSession)
    size = params.block_words

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from pagesieve.llm._words import hashed_words

        seq, base = 0, TaskContext.get().partitionId() << 32
        held: list = []  # (doc ids, no id, words per document, places of the words' hashes)
        hashes: list = []
        known = total = 0  # hashes and words held

        def flush():
            nonlocal seq, held, hashes, known, total
            ids, no_id, n, places = (np.concatenate(x) for x in zip(*held))
            distinct, code = np.unique(np.concatenate(hashes), return_inverse=True)
            codes = code[places]
            used = np.zeros(len(distinct), dtype=bool)  # a step that spans two blocks brings words of both
            used[codes] = True
            codes = (np.cumsum(used) - 1)[codes]
            row = [[base + seq], [len(ids)], [len(codes)], [packed(ids, "<i8")], [packed(no_id, "u1")], [packed(np.cumsum(n), "<i8")], [packed(np.diff(distinct[used], prepend=U64(0)), "<u8")], [packed(codes, "<u4")]]
            seq, held, hashes, known, total = seq + 1, [], [], 0, 0
            types = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for b in small_steps(batches, ["text"]):
            doc, code, h = hashed_words(b.column(1), letters_and_digits)
            n = np.bincount(doc, minlength=b.num_rows)
            ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            no_id = b.column(0).is_null().to_numpy(zero_copy_only=False)
            ends, at, word_at, given = np.cumsum(n), 0, 0, False
            while at < b.num_rows:  # as many documents as fit into this block
                stop = max(at + 1, int(np.searchsorted(ends, word_at + size - total, side="right")))
                stop = min(stop, b.num_rows)
                if not given:
                    hashes.append(h)
                    given, start = True, known
                    known += len(h)
                held.append((ids[at:stop], no_id[at:stop], n[at:stop], code[word_at : ends[stop - 1]] + start))
                total += int(ends[stop - 1]) - word_at
                at, word_at = stop, int(ends[stop - 1])
                if total >= size or (at < b.num_rows and total + n[at] > size):
                    yield flush()
                    given = False
        if held:
            yield flush()

    path = new_path(spark, name)
    return written(docs.select("doc_id", "text").mapInArrow(pack, BLOCKS), path), path


ASKED = "bucket long, block long, keys binary, counts binary"


def corpus_counts(blocks: DataFrame, derive, n_keys: int, store, params: BlockParams = BlockParams()) -> DataFrame:
    """Corpus-wide counts of keys: rows (block, bucket, totals) aligned with the block's keys in order.

    ``derive(block row) -> (keys, counts)`` gives a block's distinct keys and their counts in it; ``n_keys`` is a bound
    of all blocks' keys together; ``store(df, name)`` writes a table that is read twice.
    """
    return _counted(blocks, derive, n_keys, n_buckets(blocks.sparkSession, n_keys, params), max(2, params.block_words // params.row_keys), store, params, 0)


def _counted(blocks, derive, n_keys: int, n: int, reach: int, store, params: BlockParams, level: int) -> DataFrame:
    """``n`` buckets are wanted; a block of this level can deal its keys to ``reach`` of them."""
    at_once = min(n, reach)

    def ask(batches):
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                keys, counts = derive(row)
                order, at = by_bucket(keys, at_once)
                keys, counts = keys[order], counts[order]
                some = np.flatnonzero(np.diff(at))
                for part in np.array_split(some, max(1, len(some) // 256)):
                    if len(part):
                        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([row["block"]] * len(part), pa.int64()), pa.array([packed(np.diff(keys[at[k] : at[k + 1]], prepend=U64(0)), "<u8") for k in part], pa.binary()), pa.array([packed(counts[at[k] : at[k + 1]], "<i8") for k in part], pa.binary())], names=["bucket", "block", "keys", "counts"])

    def merge(pdf):
        """Distinct keys of some rows, their summed counts, and for each row the places of its keys among them."""
        keys = [np.cumsum(unpacked(k, "<u8"), dtype=U64) for k in pdf["keys"]]
        ends = np.cumsum([len(k) for k in keys])
        distinct, inv = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(inv, np.concatenate([unpacked(c, "<i8") for c in pdf["counts"]]).astype(float), minlength=len(distinct)).astype(np.int64)
        return distinct, sums, np.split(inv, ends[:-1])

    def answer(pdf, totals, places):
        import pandas as pd

        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "totals": [packed(totals[i], "<i8") for i in places]})

    def total(key, pdf):
        _, sums, places = merge(pdf)
        return answer(pdf, sums, places)

    answers = "block long, bucket long, totals binary"
    asked = blocks.mapInArrow(ask, ASKED)
    if at_once == n:
        return asked.groupBy("bucket").applyInPandas(total, answers)

    # more buckets are wanted than a block deals to: chunks of each bucket are the blocks of the next level
    chunks = int(max(1, -(-n_keys * 8 // (at_once * params.bucket_bytes))))
    asked = store(asked.withColumn("chunk", F.col("bucket") * chunks + F.pmod(F.xxhash64("block"), F.lit(chunks))), f"asked{level}")

    def gather(key, pdf):
        import pandas as pd

        distinct, sums, _ = merge(pdf)
        return pd.DataFrame({"block": [key[0]], "keys": [packed(np.diff(distinct, prepend=U64(0)), "<u8")], "counts": [packed(sums, "<i8")]})

    def again(row):
        return np.cumsum(unpacked(row["keys"], "<u8"), dtype=U64), unpacked(row["counts"], "<i8")

    def give_back(key, left, right):
        if not len(left):
            return answer(left, None, [])
        distinct, _, places = merge(left)
        return answer(left, totals_of(distinct, right), places)

    merged = store(asked.groupBy("chunk").applyInPandas(gather, "block long, keys binary, counts binary"), f"merged{level}")
    found = _counted(merged, again, n_keys, n, at_once * max(2, params.block_words // params.row_keys), store, params, level + 1)
    return asked.groupBy("chunk").cogroup(found.withColumnRenamed("block", "chunk").groupBy("chunk")).applyInPandas(give_back, answers)


def n_buckets(spark, n_keys: int, params: BlockParams) -> int:
    return int(max(params.spread * partitions(spark), -(-n_keys * 8 // params.bucket_bytes)))


def by_bucket(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys by (bucket, key), and where each bucket begins."""
    bucket = ((keys >> U64(32)) * U64(n)) >> U64(32)
    order = np.argsort(keys, kind="stable")  # buckets are ranges of the hash, so this orders by bucket as well
    at = np.searchsorted(bucket[order], np.arange(n + 1, dtype=U64))
    return order, at


def totals_of(keys: np.ndarray, answers) -> np.ndarray:
    """Totals aligned with ``keys``, from all rows that ``corpus_counts`` has for their block."""
    out = np.zeros(len(keys), dtype=np.int64)
    parts = [unpacked(t, "<i8") for _, t in sorted(zip(answers["bucket"], answers["totals"]))]
    out[np.argsort(keys, kind="stable")] = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return out


def total_words(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("n_words")).first()[0] or 0
