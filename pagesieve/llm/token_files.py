"""Token ids as binary files: documents compressed one by one with a shared zstandard dictionary.

Layout of a folder that ``write_token_files`` makes:

* ``dictionary.zdict``: the shared dictionary, trained on serialized id arrays;
* ``shard-NNNNNN.tok``: documents in ascending doc_id order, each a zstandard frame of its ids (little-endian, 2 bytes
  an id if the vocabulary allows it, else 4), then the offset index: doc ids (int64), their presence (uint8), offsets
  (uint64, one more than documents) and token counts (uint64), then a trailer;
* the trailer: index offset, documents (uint64 each), bytes an id (uint32), version (uint32), SHA-256 of the dictionary
  (32 bytes) and the magic ``PSTOKEN1``.

A document is read by two ranges of its shard: the index, then its frame (``read_document``). Shards are ranges of
(doc_id, hash of the text), one for each partition of a range exchange, so no task holds more than a partition, however
many rows have one id or none. A task writes its shard under a name of its own and moves it into place; a task that
runs again after a lost executor writes the same bytes again.

Encoding calls the tokenizer library on each distinct chunk of non-space characters once and repeats its ids. The
pre-tokenizer of the file in use drops white space and no rule, added token or normalizer step of it reaches across
ASCII white space, so the ids equal those of the whole text; ``words_are_independent`` checks these properties of the
tokenizer file, and other tokenizers encode whole texts.

Cases: a null text is empty (only the end id); null ids come first, and equal ids are ordered by a hash of their text; an empty table
gives no shard and an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.llm._common import bounded_sample, filesystem, new_path, partitions, read_file, small_steps, tune, write_file
from pagesieve.llm.token_counts import load_tokenizer

#: A Latin letter that stays one letter in normal form and in lower case, then an ASCII punctuation mark.
LETTER_MARK = "([A-Za-zÀ-ÖØ-öø-įı-ɏ])([!-/:-@\\[-`{-~])"
MAGIC, VERSION = b"PSTOKEN1", 1
TRAILER = "<QQII32s8s"


@dataclass(frozen=True)
class TokenFileParams:
    end_id: int = 1
    level: int = 1
    dictionary_bytes: int = 64 * 1024
    #: texts that the dictionary is trained on, and pieces of each text's ids that are taken, spread over the whole
    dictionary_texts: int = 2_000
    pieces: int = 8
    piece_bytes: int = 1_024
    #: distinct chunks whose ids a Python worker remembers
    remembered: int = 600_000


def words_are_independent(tokenizer) -> bool:
    """Whether ids of a text are the ids of its ASCII-space-separated chunks, by the tokenizer's own description."""
    d = json.loads(tokenizer.to_str())
    split = (d.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
    known = {"NFC", "Lowercase", "Replace"}
    steps = (d.get("normalizer") or {}).get("normalizers", [])
    return (
        split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and bool(split.get("invert"))
        and "[^\\s" in split.get("pattern", {}).get("Regex", "")
        and all(s["type"] in known and (s["type"] != "Replace" or s["pattern"] == {"Regex": "\\s+"} and s["content"] == " ") for s in steps)
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in d.get("added_tokens", []))
        and d.get("post_processor") is None
    )


class Encoder:
    """Ids of many texts: (ids of all texts, where each text's ids end).

    For tokenizers whose words are independent, a space is put between a Latin letter and a following ASCII
    punctuation mark (always a pre-token boundary of the patterns in question; white space is dropped), texts are cut into chunks
    at ASCII white space, and each distinct chunk is encoded once. New chunks are encoded many at a time with a mark
    between them. Texts that might hold an added token are encoded whole.
    """

    MARK = "~"

    def __init__(self, path: str, remembered: int):
        self.tok, self.remembered = load_tokenizer(path), remembered
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        added = [t["content"] for t in json.loads(self.tok.to_str()).get("added_tokens", [])]
        mark = self.tok.encode(self.MARK, add_special_tokens=False).ids
        self.by_word = words_are_independent(self.tok) and len(mark) == 1 and all(t.startswith("<|") for t in added)
        self.lowers = any(x["type"] == "Lowercase" for x in (json.loads(self.tok.to_str()).get("normalizer") or {}).get("normalizers", []))
        self.mark = mark[0] if len(mark) == 1 else -1
        self.forget()

    def forget(self):
        self.at: dict[str, int] = {}
        self.sizes, self.starts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, new: list[str]) -> None:
        plain = [w for w in new if self.MARK not in w]
        other = [w for w in new if self.MARK in w]
        sizes, ids, learned = [], [], []
        groups = [plain[a : a + 100] for a in range(0, len(plain), 100)]
        for a in range(0, len(groups), 50):
            part = groups[a : a + 50]
            for g, e in zip(part, self.tok.encode_batch_fast([f" {self.MARK} ".join(g) for g in part], add_special_tokens=False)):
                x = np.array(e.ids, dtype=np.uint32)
                cut = np.flatnonzero(x == self.mark)
                if len(cut) != len(g) - 1:  # a chunk took the mark in: encode these one by one
                    other += g
                    continue
                learned += g
                sizes.append(np.diff(np.concatenate([[-1], cut, [len(x)]])) - 1)
                ids.append(x[x != self.mark])
        for w in other:
            x = np.array(self.tok.encode(w, add_special_tokens=False).ids, dtype=np.uint32)
            sizes.append(np.array([len(x)]))
            ids.append(x)
        for w in (*learned, *other):
            self.at[w] = len(self.at)
        if sizes:
            self.sizes = np.concatenate([self.sizes, *sizes])
            self.ids = np.concatenate([self.ids, *ids])
            self.starts = np.cumsum(self.sizes) - self.sizes

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        n = len(texts)
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False) if self.by_word and n else np.ones(n, bool)
        if special.any():
            got = [np.zeros(0, np.uint32)] * n
            for i, x in zip(np.flatnonzero(special), self.whole(texts.filter(pa.array(special)).to_pylist())):
                got[i] = x
            if not special.all():
                ids, ends = self(texts.filter(pa.array(~special)))
                for i, a, e in zip(np.flatnonzero(~special), np.append(0, ends[:-1]), ends):
                    got[i] = ids[a:e]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.cumsum([len(x) for x in got]).astype(np.int64)
        spaced = pc.replace_substring_regex(texts, LETTER_MARK, r"\1 \2")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(spaced) if self.lowers else spaced)
        doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(lists).dictionary_encode()
        codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        if len(self.at) > self.remembered:
            self.forget()
        self.learn([w for w in words if w not in self.at])
        known = np.fromiter(map(self.at.__getitem__, words), dtype=np.int64, count=len(words))
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        at = known[codes]
        k = self.sizes[at]
        where = np.repeat(self.starts[at] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        return self.ids[where], np.cumsum(np.bincount(doc, weights=k, minlength=n).astype(np.int64))


def encoder(path: str, remembered: int) -> Encoder:
    """One encoder per Python worker: what it has learned serves the worker's later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, remembered)
    return _ENCODERS[path]


_ENCODERS: dict[str, Encoder] = {}


def train_dictionary(docs: DataFrame, tokenizer_path: str, p: TokenFileParams) -> bytes:
    """A zstandard dictionary from pieces of at most ``dictionary_texts`` texts' serialized ids (else empty)."""
    import zstandard

    def pieces(batches):
        import pyarrow as pa

        enc = encoder(tokenizer_path, p.remembered)
        for b in small_steps(batches, ["text"]):
            ids, ends = enc(b.column(0))
            for a, e in zip(np.append(0, ends[:-1]), ends):
                raw = ids[a:e].astype(f"<u{enc.width}").tobytes()
                step = max(p.piece_bytes, len(raw) // p.pieces // enc.width * enc.width)
                out = [raw[i : i + p.piece_bytes] for i in range(0, len(raw), step)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["raw"])

    sample = bounded_sample(docs.select("doc_id", "text"), p.dictionary_texts, "doc_id").select("text").coalesce(8)
    raws = sorted(r["raw"] for r in sample.mapInArrow(pieces, "raw binary").collect())
    raws = [bytes(r) for r in raws]
    try:
        return zstandard.train_dictionary(p.dictionary_bytes, raws, level=p.level).as_bytes() if len(raws) >= 16 else b""
    except zstandard.ZstdError:  # too little to learn from
        return b""


def write_token_files(docs: DataFrame, out: str, tokenizer_path: str, params: TokenFileParams = TokenFileParams()) -> list[tuple[str, int, int]]:
    """Write ``docs`` (doc_id, text) to the folder ``out``; returns (file, documents, tokens) of each shard, in order."""
    spark = tune(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, tokenizer_path, params)
    write_file(f"{out}/dictionary.zdict", [dictionary])
    digest = hashlib.sha256(dictionary).digest()
    n_shards = max(partitions(spark), docs.rdd.getNumPartitions())

    def shard(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        enc = encoder(tokenizer_path, params.remembered)
        zd = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        z = zstandard.ZstdCompressor(level=params.level, dict_data=zd, write_checksum=False)
        ids_of, present, sizes, counts = [], [], [], []

        def frames():
            for b in small_steps(batches, ["text"]):
                ids, ends = enc(b.column(1))
                known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
                ids_of.append(b.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                present.append(known.astype(np.uint8))
                for a, e in zip(np.append(0, ends[:-1]), ends):
                    frame = z.compress(np.append(ids[a:e], params.end_id).astype(f"<u{enc.width}").tobytes())
                    sizes.append(len(frame))
                    counts.append(int(e - a) + 1)
                    yield frame
            if counts:
                yield np.concatenate(ids_of).astype("<i8").tobytes()
                yield np.concatenate(present).tobytes()
                yield np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes()
                yield np.array(counts, dtype="<u8").tobytes()
                yield struct.pack(TRAILER, sum(sizes), len(counts), enc.width, VERSION, digest, MAGIC)

        chunks = frames()
        first = next(chunks, None)
        if first is not None:
            name = f"shard-{TaskContext.get().partitionId():06d}.tok"

            def everything():
                yield first
                yield from chunks

            write_file(f"{out}/{name}", everything())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(counts)], pa.int64()), pa.array([sum(counts)], pa.int64())], names=["name", "docs", "tokens"])

    # ranges of (id, hash of the text): rows that share an id, or have none, spread over shards as others do
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("__text")]
    ranged = docs.withColumn("__text", F.xxhash64("text")).repartitionByRange(n_shards, *order).sortWithinPartitions(*order).drop("__text")
    return sorted((r["name"], r["docs"], r["tokens"]) for r in ranged.mapInArrow(shard, "name string, docs long, tokens long").collect())


class TokenShard:
    """A shard's index and its documents."""

    def __init__(self, data: bytes, dictionary: bytes):
        import zstandard

        at, n, self.width, version, digest, magic = struct.unpack(TRAILER, data[-struct.calcsize(TRAILER) :])
        if magic != MAGIC or version != VERSION or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token shard of this dictionary")
        self.data = data
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.present = np.frombuffer(data, np.uint8, n, at + 8 * n).astype(bool)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 9 * n)
        self.counts = np.frombuffer(data, "<u8", n, at + 9 * n + 8 * (n + 1))
        self.z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, i: int) -> np.ndarray:
        raw = self.z.decompress(self.data[int(self.offsets[i]) : int(self.offsets[i + 1])], max_output_size=int(self.counts[i]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def read_document(folder: str, shards: list[str], doc_id: int) -> np.ndarray | None:
    """Ids of one document: reads trailers and indexes, and of the right shard one frame."""
    import zstandard

    dictionary = read_file(f"{folder}/dictionary.zdict")
    for name in shards:
        fs, path = filesystem(f"{folder}/{name}")
        with fs.open_input_file(path) as f:
            end = f.size()
            at, n, width, _, digest, _ = struct.unpack(TRAILER, f.read_at(struct.calcsize(TRAILER), end - struct.calcsize(TRAILER)))
            ids = np.frombuffer(f.read_at(8 * n, at), "<i8")
            i = int(np.searchsorted(ids, doc_id))
            if i < n and ids[i] == doc_id:
                if digest != hashlib.sha256(dictionary).digest():
                    raise ValueError("the dictionary is another one")
                a, b = np.frombuffer(f.read_at(16, at + 9 * n + 8 * i), "<u8")
                z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
                return np.frombuffer(z.decompress(f.read_at(int(b - a), int(a))), f"<u{width}").astype("<u4")
    return None


def read_token_files(spark: SparkSession, folder: str, shards: list[tuple[str, int, int]], with_ids: bool = False) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens, ids_crc32 (and ids, if asked for)."""
    tune(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    if not shards:
        return spark.createDataFrame([], schema)
    names = [s[0] for s in shards]
    base = np.concatenate([[0], np.cumsum([s[2] for s in shards])]).astype(np.int64)  # one number per file

    def read(batches):
        import pyarrow as pa

        dictionary = read_file(f"{folder}/dictionary.zdict")
        for b in batches:
            for s in b.column(0).to_pylist():
                shard = TokenShard(read_file(f"{folder}/{names[s]}"), dictionary)
                start = base[s] + np.concatenate([[0], np.cumsum(shard.counts.astype(np.int64))])
                for a in range(0, len(shard.counts), 2000):
                    e = min(a + 2000, len(shard.counts))
                    ids = [shard.ids(i) for i in range(a, e)]
                    cols = [pa.array(shard.doc_ids[a:e], pa.int64(), mask=~shard.present[a:e]), pa.array(start[a:e]), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                    if with_ids:
                        cols.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return spark.range(0, len(names), 1, len(names)).mapInArrow(read, schema)


def op1_token_files(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = new_path(spark, "token-files")
    shards = write_token_files(docs, out, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, out, shards)
