"""Token counts of whole texts by overlap resynchronisation.

A text of more than ``chunk_chars`` characters (a page or two) is encoded in overlapping chunks with offsets. Two
neighbouring encodings are spliced at a boundary that both have and that is proven stable: a space, tab or line end
after a character that is no white space. No pre-token of the byte-level pattern reaches across such a place (white
space occurs in it only at its front, or it is white space only), and no added token holds white space, so the tokens
before and after are those of the whole text. Where an overlap holds no such boundary it is doubled, at most up to the
rest of the text; so the count is that of the library on the whole text in every case.

Texts within one chunk are cut at the same boundaries, all of them, and each distinct piece is counted once per worker.
Both need a tokenizer of that kind (``PieceCounter.fits``); others encode whole texts.

One Arrow pass without a shuffle; peak memory is a batch of texts and its tokens.

Cases: a null text counts as empty (0 tokens, 0 bytes); null and repeated ids are kept row by row; an empty table gives
an empty result; other columns pass through, and those named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesieve.llm._common import tune, with_columns_from_arrow


@dataclass(frozen=True)
class TokenCountParams:
    chunk_chars: int = 4_000
    overlap_chars: int = 200
    limit: int = 512


def load_tokenizer(path: str):
    """A tokenizer of the tokenizers library (.json) or of sentencepiece (.model), once per Python worker."""
    import os

    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_padding()
            t.no_truncation()
            _LOADED[path] = t
    return _LOADED[path]


_LOADED: dict = {}


#: A character that is no white space, then white space: the tokens before and after don't depend on each other.
BOUNDARY = r"([^\s\p{Z}\x0b\x85\x1c-\x1f])([ \t\n\r])"
CUT = "\x00"


class PieceCounter:
    """Token counts of texts from their distinct pieces, for byte-level tokenizers whose pre-tokens end at white space.

    A text is cut at all stable boundaries; each distinct piece is given to the library once per worker. Pieces of one
    space and other characters are encoded many at a time: each has exactly one token that begins with a space.
    """

    def __init__(self, tokenizer, remembered: int = 600_000):
        import json

        self.tok, self.remembered, self.known = tokenizer, remembered, {}
        d = json.loads(tokenizer.to_str())
        pre = d.get("pre_tokenizer") or {}
        added = d.get("added_tokens", [])
        self.fits = (
            d.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre.get("add_prefix_space") and d.get("post_processor") is None
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in added)
        )
        vocab = tokenizer.get_vocab(with_added_tokens=False)
        self.starts = np.zeros(max([*tokenizer.get_vocab(with_added_tokens=True).values(), 0]) + 1, dtype=bool)
        self.starts[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True

    def learn(self, new: list[str]) -> None:
        simple = [w for w in new if w[0] == " " and not any(c.isspace() for c in w[1:]) and len(w) > 1 and "<|" not in w]
        taken = set(simple)
        other = [w for w in new if w not in taken]
        groups = [simple[a : a + 200] for a in range(0, len(simple), 200)]
        for a in range(0, len(groups), 50):
            part = groups[a : a + 50]
            for g, e in zip(part, self.tok.encode_batch_fast(["".join(g) for g in part], add_special_tokens=False)):
                at = np.flatnonzero(self.starts[np.array(e.ids, dtype=np.int64)])
                if len(at) == len(g):
                    self.known.update(zip(g, np.diff(np.append(at, len(e.ids))).tolist()))
                else:  # a tokenizer with other tokens that begin with a space
                    other += g
        for a in range(0, len(other), 10_000):
            self.known.update(zip(other[a : a + 10_000], map(len, self.tok.encode_batch_fast(other[a : a + 10_000], add_special_tokens=False))))

    def __call__(self, texts) -> np.ndarray:
        """Counts of an Arrow array of texts without nulls and without the cutting character."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.known) > self.remembered:
            self.known.clear()
        lists = pc.split_pattern(pc.replace_substring_regex(texts.cast(pa.large_string()), BOUNDARY, "\\1" + CUT + "\\2"), CUT)
        doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(lists).dictionary_encode()
        codes, pieces = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        self.learn([w for w in pieces if w and w not in self.known])
        n = np.fromiter((self.known[w] if w else 0 for w in pieces), dtype=np.int64, count=len(pieces))
        return np.bincount(doc, n[codes], minlength=len(texts)).astype(np.int64)


def piece_counter(path: str) -> PieceCounter:
    """One counter per Python worker: what it has learned serves the worker's later tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(load_tokenizer(path))
    return _COUNTERS[path]


_COUNTERS: dict[str, PieceCounter] = {}


def stable(text: str, at: int) -> bool:
    """A place that no pre-token spans: ``BOUNDARY`` in Python's terms (its white space holds all of the pattern's)."""
    return 0 < at < len(text) and text[at] in " \t\n\r" and not text[at - 1].isspace()


def begins(encoding, at: int) -> int | None:
    """The index of the token that begins with the character ``at``."""
    token = encoding.char_to_token(at)
    return token if token is not None and encoding.token_to_chars(token)[0] == at else None


def splice(text: str, left, left_at: int, right, right_at: int, begin: int, stop: int) -> tuple[int, int, int] | None:
    """(place, tokens of ``left`` before it, tokens of ``right`` before it) of the last common stable boundary in begin..stop."""
    for at in range(stop - 1, begin, -1):
        if stable(text, at):
            a, b = begins(left, at - left_at), begins(right, at - right_at)
            if a is not None and b is not None:
                return at, a, b
    return None


def count_chunked(tokenizer, texts: list[str], chunk: int, overlap: int) -> tuple[list[int], int, int]:
    """Tokens of each text from overlapping chunks, all chunks encoded together; splices made; texts whose overlap was widened."""
    pieces, of = [], []
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - overlap), chunk):
            pieces.append(t[a : a + chunk + overlap])
            of.append((i, a))
    encoded = tokenizer.encode_batch(pieces, add_special_tokens=False)
    total, failed, splices = [0] * len(texts), set(), 0
    skip = 0  # tokens of the present chunk that belong to the one before
    for k, (i, a) in enumerate(of):
        if a == 0:
            skip = 0
        if i in failed:
            continue
        if k + 1 == len(of) or of[k + 1][0] != i:
            total[i] += len(encoded[k]) - skip
            continue
        b = of[k + 1][1]
        found = splice(texts[i], encoded[k], a, encoded[k + 1], b, b, a + len(pieces[k]))
        if found is None:
            failed.add(i)
            total[i] = count_spliced(tokenizer, texts[i], chunk, 2 * overlap)
        else:
            splices += 1
            total[i] += found[1] - skip
            skip = found[2]
    return total, splices, len(failed)


def count_spliced(tokenizer, text: str, chunk: int, overlap: int) -> int:
    """Tokens of one text, chunk by chunk; where an overlap holds no common stable boundary it is doubled."""
    total, start, n = 0, 0, len(text)
    cut = 0  # tokens before this place are counted
    while True:
        stop, own = min(n, start + chunk), overlap
        left = tokenizer.encode(text[start:stop], add_special_tokens=False)
        before = begins(left, cut - start) if cut > start else 0
        if stop == n:
            return total + len(left) - before
        while True:
            begin = max(start + 1, stop - own)
            if begin <= max(start + 1, cut):  # the chunk holds no boundary: take a longer one instead
                chunk *= 2
                break
            right = tokenizer.encode(text[begin : min(n, stop + own)], add_special_tokens=False)
            found = splice(text, left, start, right, begin, begin, stop)
            if found is not None:
                total += found[1] - before
                start, cut = begin, found[0]
                break
            own *= 2


def count_tokens(docs: DataFrame, tokenizer_path: str, params: TokenCountParams = TokenCountParams(), keep: list[str] | None = None) -> DataFrame:
    """Append n_bytes, n_tokens and over_limit to ``docs`` (text)."""
    tune(docs.sparkSession)

    def fn(cols):
        import pyarrow as pa
        import pyarrow.compute as pc

        filled = pc.fill_null(cols["text"], "")
        n = np.zeros(len(filled), dtype=np.int64)
        if tokenizer_path.endswith(".model"):
            tok = load_tokenizer(tokenizer_path)
            n[:] = [len(tok.encode(t)) for t in filled.to_pylist()]
        else:
            counter = piece_counter(tokenizer_path)
            long = pc.greater(pc.utf8_length(filled), params.chunk_chars).to_numpy(zero_copy_only=False) if counter.fits else np.zeros(len(n), bool)
            whole = ~long & (pc.match_substring(filled, CUT).to_numpy(zero_copy_only=False) if counter.fits else True)
            plain = ~long & ~whole
            if plain.any():
                n[plain] = counter(filled.filter(pa.array(plain)))
            if whole.any():
                n[whole] = [len(e) for e in counter.tok.encode_batch_fast(filled.filter(pa.array(whole)).to_pylist(), add_special_tokens=False)]
            at, size = np.flatnonzero(long), pc.utf8_length(filled).to_numpy(zero_copy_only=False)
            while len(at):  # some texts at once, so that their tokens stay few
                k = max(1, int(np.searchsorted(np.cumsum(size[at]), 1_000_000, side="right")))
                n[at[:k]] = count_chunked(counter.tok, [filled[int(i)].as_py() for i in at[:k]], params.chunk_chars, params.overlap_chars)[0]
                at = at[k:]
        n_bytes = pc.fill_null(pc.binary_length(cols["text"]), 0).cast(pa.int64())
        return [n_bytes, pa.array(n, pa.int64()), pa.array(n > params.limit, pa.bool_())]

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return with_columns_from_arrow(docs, fn, ["text"], fields, keep)


def op7_token_counts(spark, sf_dir):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"]).select("doc_id", "n_bytes", "n_tokens", "over_limit")
