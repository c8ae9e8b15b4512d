"""Words of a batch of texts as integer codes, by Arrow's vectorised string functions."""

from __future__ import annotations

import numpy as np


def letter_words(texts) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(document index of each word, code of each word, the words by code); words are runs of letters, in lower case."""
    return _split(texts, r"[^\p{L}]+")


def alnum_words(texts) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As ``letter_words``, but words are runs of letters and digits."""
    return _split(texts, r"[^\p{L}\p{N}]+")


def space_words(texts) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """As ``letter_words``, but words are runs of anything but ASCII white space."""
    return _split(texts, None)


def hashed_words(texts, digits_and_letters: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index of each word, code of each word, 64-bit hash by code), without making Python strings."""
    pattern = r"[^\p{L}\p{N}]+" if digits_and_letters else None
    doc, codes, words = _coded(texts, pattern)
    return doc, codes, hash_strings(words)


def hash_strings(words) -> np.ndarray:
    """64-bit hashes of an Arrow array of large strings: a polynomial in the bytes modulo 2**64, then mixed with the length."""
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], np.int64, n + 1, words.offset * 8)
    begin, end = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(words.buffers()[2], np.uint8, end - begin, begin) if end > begin else np.zeros(0, np.uint8)
    at = offsets - begin
    with np.errstate(over="ignore"):
        power = np.full(len(data) + 1, BASE, dtype=np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
        back = np.full(len(data) + 1, INVERSE, dtype=np.uint64)
        back[0] = 1
        back = np.multiply.accumulate(back)
        h = (total[at[1:]] - total[at[:-1]]) * back[at[:-1]]
        h ^= np.diff(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


#: An odd number and its inverse modulo 2**64.
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)


def _split(texts, pattern):
    doc, codes, words = _coded(texts, pattern)
    return doc, codes, words.to_pylist()


def _coded(texts, pattern):
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    lists = pc.ascii_split_whitespace(texts) if pattern is None else pc.split_pattern_regex(texts, pattern)
    doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(lists).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    empty = np.flatnonzero(pc.binary_length(words).to_numpy(zero_copy_only=False) == 0)
    if len(empty):
        keep = codes != empty[0]
        doc, codes = doc[keep], codes[keep]
    return doc.astype(np.int64), codes.astype(np.int64), words
