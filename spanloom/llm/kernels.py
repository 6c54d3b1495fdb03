"""Vectorised word and shingle kernels over Arrow arrays, for the operators that run in Python workers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
SHINGLE = 5


def split_words(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets (one more than texts) and the flat words ``[^\\x20\\x09-\\x0D]+``; null and blank texts have none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(texts)
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    flat = lists.flatten()
    blank = pc.equal(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    if blank.any():
        counts[blank] = 0
        flat = flat.filter(pc.not_equal(flat, ""))
    return np.concatenate([[0], np.cumsum(counts)]), flat


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(flat: pa.Array) -> np.ndarray:
    """64-bit hash of every word; each distinct word of the batch is hashed once."""
    coded = flat.dictionary_encode()
    distinct = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return distinct[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each place (the last k - 1 places of the array have none)."""
    n = max(0, len(words) - k + 1)
    total = np.zeros(n, np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            factor = factor * _MUL | np.uint64(1)
            total += words[j : j + n] * factor
        return mix(total)


def doc_grams(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of every k-gram that lies inside one document, in order."""
    grams = gram_hashes(words, k)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(grams)]
    inside = np.arange(len(grams)) + k <= offsets[1:][doc]
    return doc[inside], grams[inside]


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, sorted distinct shingle hashes of each text). A text of 1 to k - 1 words is one shingle; an empty one has none."""
    offsets, flat = split_words(texts)
    words = word_hashes(flat)
    doc, grams = doc_grams(words, offsets, k)
    sizes = np.diff(offsets)
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        extra = np.array([xxhash.xxh3_64_intdigest(words[offsets[i] : offsets[i + 1]].tobytes()) for i in short], np.uint64)
        doc, grams = np.concatenate([doc, short]), np.concatenate([grams, extra])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    if len(doc):
        first = np.ones(len(doc), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
        doc, grams = doc[first], grams[first]
    return np.searchsorted(doc, np.arange(len(offsets))), grams
