"""Words and word shingles of Arrow batches of texts, as 64-bit hashes in numpy arrays."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

EDGES = re.compile(r"^\W+|\W+$")


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words end to end, and each text's number of words.

    A word is a run without white space, in lower case, without other than letters, digits and _
    at its ends; what has none of these is no word. A null text has none.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    sizes = pc.list_value_length(parts).to_numpy().astype(np.int64)
    flat = pc.list_flatten(parts)
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    coded = flat.dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    bare = [w if w.isalnum() else EDGES.sub("", w) for w in coded.dictionary.to_pylist()]
    hashes = pd.util.hash_array(np.array(bare, dtype=object), categorize=False)
    real = np.array([bool(w) for w in bare])
    codes = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), sizes)
    kept = real[codes]
    return hashes[codes[kept]], np.bincount(owner[kept], minlength=len(texts)).astype(np.int64)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and each text's number of them; a shorter text with words has one."""
    n = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    ends = np.cumsum(counts)
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.uint64), n
    shift = np.repeat((ends - counts) - (np.cumsum(n) - n), n)
    at = np.arange(total) + shift
    limit = np.repeat(ends, n)
    acc = np.zeros(total, np.uint64)
    short = bool((counts[counts > 0] < size).any())
    for j in range(size):
        w = words[np.minimum(at + j, len(words) - 1)]
        if short:
            w = np.where(at + j < limit, w, np.uint64(0))
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + w
        acc ^= acc >> np.uint64(31)
    acc *= np.uint64(0xBF58476D1CE4E5B9)
    acc ^= acc >> np.uint64(29)
    return acc, n
