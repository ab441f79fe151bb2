"""Word and shingle hashes of a batch of texts, as flat NumPy arrays with bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .tokens import plain_texts

K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the result."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text (runs of other than ASCII white space, A-Z lower-cased) and the texts' bounds."""
    clean = pc.ascii_lower(plain_texts(texts))
    split = pc.ascii_split_whitespace(clean)
    flat = split.flatten()
    owner = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(flat)
    words = coded.dictionary.to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy()
    values = pd.util.hash_array(words, categorize=False).astype(np.uint64) if len(words) else np.zeros(0, np.uint64)
    if len(words):  # a text that begins or ends with white space gives empty words there
        real = (words != "")[codes]
        codes, owner = codes[real], owner[real]
    return values[codes], np.searchsorted(owner, np.arange(len(texts) + 1))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, as if the array were one text."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for j in range(n):
        out += words[j : len(words) - n + 1 + j] * K[j]
    return mix(out + np.uint64(n))


def shingle_sets(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and the texts' bounds: n words each; of a text with fewer words,
    the whole sequence is its one shingle; a wordless text has none."""
    words, bounds = word_hashes(texts)
    grams = gram_hashes(words, n)
    out, sizes = [], np.zeros(len(texts), np.int64)
    for i in range(len(texts)):
        a, z = int(bounds[i]), int(bounds[i + 1])
        if z - a >= n:
            own = grams[a : z - n + 1].copy()
            own.sort()
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif z > a:
            own = gram_hashes(words[a:z], z - a)
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])
