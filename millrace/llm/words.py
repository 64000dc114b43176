"""Hashed words and word shingles of texts, as ragged numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from millrace.llm import batches

# Multipliers of a shingle's places: odd numbers from a fixed seed.
PLACES = np.random.default_rng(7).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all others."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, A-Z in lower case, and where each text's begin. Words end at ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten().dictionary_encode()
    distinct = flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    some = np.array([bool(w) for w in distinct], bool)  # an edge of white space gives an empty word
    at = flat.indices.to_numpy(zero_copy_only=False)
    offsets = batches.offsets_of(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    if len(distinct) and not some.all():
        real = some[at]
        return hashes[at[real]], batches.offsets_of(batches.sums(real, offsets))
    return hashes[at] if len(distinct) else hashes, offsets


def window_hashes(words: np.ndarray, places: list[int]) -> np.ndarray:
    """A hash of the words at some places of a window, for every window of the array."""
    n = len(words) - max(places)
    if n <= 0:
        return words[:0]
    out = np.zeros(n, np.uint64)
    for p in places:
        out += words[p:p + n] * PLACES[p]
    return mixed(out)


def shingle_sets(texts: pa.StringArray, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles of ``size`` words; of fewer words, all of them as one."""
    words, offsets = word_hashes(texts)
    shingles, out = window_hashes(words, list(range(size))), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(shingles[a:b - size + 1]))
        elif b > a:
            n = np.uint64(b - a)
            out.append(mixed((words[a:b] * PLACES[size:size + b - a]).sum(keepdims=True) + n))
        else:
            out.append(words[:0])
    return out
