"""Vectorised word-shingle hashing over Arrow string buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, found on the UTF-8 bytes
(both rules are ASCII only, so bytes and characters give the same words).  A
batch is hashed in slices of about a megabyte, so memory does not depend on the
batch size; one very long text is one slice.

Every hash is 64 bits wide.  A document's set is compared only with another
document's set, so a wrong answer needs a collision between two sets of a few
thousand shingles, not one among all shingles of the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
SLICE_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(1, 2**63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        have = np.empty(max(n, SLICE_BYTES * 2), dtype=np.uint64)
        have[0] = 1
        have[1:] = np.uint64(base)
        np.multiply.accumulate(have, out=have)
        _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) of about ``most`` bytes; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        end = min(end, len(texts))
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and the word index at which each row starts (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    word = ~_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    cut = at[:-1][at[:-1] < n]
    start[cut] = word[cut]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(at), dtype=np.int64)
    value = _BYTE[data] * _power("up", _BASE, n)
    words = np.add.reduceat(value, starts) * _power("down", _BASE_INVERSE, n)[starts]
    return mix(words), np.searchsorted(starts, at)


def shingle_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle in order (repeats included) and the index at which each row's begin."""
    n, rows = len(words), len(first) - 1
    counts = np.diff(first)
    places = np.where(counts >= SHINGLE_WORDS, counts - SHINGLE_WORDS + 1, (counts > 0).astype(np.int64))
    begins = np.concatenate([[0], np.cumsum(places)])
    if not n:
        return np.zeros(0, dtype=np.uint64), begins
    padded = np.concatenate([words, np.zeros(SHINGLE_WORDS, dtype=np.uint64)])
    whole = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE_WORDS):
        whole += padded[k : k + n] * _PLACE[k]
    # A row of under five words is one shingle: only its own words count.
    for r in np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS)):
        own = words[first[r] : first[r + 1]]
        whole[first[r]] = (own * _PLACE[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    row_of = np.repeat(np.arange(rows), places)
    index = np.arange(begins[-1]) - begins[row_of] + first[row_of]
    return mix(whole[index]), begins


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its sorted distinct shingle hashes) for every row."""
    for row, _, data, at in text_slices(texts):
        hashes, begins = shingle_hashes(*word_hashes(data, at))
        for k in range(len(begins) - 1):
            yield row + k, np.unique(hashes[begins[k] : begins[k + 1]])


def min_sketches(hashes: np.ndarray, begins: np.ndarray, size: int, seed: int) -> np.ndarray:
    """rows x size minwise values (32 bits); rows without shingles hold the largest value."""
    factor = np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.full((len(begins) - 1, size), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(begins))
    if len(full):
        at = begins[:-1][full]
        for k in range(size):
            out[full, k] = np.minimum.reduceat(hashes * factor[k], at) >> np.uint64(32)
    return out


def set_digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(np.ascontiguousarray(values).tobytes(), digest_size=16).digest()
