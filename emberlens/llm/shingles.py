"""Vectorised hashing of word shingles, many texts at a time.

A word is a run of anything but blanks (space, tab to carriage return) with A-Z lower-cased; a
shingle is ``width`` words in a row, and a text with fewer words, but some, is one shingle. Shingles
are known by a 64-bit hash: polynomial hashes of the words, mixed, then a polynomial of those. Words
of more than LONG_WORD bytes are hashed by BLAKE2, as polynomials modulo 2**64 fall together on some
pairs of strings from 1024 bytes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

BATCH_BYTES, LONG_WORD = 500_000, 512
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them, another for each seed."""
    x = x ^ np.uint64(seed * 0xA24BAED4963EE407 % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, BATCH_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 4 * BATCH_BYTES:
            _powers[name] = have
    return have[:n]


def chunks_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, bounds of the texts in them) of some BATCH_BYTES each, or of one
    text. The bytes are those of the Arrow array; a null text has none."""
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + BATCH_BYTES, side="right")) - 1)
        j = min(j, n)
        yield i, data[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


def hash_shingles(raw: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingle hashes in order, repeats and all, and where each text's begin (one more at the end).
    raw: the UTF-8 bytes of all texts; bounds: where each begins (one more at the end)."""
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    head, tail = word.copy(), word.copy()
    head[1:] &= ~word[:-1]
    tail[:-1] &= ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    head[inner] = word[inner]
    tail[inner - 1] = word[inner - 1]
    begin, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    lower = raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(raw)), out=sums[1:])
    words = mix((sums[end] - sums[begin]) * _power("down", _INVERSE, len(raw) + 1)[begin])
    del sums
    for i in np.flatnonzero(end - begin > LONG_WORD):
        words[i] = int.from_bytes(blake2b(lower[begin[i] : end[i]].tobytes(), digest_size=8).digest())
    first = np.searchsorted(begin, bounds)  # of each text's words
    n_words = np.diff(first)
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for k in range(width if len(rolled) else 0):
        rolled = rolled * _STEP + words[k : n - width + 1 + k]
    rolled = mix(rolled, 1)
    counts = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(n_words.dtype))
    starts = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(first[:-1] - starts[:-1], counts) + np.arange(starts[-1])
    out = np.zeros(starts[-1], dtype=np.uint64)
    full = np.repeat(n_words >= width, counts)
    out[full] = rolled[at[full]]
    for i in np.flatnonzero((n_words > 0) & (n_words < width)):
        h = int(n_words[i])
        for w in words[first[i] : first[i + 1]]:
            h = (h * int(_STEP) + int(w)) % (1 << 64)
        out[starts[i]] = mix(np.array([h], dtype=np.uint64), 2)[0]
    return out, starts


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, without repeats."""
    s = np.sort(hashes)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
