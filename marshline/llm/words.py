"""Hashes of the words of many texts at once, in numpy.

A word is a maximal run of bytes other than ASCII white space ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_ODD = 0xD1342543DE82EF95
_LONG_WORD = 128
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words one after another, and where each text's words start (one more entry than texts). ``lower``: A-Z only."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():  # white space at an end of a text gives an empty word
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[full], minlength=len(counts))
        words = words.filter(pa.array(full))
    return words, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset:words.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[:len(raw)] = raw
    at_byte = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    starts, size = ends[:-1], np.diff(ends)
    out = mix(at_byte[starts] & _MASKS[np.minimum(size, 8)] ^ (size.astype(np.uint64) * _STEP))
    rest = np.flatnonzero((size > 8) & (size <= _LONG_WORD))
    done = 8
    while len(rest):
        chunk = at_byte[starts[rest] + done] & _MASKS[np.minimum(size[rest] - done, 8)]
        out[rest] = mix(out[rest] * _STEP ^ chunk)
        done += 8
        rest = rest[size[rest] > done]
    for i in np.flatnonzero(size > _LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i]:ends[i + 1]].tobytes())
    return out


class Rolling:
    """Hashes of every run of ``k`` consecutive values, from prefix sums of powers."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        with np.errstate(over="ignore"):
            self._inverse = _powers(pow(_ODD, -1, 1 << 64), n + 1)
            self._prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(values * _powers(_ODD, n), out=self._prefix[1:])

    def runs(self, k: int) -> np.ndarray:
        if len(self._prefix) <= k:
            return np.zeros(0, np.uint64)
        return mix((self._prefix[k:] - self._prefix[:-k]) * self._inverse[:len(self._prefix) - k])

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._prefix[ends] - self._prefix[starts]) * self._inverse[starts] ^ (ends - starts).astype(np.uint64))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 18)
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        known = np.cumprod(factors, dtype=np.uint64)
        if size <= 1 << 23:
            _POWERS[base] = known
    return known[:n]


def shingles(texts: pa.Array, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's k-word runs, one text after another, and where each text's start.

    A text of fewer words gives its whole sequence as one; a text without words gives none.
    """
    words, starts = split_words(texts, lower)
    hashed = hash_words(words)
    roll = Rolling(hashed)
    runs = roll.runs(k)
    sets = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= k:
            s = np.sort(runs[a:b - k + 1])
            sets.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
        elif b > a:
            sets.append(roll.span(np.array([a]), np.array([b])))
        else:
            sets.append(runs[:0])
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), ends


def set_keys(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per set, equal for equal sets."""
    a, b = np.zeros(len(ends), np.uint64), np.zeros(len(ends), np.uint64)
    for out, salt in ((a, 0x5851F42D4C957F2D), (b, 0x14057B7EF767814F)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(values ^ np.uint64(salt)), dtype=np.uint64)])
        out[:-1] = total[ends[1:]] - total[ends[:-1]]
    return a[:-1].view(np.int64), b[:-1].view(np.int64)
