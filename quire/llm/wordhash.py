"""64-bit hashes of the words of many texts at once, on their UTF-8 bytes.

A word is a run of bytes other than space and \\t..\\r. The hash of a word is the sum of a random
number for each byte times a power for its place in the word, modulo 2**64, then mixed. Running sums
with powers by the place in the batch give it: their difference over a word, times the inverse power of
its first place. Every step is one numpy call over many bytes, so there is no Python call for each word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_SPLIT = _SEP.copy()  # also at every ASCII character that is neither letter nor digit
_SPLIT[:128] |= [not chr(c).isalnum() for c in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes whose running sums are held at a time; a longer word is taken alone.
BLOCK = 1 << 17
_POW = _INV = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base, and of its inverse."""
    global _POW, _INV
    if len(_POW) < n:
        size = max(1 << 16, 2 * n if n < BLOCK else n)
        one = [np.uint64(1)]
        _POW = np.cumprod(np.concatenate([one, np.full(size - 1, _BASE, dtype=np.uint64)]), dtype=np.uint64)
        _INV = np.cumprod(np.concatenate([one, np.full(size - 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)]), dtype=np.uint64)
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array (null: empty) and the n + 1 offsets into them."""
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off - off[0]


def words(texts: pa.Array, lower: bool = False, split: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, first byte and end byte of each word of the array, in order.

    lower: fold A-Z. split: ASCII punctuation also ends words.
    """
    raw, off = buffer_of(texts)
    none = np.zeros(0, np.int64)
    if not len(raw):
        return np.zeros(0, np.uint64), none, none, none
    if lower:
        raw = _LOWER[raw]
    solid = ~(_SPLIT if split else _SEP)[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]  # a word ends with its text, even if the next text begins with one
    first[cut] = solid[cut]
    last[cut - 1] = solid[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), none, none, none
    h = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + BLOCK, side="right")))
        size = int(ends[j - 1] - at)
        power, inverse = _powers(size)
        run = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw[at : at + size]] * power[:size], out=run[1:])
        h[i:j] = (run[ends[i:j] - at] - run[starts[i:j] - at]) * inverse[starts[i:j] - at]
        i = j
    doc = np.searchsorted(off, starts, side="right") - 1
    return mix(h + (ends - starts).astype(np.uint64)), doc, starts, ends


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; len(h) - n + 1 of them. The caller drops those that span two texts."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, np.uint64(n), dtype=np.uint64)
    for j in range(n):
        out = (out ^ h[j : j + m]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix(out)


def sequence_hash(rows: np.ndarray) -> np.ndarray:
    """Hash of each row of word hashes; equal to grams() of its words."""
    out = np.full(len(rows), np.uint64(rows.shape[1]), dtype=np.uint64)
    for j in range(rows.shape[1]):
        out = (out ^ rows[:, j]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_sets(texts: pa.Array, n: int, lower: bool = False) -> list[np.ndarray]:
    """For each text the sorted distinct n-word shingles; the whole sequence as one where it is shorter; none without words."""
    h, doc, _, _ = words(texts, lower)
    count = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    g = grams(h, n)
    out = []
    for k in range(len(texts)):
        a, c = int(first[k]), int(count[k])
        if c >= n:
            s = np.sort(g[a : a + c - n + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            out.append(s)
        elif c:
            out.append(grams(h[a : a + c], c))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
