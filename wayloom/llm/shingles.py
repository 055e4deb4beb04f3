"""Word shingles of whole texts as sorted sets of 64-bit hashes, in numpy over batches of UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import BACK, BASE, by_row, mix, powers, strings

# A-Z lower-cased byte by byte; bytes that separate words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_GAP = np.zeros(256, bool)
IS_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes whose words are hashed at once.
SPAN = 1 << 20


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first byte within the row, end byte) of each word of each text, in order; null has none."""
    raw, offs = strings(texts)
    if not len(raw):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    gap = IS_GAP[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    begin = ~gap
    begin[1:] &= gap[:-1] | edge[1:-1]
    last = ~gap
    last[:-1] &= gap[1:] | edge[1:-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + SPAN, "right")))
        a, b = s[i], e[j - 1]
        p, q = powers(BASE, b - a), powers(BACK, b - a)
        h = np.zeros(b - a + 1, np.uint64)
        np.cumsum((LOWER[raw[a:b]].astype(np.uint64) + np.uint64(1)) * p[:-1], out=h[1:])
        out[i:j] = mix((h[e[i:j] - a] - h[s[i:j] - a]) * q[s[i:j] - a] + (e[i:j] - s[i:j]).astype(np.uint64))
        i = j
    row = np.searchsorted(offs, s, "right") - 1
    return row, out, s - offs[row], e - offs[row]


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct k-word shingles, ascending. With fewer words the sequence is the only one."""
    row, word, _, _ = words(texts)
    n = len(texts)
    count = np.bincount(row, minlength=n)
    out, at = [], []
    if len(word) >= k:
        h = np.zeros(len(word) - k + 1, np.uint64)
        for j in range(k):
            h = h * STEP + word[j : len(word) - k + 1 + j]
        inside = row[: len(h)] == row[k - 1 :]
        out.append(mix(h[inside]))
        at.append(row[: len(h)][inside])
    first = np.cumsum(count) - count
    for r in np.flatnonzero((count > 0) & (count < k)):
        h = np.uint64(count[r])
        with np.errstate(over="ignore"):
            for w in word[first[r] : first[r] + count[r]]:
                h = h * STEP + w
        out.append(mix(np.array([h])))
        at.append(np.array([r]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    h, r = np.concatenate(out), np.concatenate(at)
    order = by_row(h, r, n)
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.r_[0, np.cumsum(np.bincount(r, minlength=n))]


def signatures(h: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class id, size) of each set: equal sets share an id, a 64-bit hash of size, sum and a second sum of the shingles."""
    sums = np.r_[np.uint64(0), np.cumsum(h, dtype=np.uint64)]
    more = np.r_[np.uint64(0), np.cumsum(mix(h ^ STEP), dtype=np.uint64)]
    a, b = sums[offs[1:]] - sums[offs[:-1]], more[offs[1:]] - more[offs[:-1]]
    size = np.diff(offs)
    return mix(mix(a) + b * STEP + size.astype(np.uint64)).astype(np.int64), size
