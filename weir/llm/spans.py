"""Polynomial span hashes over prefix arrays, and content-defined anchors of fixed-length windows.

Every window of L symbols has one anchor: the leftmost k-gram in it whose hash is least. Equal windows have
their anchors at equal offsets, so a repeated window always shows as a repeated anchor. Anchors are about
2 / (L - k + 2) of all positions, which makes them cheap to exchange where the windows themselves are not.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Positions in one call: the low bits of a masked hash hold the position.
BITS = 20
SEGMENT = 1 << 18
_POWERS: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    if not _POWERS:
        for b in (BASE, INVERSE):
            p = np.full(1 << BITS, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


#: A random-looking 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


def prefix(values: np.ndarray) -> np.ndarray:
    """S[i] = sum of values[j] * BASE**j for j < i, modulo 2**64; values has under 2**BITS entries."""
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers()[0][: len(values)], out=s[1:])
    return s


def span(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end): equal for equal spans wherever they stand."""
    return mix((s[end] - s[start]) * powers()[1][start] + (end - start).astype(np.uint64) * BYTE_VALUES[1])


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum over each run of w values, by doubling."""
    have, out = 1, v
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(v) - w + 1], out[w - have : len(v) - have + 1]) if have < w else out


def anchor_runs(values: np.ndarray, ends: np.ndarray, length: int, k: int):
    """Runs of windows with one anchor: first and last window start, the anchor's place after the first, its hash, the whole run's hash.

    values: symbols of several documents end to end; ends: for each position where its document ends.
    """
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    s = prefix(values)
    at = np.arange(n - k + 1)
    grams = mix((s[k:] - s[:-k]) * powers()[1][: n - k + 1])
    low = np.uint64((1 << BITS) - 1)
    least = sliding_min((grams & ~low) | at.astype(np.uint64), length - k + 1)
    p = np.flatnonzero(at[: n - length + 1] + length <= ends[: n - length + 1])
    if not len(p):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = (least[p] & low).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    start, last = p[first], p[np.append(first[1:] - 1, len(p) - 1)]
    return start, last, anchor[first] - start, grams[anchor[first]], span(s, start, last + length)


def pieces(offsets: np.ndarray, length: int):
    """Deals documents into calls of at most about SEGMENT positions: (first doc, last doc + 1, from, to).

    A longer document is cut into segments that overlap by length - 1, so that no window is lost or doubled.
    """
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > SEGMENT:
            for a in range(offsets[i], max(offsets[i] + 1, offsets[i + 1] - length + 1), SEGMENT):
                yield i, i + 1, a, min(offsets[i + 1], a + SEGMENT + length - 1)
            i += 1
        else:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SEGMENT, "right")) - 1)
            yield i, j, offsets[i], offsets[j]
            i = j


def runs_of(symbols, offsets: np.ndarray, length: int, k: int):
    """anchor_runs over whole documents: document index, first and last window start within it, the anchor's place, hashes.

    symbols(a, b): 64-bit values of positions a to b.
    """
    out = []
    for i, j, a, b in pieces(offsets, length):
        if b - a < length:
            continue
        ends = np.repeat(np.minimum(offsets[i + 1 : j + 1], b) - a, np.minimum(offsets[i + 1 : j + 1], b) - np.maximum(offsets[i:j], a))
        start, last, off, gram, whole = anchor_runs(symbols(a, b), ends, length, k)
        doc = np.searchsorted(offsets, start + a, "right") - 1
        base = a - offsets[doc]
        out.append((doc, start + base, last + base, off, gram, whole))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def word_bounds(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of the words [^ \\t-\\r]+ of all documents, and how many words precede each document."""
    gap = np.ones(len(data) + 1, bool)
    gap[:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.ones(len(data) + 1, bool)
    before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & (before | cut))
    ends = np.flatnonzero(~before & (gap | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def word_values(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), np.uint64)
    long = np.append(np.flatnonzero(ends - starts >= SEGMENT), len(starts))  # a slice ends before each: they are always folded
    i = 0
    while i < len(starts):
        if ends[i] - starts[i] >= SEGMENT:  # a word as long as that: fold the hashes of its pieces
            h = np.uint64(0)
            for a in range(starts[i], ends[i], SEGMENT):
                b = min(ends[i], a + SEGMENT)
                s = prefix(BYTE_VALUES[data[a:b]])
                h = mix(np.array([h]) + span(s, np.array([0]), np.array([b - a])))[0]
            out[i] = h
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 2 * SEGMENT, "right")))
        j = min(j, int(long[np.searchsorted(long, i)]))
        s = prefix(BYTE_VALUES[data[starts[i] : ends[j - 1]]])
        out[i:j] = span(s, starts[i:j] - starts[i], ends[i:j] - starts[i])
        i = j
    return out
