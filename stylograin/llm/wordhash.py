"""Words of many texts at once, as positions and 64-bit hashes, in numpy.

A word is a run of bytes of one class. All class borders are ASCII, so runs of UTF-8 bytes
are runs of code points. Hashes are polynomials in an odd base modulo 2^64, scrambled; two
of n different words share one with a chance of about n^2 / 2^65.
"""

from __future__ import annotations

import numpy as np

from stylograin.llm.common import mix

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, CHUNK + 1), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if len(known) <= 4 * CHUNK:
            _powers[base] = known
    return known


def spans(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the joined texts, and the index of each text's first word (one more than texts)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = word_byte[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    change = np.empty(len(data) + 1, bool)
    change[0], change[-1] = True, True
    np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
    change |= border
    starts = np.flatnonzero(change[:-1] & inside)
    ends = np.flatnonzero(change[1:] & inside) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per span of bytes; spans are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        first, last = starts[at], ends[to - 1]
        n = int(last - first)
        terms = (data[first:last].astype(np.uint64) + np.uint64(1)) * powers(BASE, n)[:n]
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(terms, out=total[1:])
        begin, end = starts[at:to] - first, ends[at:to] - first
        out[at:to] = (total[end] - total[begin]) * powers(INVERSE, n + 1)[begin]
        out[at:to] += (end - begin).astype(np.uint64) << np.uint64(48)
        at = to
    return mix(out)


def runs(word_hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words within a text, and the index of each text's first run.

    A text of fewer words, but not none, gives one run of all of them.
    """
    n_words = np.diff(first)
    n_runs = np.where(n_words >= length, n_words - length + 1, np.minimum(n_words, 1))
    begin = np.zeros(len(first), np.int64)
    np.cumsum(n_runs, out=begin[1:])
    text = np.repeat(np.arange(len(n_words)), n_runs)
    at = first[:-1][text] + (np.arange(begin[-1]) - begin[:-1][text])
    size = np.minimum(n_words, length)[text]
    out = mix(size.astype(np.uint64) + np.uint64(0x51ED27))
    for k in range(length):
        has = size > k
        if has.all():
            out = mix(out * np.uint64(BASE) + word_hashes[at + k])
        else:
            out[has] = mix(out[has] * np.uint64(BASE) + word_hashes[at[has] + k])
    return out, begin
