"""Content-chosen anchors of byte texts.

Every window of WINDOW bytes chooses the places of its least K-byte hashes. The choice depends on the window's bytes
alone, so equal windows choose equal places: a string of WINDOW bytes that occurs twice shares an anchor, at the same
offset, with its other occurrence. An anchor's context is the union of the windows that choose it (the leftmost of
equal hashes); each window belongs to one context.
"""

from __future__ import annotations

import numpy as np

WINDOW = 100
K = 28
REACH = WINDOW - K

_ROOT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SYMBOLS = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_power_cache: dict[int, np.ndarray] = {}


def _powers(root: np.uint64, n: int) -> np.ndarray:
    have = _power_cache.get(int(root))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16) + 1, root, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) > 1 << 24:
            return have[:n]
        _power_cache[int(root)] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any stretch of a byte array in constant time, alike for equal stretches anywhere."""

    def __init__(self, octets: np.ndarray):
        terms = _SYMBOLS[octets] * _powers(_ROOT, len(octets))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self.back = _powers(_INVERSE, len(octets) + 1)

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mixed((self.sums[high] - self.sums[low]) * self.back[low] + (high - low).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def grams(self, size: int) -> np.ndarray:
        return mixed((self.sums[size:] - self.sums[:-size]) * self.back[: len(self.sums) - size])


def _sliding(x: np.ndarray, size: int, least) -> np.ndarray:
    """least (minimum or maximum) over every stretch of the given size."""
    reach = 1
    while reach * 2 <= size:
        x = least(x[:-reach], x[reach:])
        reach *= 2
    return least(x[: len(x) - (size - reach)], x[size - reach :]) if size > reach else x


def choose(octets: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(low, high, anchor's place, anchor hash, context hash) of all contexts in texts laid end to end, in octets.
    Windows never cross the texts' ends. Texts shorter than WINDOW have none."""
    if len(octets) < WINDOW:
        return *[np.zeros(0, np.int64)] * 3, *[np.zeros(0, np.uint64)] * 2
    rolling = Rolling(octets)
    grams = rolling.grams(K)
    short = (grams >> np.uint64(33)).astype(np.uint32) + np.uint32(1)
    low = _sliding(short, REACH + 1, np.minimum)  # per window start
    ends = starts + lengths
    valid = np.zeros(len(octets) + 1, np.int32)
    long = lengths >= WINDOW
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, (ends - WINDOW + 1)[long], -1)
    valid = np.cumsum(valid)[: len(low)] > 0
    pad = np.zeros(REACH, np.uint32)
    high = _sliding(np.concatenate([pad, np.where(valid, low, np.uint32(0)), pad]), REACH + 1, np.maximum)[: len(short)]
    at = np.flatnonzero(high == short)
    value = short[at]
    text = np.searchsorted(ends, at, side="right")
    first = np.maximum(at - REACH, starts[text])  # window starts that choose the anchor
    last = np.minimum(at, ends[text] - WINDOW)
    for sign in (-1, 1):  # nearer anchors that win against this one shorten its share
        open_, step = np.arange(len(at)), 1
        while len(open_):
            other = open_ + sign * step
            inside = (other >= 0) & (other < len(at))
            open_, other = open_[inside], other[inside]
            near = np.abs(at[other] - at[open_]) <= REACH
            open_, other = open_[near], other[near]
            if sign < 0:
                wins = value[other] <= value[open_]
                first[open_[wins]] = np.maximum(first[open_[wins]], at[other[wins]] + 1)
            else:
                wins = value[other] < value[open_]
                last[open_[wins]] = np.minimum(last[open_[wins]], at[other[wins]] - REACH - 1)
            open_ = open_[~wins]
            step += 1
    kept = first <= last
    at, first, right = at[kept], first[kept], last[kept] + WINDOW
    return first, right, at, grams[at], rolling.of(first, right) ^ mixed((at - first).astype(np.uint64))
