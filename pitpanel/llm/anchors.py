"""Anchors of a text: positions that any two equal long strings share.

A string of ``length`` bytes is anchored at the seed (``seed`` bytes) with the smallest
fingerprint in it, the leftmost one of equals. That depends on the string alone, so
equal strings have their anchors at the same offset. A text's anchors are about one
position in ``(length - seed) / 2``; every window belongs to exactly one of them, and
the windows of an anchor are a run of consecutive starts.
"""

from __future__ import annotations

import numpy as np

LENGTH, SEED = 200, 32
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(32).integers(1, 1 << 63, 256, dtype=np.uint64)
_BLOCK = 1 << 16


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE, np.uint64)])
    down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(_BASE, -1, 1 << 64), np.uint64)])
    return up, down


_UP, _DOWN = _powers(_BLOCK + LENGTH + 1)
_M = np.uint64(0xFF51AFD7ED558CCD)


def _fingerprints(data: np.ndarray) -> np.ndarray:
    """Fingerprint of every seed of a block, from one running sum."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _UP[: len(data)], out=total[1:])
    n = len(data) - SEED + 1
    h = (total[SEED:] - total[:-SEED]) * _DOWN[:n]
    h ^= h >> np.uint64(32)
    h *= _M
    return h ^ (h >> np.uint64(29))


def _least(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of every ``width`` consecutive values and its first position, by doubling."""
    n, have, at = len(h) - width + 1, 1, np.arange(len(h), dtype=np.int32)
    value = h
    while have < width:
        step = min(have, width - have)
        left, right = value[: len(value) - step], value[step:]
        keep = left <= right
        at = np.where(keep, at[: len(at) - step], at[step:])
        value = np.where(keep, left, right)
        have += step
    return value[:n], at[:n]


def anchors(raw: bytes | memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(key, at, first, last)``: seed key and position, first and last window start, per anchor.

    The key orders suffixes by their first three bytes, then by the seed's fingerprint.
    """
    data = np.frombuffer(raw, np.uint8)
    windows = len(data) - LENGTH + 1
    width = LENGTH - SEED + 1
    none = np.zeros(0, np.int64)
    if windows < 1:
        return none, none, none, none
    keys, at = [], []
    for s in range(0, windows, _BLOCK):
        count = min(_BLOCK, windows - s)
        h = _fingerprints(data[s : s + count + LENGTH - 1])
        low, where = _least(h, width)
        at.append(where.astype(np.int64) + s)
        keys.append(low)
    at, h = np.concatenate(at), np.concatenate(keys)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.append(first[1:], windows) - 1
    at, h = at[first], h[first]
    head = (data[at].astype(np.uint64) << np.uint64(16)) | (data[at + 1].astype(np.uint64) << np.uint64(8)) | data[at + 2].astype(np.uint64)
    key = (head << np.uint64(40)) | (h >> np.uint64(24))
    return (key ^ np.uint64(1 << 63)).view(np.int64), at, first, last
