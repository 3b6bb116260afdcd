"""Unsigned integers in variable-length bytes."""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in 7-bit groups, lowest first, the top bit set where more follow; and the bytes of each value."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        sizes += values >= np.uint64(1 << (7 * k))
    ends = np.cumsum(sizes)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(sizes.max()) if len(sizes) else 0):
        has = sizes > k
        group = (values[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[(ends - sizes)[has] + k] = group | np.where(sizes[has] > k + 1, np.uint64(128), np.uint64(0))
    return out, sizes


def unpack(data: bytes) -> np.ndarray:
    """The values of ``pack``'s bytes."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.int64)
    stops = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], stops[:-1] + 1))
    shift = 7 * (np.arange(len(raw)) - np.repeat(starts, stops - starts + 1))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, starts)
