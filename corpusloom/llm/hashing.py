"""Vectorised byte hashing shared by the operators."""

from __future__ import annotations

import numpy as np

from .work import forgotten_after_task

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: One random-looking 64-bit value for each byte value, from a rule.
_TABLE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA5A3564E0B7F1C29)
_powers: dict[str, np.ndarray] = {}


forgotten_after_task(_powers.clear)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit; works in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


_TABLE = mix(_TABLE)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64; kept, and grown by doubling."""
    have = _powers.get("up")
    if have is None or len(have) <= n:
        size = max(1 << 12, 1 << int(n + 1).bit_length())
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] naming the bytes data[i:j] up to a power of the base."""
    up, _ = _power(len(data))
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(_TABLE[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal bytes, equal hash, wherever they stand."""
    _, down = _power(len(sums) - 1)
    h = (sums[end] - sums[start]) * down[start]
    h ^= (end - start).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    return mix(h)
