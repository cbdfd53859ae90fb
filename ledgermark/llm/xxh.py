"""XXH64 of many byte spans at once in numpy; the constants are the published primes."""

from __future__ import annotations

import numpy as np

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rot(x, r: int):
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def _round(acc, lane):
    return _rot(acc + lane * P2, 31) * P1


def words64(data) -> np.ndarray:
    """The little-endian 64-bit word at every byte, zeros behind the end."""
    wide = np.zeros(len(data) + 8, np.uint64)
    wide[: len(data)] = data
    for step in (1, 2, 4):  # 8 bytes by doubling
        wide[:-step] |= wide[step:] << np.uint64(8 * step)
    return wide


def xxh64(data, start, size, seed: int = 42) -> np.ndarray:
    """XXH64 of ``data[start : start + size]`` for arrays of starts and sizes."""
    wide, size = words64(data), size.astype(np.int64)
    at = start.astype(np.int64).copy()
    left = size.copy()
    with np.errstate(over="ignore"):
        h = np.full(len(at), np.uint64(seed) + P5, np.uint64)
        long = np.flatnonzero(size >= 32)
        if len(long):
            v = [np.full(len(long), np.uint64(x), np.uint64) for x in ((seed + int(P1) + int(P2)) % 2**64, (seed + int(P2)) % 2**64, seed, (seed - int(P1)) % 2**64)]
            p, n = at[long], size[long] // 32
            todo = np.arange(len(long))
            for k in range(int(n.max())):
                todo = todo[n[todo] > k]
                for i in range(4):
                    v[i][todo] = _round(v[i][todo], wide[p[todo] + 8 * i])
                p[todo] += 32
            acc = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
            for i in range(4):
                acc = (acc ^ _round(np.zeros_like(acc), v[i])) * P1 + P4
            h[long], at[long], left[long] = acc, p, size[long] % 32
        h += size.astype(np.uint64)
        todo = np.flatnonzero(left >= 8)
        while len(todo):
            h[todo] = _rot(h[todo] ^ _round(np.uint64(0), wide[at[todo]]), 27) * P1 + P4
            at[todo] += 8
            left[todo] -= 8
            todo = todo[left[todo] >= 8]
        todo = np.flatnonzero(left >= 4)
        h[todo] = _rot(h[todo] ^ (wide[at[todo]] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
        at[todo] += 4
        left[todo] -= 4
        todo = np.flatnonzero(left > 0)
        while len(todo):
            h[todo] = _rot(h[todo] ^ (wide[at[todo]] & np.uint64(0xFF)) * P5, 11) * P1
            at[todo] += 1
            left[todo] -= 1
            todo = todo[left[todo] > 0]
        h = (h ^ h >> np.uint64(33)) * P2
        h = (h ^ h >> np.uint64(29)) * P3
        return h ^ h >> np.uint64(32)
