"""SHA-256 states as numpy rows: what a parent of the manifest tree keeps before each child, and how folding goes on from there."""

from __future__ import annotations

from math import isqrt

import numpy as np


def _root_bits(k: int, of_cubes: bool) -> int:
    """The first 32 bits of the fraction of the square or cube root of ``k``."""
    if not of_cubes:
        return isqrt(k << 64) & 0xFFFFFFFF
    n, low, high = k << 96, 0, 1 << 40
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**3 <= n else (low, middle - 1)
    return low & 0xFFFFFFFF


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]
#: The state before any input, and the constants of the 64 rounds.
START = np.array([_root_bits(p, False) for p in _PRIMES[:8]], np.uint32)
_ROUND = np.array([_root_bits(p, True) for p in _PRIMES], np.uint32)
_HEX = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), np.uint16)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compressed(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The states ``(n, 8)`` after one more block ``(n, 16)`` each."""
    w = [np.ascontiguousarray(blocks[:, i]) for i in range(16)]
    a, b, c, d, e, f, g, h = before = [np.ascontiguousarray(states[:, i]) for i in range(8)]
    for i in range(64):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            w.append(w[i - 16] + (_turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))) + w[i - 7] + (_turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))))
        t = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[i] + w[i]
        u = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = t + u, a, b, c, d + t, e, f, g
    return np.stack([x + y for x, y in zip(before, (a, b, c, d, e, f, g, h), strict=True)], axis=1)


def words_of(digests: list[bytes]) -> np.ndarray:
    """Digests of 32 bytes as rows of eight words."""
    return np.frombuffer(b"".join(digests), ">u4").astype(np.uint32).reshape(-1, 8)


def bytes_of(words: np.ndarray) -> list[bytes]:
    flat = words.astype(">u4").tobytes()
    return [flat[i : i + 32] for i in range(0, len(flat), 32)]


def hex_of(words: np.ndarray) -> np.ndarray:
    """Each digest's 64 hex digits."""
    return _HEX[np.ascontiguousarray(words.astype(">u4")).view(np.uint8).reshape(-1, 32)].view(np.uint8).reshape(-1, 64)


def hex_blocks(words: np.ndarray) -> np.ndarray:
    """Digests as the blocks that their hex digits are: 64 digits, one block."""
    return np.ascontiguousarray(hex_of(words)).view(">u4").astype(np.uint32).reshape(-1, 16)


def closed(states: np.ndarray, children: np.ndarray) -> np.ndarray:
    """The digests of states that have taken ``children`` blocks each."""
    last = np.zeros((len(states), 16), np.uint32)
    last[:, 0], last[:, 15] = 0x80000000, children * 512
    return compressed(states, last)
