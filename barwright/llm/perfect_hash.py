"""Minimal perfect hashing of the keys of one shard, by levels of bits."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Bits a level has for each key that is left, levels at most, and 64-bit words behind one stored count.
GAMMA, LEVELS, STEP = 2, 200, 8


def _mix(x: np.ndarray) -> np.ndarray:
    """One to one over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def key_hashes(keys: list) -> np.ndarray:
    """Two 64-bit hashes of each key (integer, string or None), as two rows; integers never share both, nor the first."""
    out = np.empty((2, len(keys)), np.uint64)
    if all(isinstance(k, (int, np.integer)) for k in keys):
        x = np.array(keys, np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            out[0], out[1] = _mix(x + _A), _mix(x ^ _C)
        return out
    for i, k in enumerate(keys):
        if k is None:
            out[:, i] = 0, 1
        elif isinstance(k, (int, np.integer)):
            out[:, i] = key_hashes([k])[:, 0]
        else:
            h = xxhash.xxh3_128_intdigest(str(k).encode())
            out[:, i] = h >> 64, h & 0xFFFFFFFFFFFFFFFF
    return out


def _places(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(h[0] + np.uint64(level + 1) * (h[1] | np.uint64(1))) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Maps n different keys to the numbers 0 to n - 1.

    A level has ``GAMMA`` bits for each key that is left.  A bit is set if one
    key alone falls on it; keys that fall together go on to the next level.
    A key's number is how many bits are set before its own, from counts that
    are stored every ``STEP`` words, so a key costs a few reads (1.6 levels on
    average) however many there are.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        ones = np.bitwise_count(words).astype(np.int64)
        pad = -len(ones) % STEP
        self.counts = np.append(0, np.cumsum(np.pad(ones, (0, pad)).reshape(-1, STEP).sum(axis=1)))

    @classmethod
    def of(cls, h: np.ndarray) -> PerfectHash:
        sizes, words = [], []
        while h.shape[1]:
            if len(sizes) == LEVELS:
                raise ValueError("keys with equal hashes")
            bits = 64 * -(-GAMMA * h.shape[1] // 64)
            at = _places(h, len(sizes), bits)
            alone = np.bincount(at, minlength=bits) == 1
            sizes.append(bits)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            h = h[:, ~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(words).astype(np.uint64) if words else np.zeros(0, np.uint64))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Numbers of keys by their hashes.  A key that wasn't there gets -1 or any number: compare fingerprints."""
        out = np.full(h.shape[1], -1, np.int64)
        left, base = np.arange(h.shape[1]), 0
        for level, bits in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = base + _places(h[:, left], level, bits)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            w, b = word[hit], bit[hit]
            before = self.counts[w // STEP] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1)))
            first = w - w % STEP
            for k in range(STEP - 1):
                before += np.where(first + k < w, np.bitwise_count(self.words[np.minimum(first + k, w)]), 0)
            out[left[hit]] = before
            left, base = left[~hit], base + bits
        return out
