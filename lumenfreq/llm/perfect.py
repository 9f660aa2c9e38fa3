"""A minimal perfect hash in numpy, with compact arrays beside it.

Keys are pairs of 64-bit hashes.  Level by level each remaining key hashes to a bit of a table of twice as many bits;
keys alone on their bit keep it, others go on to the next level.  A key's index is the number of bits set before its
own over all levels, so n keys get the indexes 0 to n-1.  Keys that no level parted (none, unless they are equal)
stay in a short list.
"""

from __future__ import annotations

import io

import numpy as np

_LEVELS = 48
_ODD = 0x9E3779B97F4A7C15


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a ^ (b * np.uint64((2 * level + 1) * _ODD & 0xFFFFFFFFFFFFFFFF))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


class PerfectHash:
    def __init__(self, words: list[np.ndarray], rest: np.ndarray):
        self.words, self.rest = words, rest
        self.ranks, n = [], 0
        for w in words:
            ones = np.bitwise_count(w).astype(np.int64)
            self.ranks.append(n + np.cumsum(ones) - ones)
            n += int(ones.sum())
        self.n = n + len(rest)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        """a, b: uint64, distinct as pairs."""
        words = []
        for level in range(_LEVELS):
            if not len(a):
                break
            bits = max(64, (2 * len(a) + 63) // 64 * 64)
            slot = _mix(a, b, level) % np.uint64(bits)
            alone = np.bincount(slot.astype(np.int64), minlength=bits) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8").copy())
            go_on = ~alone[slot.astype(np.int64)]
            a, b = a[go_on], b[go_on]
        return cls(words, np.stack([a, b]).T if len(a) else np.zeros((0, 2), np.uint64))

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Indexes; a key that was not built in gets -1 or any index, so compare fingerprints."""
        out = np.full(len(a), -1, np.int64)
        todo = np.arange(len(a))
        for level, (w, r) in enumerate(zip(self.words, self.ranks, strict=True)):
            if not len(todo):
                break
            slot = _mix(a[todo], b[todo], level) % np.uint64(64 * len(w))
            word, bit = w[(slot >> np.uint64(6)).astype(np.int64)], slot & np.uint64(63)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = (r[(slot >> np.uint64(6)).astype(np.int64)] + below)[hit]
            todo = todo[~hit]
        for k, (x, y) in enumerate(self.rest):
            out[todo[(a[todo] == x) & (b[todo] == y)]] = self.n - len(self.rest) + k
        return out


def save(mph: PerfectHash, **arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, rest=mph.rest, levels=np.array([len(w) for w in mph.words], np.int64), words=np.concatenate([*mph.words, np.zeros(0, "<u8")]), **arrays)
    return out.getvalue()


def load(data: bytes) -> tuple[PerfectHash, dict[str, np.ndarray]]:
    z = dict(np.load(io.BytesIO(data)))
    levels = z.pop("levels")
    words = np.split(z.pop("words"), np.cumsum(levels)[:-1]) if len(levels) else []
    return PerfectHash(words, z.pop("rest")), z
