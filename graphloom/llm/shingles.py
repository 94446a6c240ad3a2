"""Word shingles and MinHash signatures in vectorised numpy.

Words are runs of bytes other than blank and 0x09-0x0D of the UTF-8 text, A-Z lower-cased.  A
word's hash is a polynomial over its bytes, taken for all words at once from prefix sums; a
shingle's hash is a polynomial over its words.  All hashes have 64 bits and pass through a
mixer; two different shingles of a pair of texts agree by chance with odds under 1e-9 even for
texts of 100,000 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
IS_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD6E8FEB86659FD93)
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """BASE to the n and to the -n, modulo 2^64, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            for name, base in (("up", BASE), ("down", inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


POWERS = Powers()


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the byte at which it starts."""
    if not data:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    b = np.frombuffer(data.translate(LOWER), np.uint8)
    POWERS.reach(len(b) + 1)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[b]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * POWERS.up[: len(b)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * POWERS.down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * WORD_BASE), starts


def fold(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * WORD_BASE + words[i : n + i]
    return mix(h + np.uint64(size))


def blocks(data: bytes) -> Iterator[bytes]:
    """Cuts at white space, so that the work space stays small for very long texts."""
    at = 0
    while len(data) - at > BLOCK:
        end = max(data.rfind(bytes([c]), at, at + BLOCK) for c in (32, 10, 9, 11, 12, 13))
        end = end + 1 if end >= 0 else next((i + 1 for i in range(at + BLOCK, len(data)) if IS_SPACE[data[i]]), len(data))
        yield data[at:end]
        at = end
    yield data[at:]


def shingle_list(data: bytes, size: int) -> np.ndarray:
    """Shingle hashes in order, repeated ones included; one for the whole text if it has fewer
    words than ``size``; none without words."""
    words = np.concatenate([word_hashes(x)[0] for x in blocks(data)]) if len(data) > BLOCK else word_hashes(data)[0]
    return fold(words, min(size, len(words))) if len(words) else words


def shingle_lists(texts: list[bytes], size: int) -> list[np.ndarray]:
    """``shingle_list`` of many texts, with small ones handled together."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    total = 0

    def flush() -> None:
        nonlocal group, total
        if not group:
            return
        begins = np.cumsum([0] + [len(t) + 1 for t in group])
        words, starts = word_hashes(b" ".join(group))
        first = np.searchsorted(starts, begins)
        whole = fold(words, size) if len(words) >= size else np.empty(0, np.uint64)
        for a, b in zip(first[:-1], first[1:], strict=True):
            out.append(whole[a : b - size + 1] if b - a >= size else fold(words[a:b], b - a) if b > a else words[:0])
        group, total = [], 0

    for t in texts:
        if len(t) > BLOCK // 2:
            flush()
            out.append(shingle_list(t, size))
        else:
            group.append(t)
            total += len(t) + 1
            if total > BLOCK // 2:
                flush()
    flush()
    return out


class MinHash:
    """``count`` universal hash functions a*x+b (high half of 64 bits) of 32-bit shingle
    hashes, drawn from a fixed seed."""

    def __init__(self, count: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.count = count
        self.a = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, count, dtype=np.uint64)

    def signatures(self, lists: list[np.ndarray]) -> np.ndarray:
        """One row of uint32 for each list; a list without shingles gets the largest values."""
        out = np.full((len(lists), self.count), 0xFFFFFFFF, np.uint32)
        at = 0
        while at < len(lists):
            to, n = at, 0
            while to < len(lists) and (n == 0 or n + len(lists[to]) <= 1 << 17):
                n += len(lists[to])
                to += 1
            full = [i for i in range(at, to) if len(lists[i])]
            for lo in range(0, n, 1 << 18) if len(full) == 1 else [0]:
                if full:
                    part = [lists[full[0]][lo : lo + (1 << 18)]] if len(full) == 1 else [lists[i] for i in full]
                    x = np.concatenate(part) >> np.uint64(32)
                    begins = np.cumsum([0] + [len(p) for p in part[:-1]])
                    y = np.empty_like(x)
                    for k in range(self.count):
                        np.multiply(x, self.a[k], out=y)
                        np.add(y, self.b[k], out=y)
                        low = (np.minimum.reduceat(y, begins) >> np.uint64(32)).astype(np.uint32)
                        out[full, k] = np.minimum(out[full, k], low)
            at = to
        return out


def set_key(distinct: np.ndarray) -> bytes:
    """128-bit name of a set given as a sorted array."""
    return hashlib.blake2b(distinct.tobytes(), digest_size=16).digest()


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each text and band; the band's number is part of it."""
    out = np.empty((len(signatures), bands), np.uint64)
    for band in range(bands):
        h = np.full(len(signatures), band + 1, np.uint64)
        for r in range(rows):
            h = mix(h * WORD_BASE + signatures[:, band * rows + r].astype(np.uint64))
        out[:, band] = h
    return out.view(np.int64)
