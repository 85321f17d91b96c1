"""Hashes of bytes, words and shingles for many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

MOST_KEPT = 1 << 21
_powers: dict[int, np.ndarray] = {}


def powers(of: np.uint64, count: int) -> np.ndarray:
    """1, of, of^2, ... modulo 2^64; up to MOST_KEPT are kept between calls."""
    have = _powers.get(int(of))
    if have is None or len(have) < count:
        steps = np.full(max(count, 1 << 16), of, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= MOST_KEPT:
            _powers[int(of)] = have
    return have[:count]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE^place; one longer than ``data``."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in [start, end), wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start] + (end - start).astype(np.uint64))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts behind one another with a space in between; and where each starts (one more at the end)."""
    start = np.cumsum([0] + [len(t) + 1 for t in texts])
    return np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8) if texts else np.zeros(0, np.uint8), start


def words(texts: list[bytes], separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word and the number of its text. Only A-Z is lower-cased."""
    data, start = joined(texts)
    space = separators[data]
    data = LOWER[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    begin, end = edge[::2], edge[1::2]
    return range_hash(prefix_sums(data), begin, end), np.searchsorted(start, begin, side="right") - 1


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of ``size`` words in a row; of fewer words, one hash of all of them."""
    out = []
    for first, last in runs([len(t) for t in texts], 1 << 20):
        word, owner = words(texts[first:last])
        count = np.bincount(owner, minlength=last - first)
        begin = np.cumsum(count) - count
        sums = np.zeros(max(0, len(word) - size + 1), dtype=np.uint64)
        for k in range(size if len(sums) else 0):
            sums += word[k : k + len(sums)] * powers(BASE, size + 1)[k + 1]
        sums = mix(sums)
        for a, n in zip(begin.tolist(), count.tolist()):
            if n >= size:
                out.append(np.unique(sums[a : a + n - size + 1]))
            else:
                own = word[a : a + n] * powers(BASE, size + 1)[1 : n + 1]
                out.append(mix(own.sum(dtype=np.uint64, keepdims=True) + np.uint64(n)) if n else own)
    return out


def runs(sizes: list[int], most: int):
    """Slices of about ``most`` in total; a larger item is a slice of its own."""
    first, total = 0, 0
    for k, n in enumerate(sizes):
        if k > first and total + n > most:
            yield first, k
            first, total = k, 0
        total += n
    if len(sizes) > first:
        yield first, len(sizes)


def signature(values: np.ndarray) -> bytes:
    """128 bits of a sorted array."""
    place = np.arange(1, len(values) + 1, dtype=np.uint64)
    a, b = mix(values ^ mix(place)), mix(values + mix(place + BASE))
    return np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64) ^ np.uint64(len(values))]).tobytes()


def pack(keys: np.ndarray) -> bytes:
    """A sorted array of 64-bit numbers as differences: four bytes each where they fit."""
    step = np.diff(keys, prepend=np.uint64(0))
    narrow = len(keys) == 0 or int(step[1:].max(initial=np.uint64(0))) < 1 << 32
    if not narrow:
        return b"\x08" + keys.tobytes()
    return b"\x04" + keys[:1].tobytes() + step[1:].astype("<u4").tobytes()


def unpack(data: bytes) -> np.ndarray:
    if data[0] == 8:
        return np.frombuffer(data, dtype="<u8", offset=1)
    if len(data) == 1:
        return np.zeros(0, dtype=np.uint64)
    first = np.frombuffer(data, dtype="<u8", offset=1, count=1)
    return np.cumsum(np.concatenate([first, np.frombuffer(data, dtype="<u4", offset=9).astype(np.uint64)]))
