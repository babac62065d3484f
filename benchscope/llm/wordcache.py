"""Byte-level pre-tokens of whole texts as arrays, and a bounded cache of their ids.

The splitting pattern of the public byte-level vocabularies only looks at the class
of a character (letter, number, white space, other) and its neighbours, so the token
starts of a block of texts are array comparisons.  Equal pre-tokens get equal 64-bit
hashes, each distinct one is encoded once, and a gather assembles the ids of the block.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_U = np.uint64
_R, _MIX1, _MIX2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_RINV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point as the splitting pattern sees it."""
    import regex

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    every, out = points.tobytes().decode("utf-32-le"), np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start() : m.end()]] = kind
    return out


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined texts, their code points, and the bounds of each text."""
    joined = "".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    return joined, cp, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])


def token_starts(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, by the pattern 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^sLN]+|s+(?!S)|s+."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = char_classes()[np.minimum(cp, 0x10FFFF)]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white space of a run that precedes other characters of the same text
    last_space = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n]
    at = np.flatnonzero(last_space)
    start[at] = True
    start[at[cp[at] == 32] + 1] = False  # one blank belongs to what follows
    q = np.flatnonzero((cp == 39) & start)
    q = q[q + 1 < n]
    q = q[~first[q + 1]]
    a = cp[q + 1]
    two = np.isin(a, [ord(c) for c in "stmd"])
    near = q + 2 < n
    b = np.where(near, cp[np.minimum(q + 2, n - 1)], 0)
    b = np.where(first[np.minimum(q + 2, n)], 0, b)
    three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    for size, which in ((2, two), (3, three)):
        i = q[which]
        for k in range(1, size):
            start[i + k] = False
        start[(i + size)[i + size < n]] = True
    return np.flatnonzero(start)


class Powers:
    """Powers of the hash base and of its inverse, extended on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _R)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _RINV)]), dtype=np.uint64)
        return self.up, self.down


POWERS = Powers()


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every span of a symbol array, the same wherever the span stands."""
    with np.errstate(over="ignore"):
        v = (symbols.astype(np.uint64) + _U(1)) * _R
        v ^= v >> _U(29)
        v *= _MIX1
        v ^= v >> _U(32)
        up, down = POWERS.to(len(symbols) + 1)
        total = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(v * up[: len(symbols)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        h ^= h >> _U(31)
        h *= _MIX2
        return h ^ (h >> _U(29))


def gather(pool: np.ndarray, offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of pool[offset : offset + length]."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(offset - (ends - length), length) + np.arange(total)]


class WordIds:
    """Ids of distinct pre-tokens; forgets all of them beyond ``most`` words."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 400_000) -> None:
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.seen: dict[int, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.offset, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def add(self, hashes: list[int], words: list[str]) -> None:
        ids, sizes = self.encode(words)
        n, k = len(self.seen), len(words)
        while n + k > len(self.offset):
            self.offset, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.length))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.offset[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.length[n : n + k] = sizes
        self.used += len(ids)
        self.seen.update(zip(hashes, range(n, n + k), strict=True))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and how many each text has."""
        joined, cp, bounds = code_points(texts)
        starts = token_starts(cp, bounds)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        ends = np.append(starts[1:], len(cp))
        if len(self.seen) > self.most:
            self.clear()
        distinct, example, back = np.unique(span_hashes(cp, starts, ends), return_index=True, return_inverse=True)
        keys, seen = distinct.tolist(), self.seen
        new = [i for i, k in enumerate(keys) if k not in seen]
        if new:
            at = example[new]
            self.add([keys[i] for i in new], [joined[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        place = np.fromiter(map(seen.__getitem__, keys), np.int64, len(keys))[back]
        sizes = self.length[place]
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, bounds)]
        return gather(self.pool, self.offset[place], sizes), np.diff(upto)
