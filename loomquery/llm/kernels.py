"""Vectorised text kernels shared by the operators: codepoint classes, runs, span and window hashes.

A ``Block`` is a handful of texts joined into one codepoint array, so that every step is a whole-array
numpy operation; texts are always processed whole, only their grouping into blocks is bounded.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE, WHITE, MARK = range(6)
#: Unicode White_Space other than the plain space.
_WHITE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD1342543DE82EF95)


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each codepoint: its class, its lower-case codepoint, whether it is upper or title case."""
    kind = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    upper = np.zeros(0x110000, bool)
    codes = {"L": LETTER, "N": NUMBER, "M": MARK}
    for cp in (*range(0x32400), *range(0xE0000, 0xE01F0)):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat[0] in codes:
            kind[cp] = codes[cat[0]]
            if cat in ("Lu", "Lt"):
                upper[cp] = True
                small = ch.lower()
                if len(small) == 1:
                    lower[cp] = ord(small)
    kind[_WHITE] = WHITE
    kind[32] = SPACE
    return kind, lower, upper


class Block:
    """Texts joined by line feeds: ``cps`` codepoints, ``starts``/``ends`` the span of each text."""

    __slots__ = ("text", "cps", "starts", "ends")

    def __init__(self, texts: list[str]):
        self.text = "\n".join(texts) + "\n"
        self.cps = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(n + 1) - 1
        self.starts = self.ends - n

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The index of the text that holds each (ascending) position."""
        edges = np.searchsorted(at, self.starts)
        return np.repeat(np.arange(len(self.starts)), np.diff(np.append(edges, len(at))))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if len(mask) and mask[0]:
        edge = np.append(0, edge)
    if len(mask) and mask[-1]:
        edge = np.append(edge, len(mask))
    return edge[::2], edge[1::2]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 1 << 21:  # those of a huge text are not kept
            _powers[base] = have
    return have[:n]


_INVERSE = pow(_BASE, -1, 1 << 64)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span`` takes the polynomial hash of any span."""
    v = (values.astype(np.uint64) + np.uint64(1)) * _STEP
    v ^= v >> np.uint64(29)
    v *= powers(_BASE, len(v))
    out = np.empty(len(v) + 1, np.uint64)
    out[0] = 0
    np.cumsum(v, out=out[1:])
    return out


def span(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever the span stands."""
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts])


def windows(h: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k consecutive values, and where such a window lies inside one owner."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    acc = h[:n].copy()
    for j in range(1, k):
        acc *= _STEP
        acc += h[j : j + n]
    return mix(acc), owner[:n] == owner[k - 1 :]


def word_spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and owners of the words: runs of letters, marks and numbers."""
    kind = tables()[0][block.cps]
    starts, ends = runs((kind == LETTER) | (kind == NUMBER) | (kind == MARK))
    return starts, ends, block.owner(starts)


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and their owners."""
    starts, ends, owner = word_spans(block)
    return span(prefix_sums(tables()[1][block.cps]), starts, ends), owner


@dataclass
class SortedHash:
    """Keys in the order of their hashes, found through a directory of the leading hash bits."""

    keys: np.ndarray | None
    hashes: np.ndarray = field(init=False)
    order: np.ndarray | None = field(init=False)
    size: int = field(init=False)
    shift: np.uint64 = field(init=False)
    heads: np.ndarray = field(init=False)
    depth: int = field(init=False)

    def __post_init__(self):
        h = mix(self.keys)
        self.size = len(h)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        bits = max(4, int(len(h)).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.heads = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1)).astype(np.int32)
        self.depth = int(np.diff(self.heads).max(initial=0))
        self.hashes = np.append(self.hashes, np.zeros(self.depth + 1, np.uint64))

    def slim(self) -> None:
        """Forget the keys: ``find`` doesn't need them."""
        self.keys = self.order = None

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is missing."""
        h = mix(keys)
        at = self.heads[h >> self.shift]
        out = np.where((self.hashes[at] == h) & (at < self.size), at, -1)
        left = np.flatnonzero(out < 0)
        for j in range(1, self.depth):
            if not len(left):
                break
            hit = (self.hashes[at[left] + j] == h[left]) & (at[left] + j < self.size)
            out[left[hit]] = at[left[hit]] + j
            left = left[~hit]
        return out
