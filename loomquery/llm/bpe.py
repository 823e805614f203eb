"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation: codepoint classes become symbols of a small automaton (letters, numbers, other, white space by what
follows it, apostrophes that may begin a contraction). Each symbol is a function of the states; functions compose, and
composition is associative, so the state before every character comes from a blocked scan: functions of blocks, a
prefix scan over the blocks, then the states within all blocks at once. A table of the finitely many compositions makes
each step one lookup. Boundaries give slices, which a cache turns into tokens by the hashes of all slices at once; slices not
met before are merged together, the pair of lowest rank first and leftmost first, as the rank file demands. The tokens
of a block are compared with its bytes, so two slices of one hash can't pass for each other. Each token keeps its byte
offset.

Defined cases: null text gives null lists, empty text empty ones; special tokens are ordinary text; unknown ids make
``decode`` raise; a null ``ids`` decodes to null; rows without an id or repeated rows are encoded like any others; of pairs
of one rank the leftmost is merged first; a very long text is one block of about 60 bytes a character, and a slice without
a boundary is merged in n log n steps; an empty table gives no rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K
from .common import map_text, read

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Different slices kept by a worker before it starts anew, and the bits of the cache's table.
CACHE_SLICES, CACHE_BITS = 300_000, 20
#: Slices of more bytes are merged one by one with a heap, in n log n steps.
LONG_SLICE = 256
#: Characters that are encoded at once: more than other kernels take, as a block's fixed costs are higher here.
ENCODE_CHARS = 1 << 19
#: Tokens that are decoded at once.
DECODE_TOKENS = 1 << 18
SCAN = 128
_END, _L, _N, _O, _W, _P, _C1, _C2 = range(8)
_SL, _SN, _SO, _SW, _SP, _SQ, _A2, _A3 = range(8)


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Next state and boundary by symbol and state, the compositions of functions, the functions' images."""
    nxt, cut = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    for sym, to, runs_on in ((_SL, _L, (_L, _P)), (_SN, _N, (_N, _P)), (_SO, _O, (_O, _P)), (_SW, _W, (_W,)), (_SP, _P, ()), (_SQ, _END, ()), (_A2, _C1, ()), (_A3, _C2, ())):
        nxt[sym] = to
        for s in runs_on:
            cut[sym, s] = False
    for s in (_O, _P):  # an apostrophe inside a run of other characters begins no contraction
        nxt[[_A2, _A3], s] = _O
        cut[[_A2, _A3], s] = False
    nxt[_SL, [_C1, _C2]] = _END, _C1
    cut[_SL, [_C1, _C2]] = False
    functions = [tuple(row) for row in nxt.tolist()]
    known = {f: i for i, f in reversed(list(enumerate(functions)))}
    at = 0
    while at < len(functions):
        for g in nxt.tolist():
            h = tuple(g[s] for s in functions[at])
            if h not in known:
                known[h] = len(functions)
                functions.append(h)
        at += 1
    image = np.array(functions, np.uint8)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    return nxt, cut, compose, image


def symbols(block: K.Block) -> np.ndarray:
    cps = block.cps
    kind = K.tables()[0][cps]
    sym = np.array([_SO, _SL, _SN, _SP, _SQ, _SO], np.uint8)[kind]
    white = (kind == K.SPACE) | (kind == K.WHITE)
    more = np.append(white[1:], True)
    sym[white & more] = _SW
    a = np.flatnonzero(cps == 39)
    if len(a):
        a = a[a + 1 < len(cps)]
        x, y = cps[a + 1], cps[np.minimum(a + 2, len(cps) - 1)]
        sym[a[np.isin(x, [ord(c) for c in "stmd"])]] = _A2
        sym[a[((x == 114) & (y == 101)) | ((x == 118) & (y == 101)) | ((x == 108) & (y == 108))]] = _A3
    sym[block.ends] = _SQ  # between texts
    return sym


def boundaries(sym: np.ndarray) -> np.ndarray:
    """Where a slice begins, by the blocked scan of transition functions."""
    nxt, cut, compose, image = automaton()
    n = len(sym)
    blocks = -(-n // SCAN)
    padded = np.full(blocks * SCAN, _SQ, np.uint8)
    padded[:n] = sym
    by_step = np.ascontiguousarray(padded.reshape(blocks, SCAN).T)
    whole = by_step[0].astype(np.uint16)  # symbol i is function i
    for j in range(1, SCAN):
        whole = compose[whole, by_step[j]]
    ahead = 1
    while ahead < blocks:  # inclusive prefix scan over the blocks
        joined = whole.copy()
        joined[ahead:] = compose[whole[:-ahead], whole[ahead:]]
        whole, ahead = joined, 2 * ahead
    state = np.zeros(blocks, np.uint8)
    state[1:] = image[whole[:-1], _END]
    out = np.empty((SCAN, blocks), bool)
    for j in range(SCAN):
        out[j] = cut[by_step[j], state]
        state = nxt[by_step[j], state]
    return out.T.ravel()[:n]


def slices(block: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the slices of all texts."""
    cut = boundaries(symbols(block))
    cut[block.ends] = True
    at = np.flatnonzero(cut)
    ends = np.append(at[1:], len(block.cps))
    real = np.ones(len(at), bool)
    real[np.searchsorted(at, block.ends)] = False
    return at[real], ends[real]


class Cache:
    """An open-addressed table from hashes to numbers, read and filled by whole arrays."""

    def __init__(self):
        self.keys, self.values, self.n = np.zeros(1 << CACHE_BITS, np.uint64), np.zeros(1 << CACHE_BITS, np.int32), 0
        self.shift, self.mask = np.uint64(64 - CACHE_BITS), (1 << CACHE_BITS) - 1

    def get(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash (none is 0), -1 where it is missing."""
        at = (h >> self.shift).astype(np.int64)
        held = self.keys[at]
        out = np.where(held == h, self.values[at], -1)
        left = np.flatnonzero((held != h) & (held != 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            held = self.keys[at[left]]
            hit = held == h[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (held != 0)]
        return out

    def add(self, h: np.ndarray) -> None:
        """Number different hashes, none of which is held, from the count of those held on."""
        at, number = (h >> self.shift).astype(np.int64), self.n + np.arange(len(h), dtype=np.int32)
        self.n += len(h)
        while len(h):
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]] = h[free]  # of several for one place the last gets it
            got = free[self.keys[at[free]] == h[free]]
            self.values[at[got]] = number[got]
            rest = np.ones(len(h), bool)
            rest[got] = False
            h, number, at = h[rest], number[rest], (at[rest] + 1) & self.mask


class Encoder:
    """Ranks, the table of mergeable pairs, and the cache of slices."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.length = np.fromiter(map(len, self.bytes), np.int64, self.size)
        self.starts = np.append(0, np.cumsum(self.length))
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs, made = [], []
        for token, rank in ranks.items():
            for j in range(1, len(token)):
                a, b = ranks.get(token[:j]), ranks.get(token[j:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    made.append(rank)
        self.pairs = K.SortedHash(np.array(pairs, np.uint64))
        self.made_of: dict | None = None
        self.made = np.append(np.array(made, np.int64)[self.pairs.order], np.iinfo(np.int64).max)
        self.clear()

    def clear(self) -> None:
        self.cache = Cache()
        self.ids = np.empty(0, np.int32)
        self.at, self.n = np.empty(0, np.int64), np.empty(0, np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.made[self.pairs.find((a << 32 | b).view(np.uint64))]

    def merge_long(self, word: bytes) -> list[int]:
        """Tokens of one long word: a linked list of tokens and a heap of pairs by rank, then place."""
        if self.made_of is None:
            keys = self.pairs.keys[self.pairs.order]
            self.made_of = dict(zip(zip((keys >> np.uint64(32)).tolist(), (keys & np.uint64(0xFFFFFFFF)).tolist()), self.made.tolist()))
        made = self.made_of
        ids: list = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(made[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in made]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of them was merged meanwhile
            ids[i], ids[j] = rank, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                p = (rank, ids[k])
                if p in made:
                    heapq.heappush(heap, (made[p], i, *p))
            h = before[i]
            if h >= 0:
                p = (ids[h], rank)
                if p in made:
                    heapq.heappush(heap, (made[p], h, *p))
        return [x for x in ids if x is not None]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in order, and how many each has."""
        long = [i for i, w in enumerate(words) if len(w) > LONG_SLICE]
        if not long:
            return self._merge(words)
        ids, n = self._merge([b"" if len(w) > LONG_SLICE else w for w in words])
        parts = np.split(ids, np.cumsum(n)[:-1])
        for i in long:
            parts[i] = np.array(self.merge_long(words[i]), np.int32)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        far = np.iinfo(np.int64).max
        n = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.single[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), n)
        rank = np.full(len(ids), far)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self._rank(ids[inner], ids[inner + 1])
        done_ids, done_words = [], []
        while len(ids):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            over = least == far
            if over.any():
                out = np.repeat(over, size)
                done_ids.append(ids[out])
                done_words.append(word[out])
                left = ~out
                ids, word, rank, least, size = ids[left], word[left], rank[left], least[~over], size[~over]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            at = hit[np.flatnonzero(np.diff(word[hit], prepend=-1))]  # the leftmost of each word
            ids[at] = rank[at]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            ids, word, rank = ids[stay], word[stay], rank[stay]
            at = at - np.arange(len(at))
            for pos in (at, at[at > 0] - 1):
                last = len(ids) - 1
                ok = (pos < last) & (word[np.minimum(pos + 1, last)] == word[pos])
                rank[pos[~ok]] = far
                pos = pos[ok]
                rank[pos] = self._rank(ids[pos], ids[pos + 1])
        if not done_ids:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        all_words = np.concatenate(done_words)
        order = np.argsort(all_words, kind="stable")
        return np.concatenate(done_ids)[order].astype(np.int32), np.bincount(all_words, minlength=len(words))

    def encode(self, block: K.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all texts, how many each text has, and the byte offset of each token in its text."""
        starts, ends = slices(block)
        out = self._tokens(block, starts, ends, self._numbers(block, starts, ends))
        raw, data = np.frombuffer(block.text.encode(), np.uint8), self.flat[_spread(self.starts[out[0]], self.length[out[0]])]
        between = block.ends
        if len(raw) > len(block.cps):
            wider = (block.cps >= 0x80).astype(np.uint8) + (block.cps >= 0x800) + (block.cps >= 0x10000)
            between = between + np.cumsum(wider, dtype=np.int64)[between]
        if not np.array_equal(np.delete(raw, between), data):  # two slices of one hash: go by the slices themselves
            self.clear()
            words = [block.text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
            number = {w: i for i, w in enumerate(dict.fromkeys(words))}
            self._append([w.encode() for w in number])
            out = self._tokens(block, starts, ends, np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            self.clear()
        return out

    def _numbers(self, block: K.Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each slice in the cache, after those not met before were merged."""
        if self.cache.n > CACHE_SLICES:
            self.clear()
        h = K.span(K.prefix_sums(block.cps), starts, ends)
        h[h == 0] = 1
        index = self.cache.get(h)
        miss = np.flatnonzero(index < 0)
        if len(miss):
            new, first = np.unique(h[miss], return_index=True)
            at = miss[first]
            self._append([block.text[a:b].encode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            self.cache.add(new)
            index[miss] = self.cache.get(h[miss])
        return index

    def _append(self, words: list[bytes]) -> None:
        ids, n = self.merge(words)
        self.at = np.append(self.at, len(self.ids) + np.cumsum(n) - n)
        self.ids, self.n = np.append(self.ids, ids), np.append(self.n, n)

    def _tokens(self, block: K.Block, starts: np.ndarray, ends: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.n[index]
        ids = self.ids[_spread(self.at[index], n)]
        per_text = np.add.reduceat(np.append(n, 0), np.append(np.searchsorted(starts, block.starts), len(n))[:-1]) if len(n) else np.zeros(len(block.starts), np.int64)
        per_text = np.where(block.starts == block.ends, 0, per_text)
        width = self.length[ids]
        offsets = np.cumsum(width) - width
        base = np.append(0, np.cumsum(width))[np.append(0, np.cumsum(per_text))[:-1]]
        return ids, per_text, offsets - np.repeat(base, per_text)

    def decode(self, ids: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and how many each has."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is not in the vocabulary")
        width = self.length[ids]
        sums = np.append(0, np.cumsum(width))
        return self.flat[_spread(self.starts[ids], width)], np.diff(sums[np.append(0, np.cumsum(per_text))])


def _spread(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + n[i] - 1 of all i."""
    before = np.cumsum(n) - n
    return np.repeat(starts - before, n) + np.arange(int(n.sum()))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One a worker and vocabulary."""
    return Encoder(path)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, offsets, round_trip) of every row; round_trip: the ids decode to the very bytes of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = part.column("text").to_pylist()
        block = K.Block([t or "" for t in texts])
        e = encoder(vocabulary)
        ids, n, offsets = e.encode(block)
        data, size = e.decode(ids, n)
        ends = np.cumsum(size)
        data = data.tobytes()
        good = [None if t is None else data[b - s : b] == t.encode() for t, b, s in zip(texts, ends.tolist(), size.tolist())]
        none = pa.array([t is None for t in texts])
        edges = pa.array(np.append(0, np.cumsum(n)), pa.int32())
        columns = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int32()), mask=none) for x in (ids, offsets)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, pa.array(good, pa.bool_())], ["doc_id", "ids", "offsets", "round_trip"])

    return map_text(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids array<int>, offsets array<int>, round_trip boolean", chars=ENCODE_CHARS)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, ids)."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        e = encoder(vocabulary)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(batch.column("ids").value_lengths(), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:  # runs of rows of bounded length
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DECODE_TOKENS, "right")))
                part = batch.slice(at, to - at)
                lists = part.column("ids")
                n = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                data, size = e.decode(lists.flatten().to_numpy(zero_copy_only=False), n)
                data, to_byte = data.tobytes(), np.cumsum(size).tolist()
                text = [data[b - s : b].decode("utf-8", "replace") if ok else None for b, s, ok in zip(to_byte, size.tolist(), lists.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])
                at = to

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
