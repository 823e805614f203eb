"""Token-ID output as one wavelet matrix a shard.

The tokens of a shard, its documents in order of id, become bit planes from the highest bit down; each plane keeps the
order of the plane above with all zeros first. Planes are stored in blocks, compressed where that helps, with the ones
before each block, so that one file answers token access, counting (rank) and occurrence lookup (select) by opening one
block a plane. Document boundaries and ids stand in the same file.

Shards are runs of hash values of id and text; a task writes several, each by itself, so a shard needs memory for its own
tokens only. One document longer than a shard makes its shard as long (4 bytes a token and plane at work).

Defined cases: null and empty texts have no tokens but are listed; documents of one id, or of none, are told apart by
their text only and keep an arbitrary order among equals; repeated rows are listed as often as they stand; ids that are
neither strings nor integers are kept as strings in the file; an empty table gives no shard; other columns play no part.
"""

from __future__ import annotations

import builtins
import json
import mmap
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .bpe import ENCODE_CHARS, VOCABULARY, encoder
from .common import map_text, read, texts_of

#: Bytes of text a shard and a task, about; small shards, so that small tables are divided too.
SHARD_BYTES, TASK_BYTES = 512 << 10, 8 << 20
BLOCK_BITS = 1 << 15
_MAGIC = b"LQWM1\0"


def build(tokens: np.ndarray, doc_ids: list, doc_tokens: np.ndarray, bits: int) -> bytes:
    """The file of a shard. tokens: unsigned integers below 2**bits; doc_tokens: how many each document has."""
    pack = zstandard.ZstdCompressor(level=1)
    data, offsets, ones, zeros = [], [], [], []
    at = 0
    step = BLOCK_BITS // 8
    for b in range(bits - 1, -1, -1):
        bit = (tokens >> b & 1).astype(bool)
        packed = np.packbits(bit)
        blocks = -(-len(packed) // step)
        padded = np.zeros(blocks * step, np.uint8)
        padded[: len(packed)] = packed
        counts = np.bitwise_count(padded).reshape(blocks, step).sum(1, dtype=np.int64) if blocks else np.zeros(0, np.int64)
        ones.append(np.append(0, np.cumsum(counts)))
        for j in range(blocks):
            raw = packed[j * step : (j + 1) * step].tobytes()
            small = pack.compress(raw)
            small = small if len(small) < len(raw) else raw
            data.append(small)
            offsets.append(at)
            at += len(small)
        zeros.append(len(tokens) - int(ones[-1][-1]))
        tokens = np.concatenate([tokens[~bit], tokens[bit]])
    offsets.append(at)
    docs = pack.compress(json.dumps(doc_ids).encode())
    counts = pack.compress(np.asarray(doc_tokens, "<u4").tobytes())
    head = struct.pack("<QIIII", len(tokens), bits, len(doc_ids), len(docs), len(counts)) + np.array(zeros, "<u8").tobytes() + np.array(offsets, "<u8").tobytes() + (np.concatenate(ones) if ones else np.zeros(0)).astype("<u8").tobytes()
    return b"".join([_MAGIC, head, docs, counts, *data])


class WaveletMatrix:
    """Random access to a shard's file without decoding it as a whole."""

    def __init__(self, blob: bytes):
        if blob[: len(_MAGIC)] != _MAGIC:
            raise ValueError("not a token shard")
        at = len(_MAGIC)
        self.n, self.bits, docs, doc_len, count_len = struct.unpack_from("<QIIII", blob, at)
        at += 24
        self.blocks = -(-self.n // BLOCK_BITS)

        def take(n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, "<u8", n, at).astype(np.int64)
            at += 8 * n
            return out

        self.zeros = take(self.bits)
        self.offsets = take(self.bits * self.blocks + 1)
        self.ones = take(self.bits * (self.blocks + 1)).reshape(self.bits, self.blocks + 1)
        open_ = zstandard.ZstdDecompressor().decompress
        self.doc_ids = json.loads(open_(blob[at : at + doc_len]))
        at += doc_len
        self.doc_starts = np.append(0, np.cumsum(np.frombuffer(open_(blob[at : at + count_len]), "<u4").astype(np.int64)))
        self.base = at + count_len
        self.blob, self._open, self._kept = blob, open_, {}

    @classmethod
    def open(cls, path: str) -> WaveletMatrix:
        """A file on a local or mounted path, of which only the directory and the blocks asked for are read."""
        with builtins.open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def _block(self, plane: int, j: int) -> np.ndarray:
        """The bits of a block."""
        key = plane * self.blocks + j
        if key not in self._kept:
            if len(self._kept) > 256:
                self._kept.clear()
            raw = self.blob[self.base + self.offsets[key] : self.base + self.offsets[key + 1]]
            size = min(BLOCK_BITS, self.n - j * BLOCK_BITS)
            if len(raw) < (size + 7) // 8:
                raw = self._open(raw)
            self._kept[key] = np.unpackbits(np.frombuffer(raw, np.uint8))[:size]
        return self._kept[key]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        j, rest = divmod(i, BLOCK_BITS)
        return int(self.ones[plane, j]) + (int(self._block(plane, j)[:rest].sum()) if rest else 0)

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Where the k-th (from 0) such bit of a plane is."""
        before = self.ones[plane] if bit else np.minimum(np.arange(self.blocks + 1) * BLOCK_BITS, self.n) - self.ones[plane]
        j = int(np.searchsorted(before, k, "right")) - 1
        return j * BLOCK_BITS + int(np.flatnonzero(self._block(plane, j) == bit)[k - before[j]])

    def access(self, i: int) -> int:
        """The token at a position."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for p in range(self.bits):
            j, rest = divmod(i, BLOCK_BITS)
            bit = int(self._block(p, j)[rest])
            token = token << 1 | bit
            ones = self._rank1(p, i)
            i = int(self.zeros[p]) + ones if bit else i - ones
        return token

    def _descend(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's range begins in the last order, and where the first i positions end in it."""
        lo, hi = 0, i
        for p in range(self.bits):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            lo, hi = (int(self.zeros[p]) + a, int(self.zeros[p]) + b) if token >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int | None = None) -> int:
        """How often the token occurs among the first i positions (all, if not given)."""
        if token < 0 or token >> self.bits or not self.n:
            return 0
        lo, hi = self._descend(token, self.n if i is None else min(i, self.n))
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """The position of the k-th (from 0) occurrence of the token."""
        if not 0 <= k < self.rank(token):
            raise IndexError(k)
        i = self._descend(token, 0)[0] + k
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            i = self._select(p, bit, i - int(self.zeros[p]) if bit else i)
        return i

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The tokens at all positions of a range, plane by plane."""
        if not 0 <= start <= end <= self.n:
            raise IndexError((start, end))
        at = np.arange(start, end)
        out = np.zeros(len(at), np.int64)
        for p in range(self.bits):
            bit, ones = np.zeros(len(at), np.uint8), np.zeros(len(at), np.int64)
            for j in np.unique(at // BLOCK_BITS).tolist():
                own = np.flatnonzero(at // BLOCK_BITS == j)
                block = self._block(p, j)
                rest = at[own] - j * BLOCK_BITS
                bit[own] = block[rest]
                ones[own] = self.ones[p, j] + np.append(0, np.cumsum(block, dtype=np.int64))[rest]
            out = out << 1 | bit
            at = np.where(bit, self.zeros[p] + ones, at - ones)
        return out

    def document(self, i: int) -> np.ndarray:
        """The tokens of the i-th document of the shard."""
        return self.tokens(int(self.doc_starts[i]), int(self.doc_starts[i + 1]))


def token_shards(docs: DataFrame, vocabulary: str = VOCABULARY, shard_bytes: int = SHARD_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(shard, n_docs, n_tokens, doc_ids, file) of each shard. Only token ids, two bytes each where the vocabulary allows,
    are shuffled."""
    if docs.schema["doc_id"].dataType.simpleString() not in ("string", "int", "bigint"):
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    tasks = int(min(n, max(1, -(-total // task_bytes)), 100_000))
    size = encoder(vocabulary).size
    bits = max(1, (size - 1).bit_length())
    width = "<u2" if bits <= 16 else "<u4"

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, per_text, _ = encoder(vocabulary).encode(K.Block(texts_of(part)))
        raw, ends = ids.astype(width).tobytes(), np.cumsum(per_text) * int(width[2])
        tokens = [raw[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays([part.column("shard"), part.column("doc_id"), pa.array(tokens, pa.binary())], ["shard", "doc_id", "tokens"])

    placed = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("shard"), "doc_id", "text")
    coded = map_text(placed, run, f"shard int, doc_id {kind}, tokens binary", chars=ENCODE_CHARS)
    ordered = coded.repartitionById(tasks, (F.col("shard").cast("long") * tasks / n).cast("int")).sortWithinPartitions("shard", "doc_id", "tokens")

    def finish(shard: int, ids: list, tokens: list[bytes]) -> pa.RecordBatch:
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens)) // int(width[2])
        flat = np.frombuffer(b"".join(tokens), width)
        blob = build(flat, [i if isinstance(i, (int, str, type(None))) else str(i) for i in ids], counts, bits)
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([blob], pa.binary())], ["shard", "n_docs", "n_tokens", "doc_ids", "file"])

    id_type = pa.string() if kind == "string" else pa.int32() if kind == "int" else pa.int64()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, tokens = None, [], []
        for batch in batches:
            column = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), len(column)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if now is not None and column[a] != now:
                    yield finish(now, ids, tokens)
                    ids, tokens = [], []
                now = int(column[a])
                ids += batch.column("doc_id").slice(a, b - a).to_pylist()
                tokens += batch.column("tokens").slice(a, b - a).to_pylist()
        if now is not None:
            yield finish(now, ids, tokens)

    return ordered.mapInArrow(shards, f"shard int, n_docs long, n_tokens long, doc_ids array<{kind}>, file binary")


def write_files(shards: DataFrame, folder: str) -> DataFrame:
    """Write each shard as {folder}/shard-<number>.lqwm; (shard, path, n_tokens) of those written. folder: a path that all
    executors share, or a URI of a file system that Arrow knows (hdfs, s3, gs). A file appears whole or not at all, and a
    task that is run again writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            names = [f"shard-{shard:06d}.lqwm" for shard in batch.column("shard").to_pylist()]
            for name, blob in zip(names, batch.column("file").to_pylist()):
                beside = f"{root}/{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as f:
                    f.write(blob)
                store.move(beside, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array([f"{folder}/{n}" for n in names], pa.string()), batch.column("n_tokens")], ["shard", "path", "n_tokens"])

    return shards.select("shard", "file", "n_tokens").mapInArrow(run, "shard int, path string, n_tokens long")


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(read(spark, sf_dir, "documents"))
