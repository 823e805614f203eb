"""MinHash near-dedup by ProbMinHash: weighted word shingles, banding, exact verification, connected groups.

The weight of a shingle is its count in the text. Each shingle emits a Poisson process of arrivals whose rate is its
weight, drawn from its hash alone; an arrival falls into a register, and the first arrival of each register wins it.
A shingle stops once its clock has passed the last arrival of all registers (early termination). Two texts agree in a
register with the probability Jaccard similarity J_P of their shingle counts (Ertl, ProbMinHash, 2020).

Texts of one shingle multiset are collapsed first. Candidates share a band of registers. In each bucket every member
is verified against the smallest one, so a bucket of near copies costs a pair a member, whatever its size. Members that
this leaves in different groups are compared by their signatures, in blocks of a bounded number of members (a hot bucket
becomes many blocks; no pair is written before it is found), and verified where the signatures agree in at least the
threshold less ``SLACK`` standard deviations. That is the only candidate pair that isn't verified; one of similarity at
the threshold is lost so with probability 3e-5, against 0.045 by banding itself. No bucket is capped.

Defined cases: null texts and texts without words are in no group; a text of fewer words than a shingle is one
shingle; the smallest ``doc_id`` of a group stays; rows with a null ``doc_id`` are in no group and stay; rows that
share a ``doc_id`` are in the groups of any of them and stay or go together; repeated rows and ties of similarity change
nothing; an empty table has no groups; a very long text is shingled whole, in one block of about 100 bytes a character;
other columns, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import lists, map_text, materialise, meeting, read, signed, sized, texts_of, within, without

SHINGLE = 3
#: A pair at the threshold shares a band with probability 1 - (1 - 0.5**4)**48 = 0.955, at 0.6 with 0.999.
BANDS, ROWS = 48, 4
THRESHOLD = 0.5
#: A cross pair whose signatures agree in less than the threshold less four standard deviations isn't verified.
SLACK = 4.0
#: Members of a block of a bucket, about, and bytes of shingle sets that are verified at once.
BLOCK_MEMBERS, VERIFY_BYTES = 1024, 8 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(block: K.Block, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different shingles of each text in ascending order: hashes, counts, owners."""
    words, owner = K.word_hashes(block)
    h, inside = K.windows(words, owner, k)
    n = np.bincount(owner, minlength=len(block.starts))
    own = owner[: len(h)][inside]
    h = h[inside]
    for few in range(1, k):  # a text of fewer words is one shingle
        short = np.flatnonzero(n == few)
        if len(short):
            whole, _ = K.windows(words, owner, few)
            h, own = np.append(h, whole[np.searchsorted(owner, short)] + np.uint64(few)), np.append(own, short)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), own[at]


def probminhash(h: np.ndarray, weight: np.ndarray, owner: np.ndarray, docs: int, m: int) -> np.ndarray:
    """The winning shingle of each of m registers of each text; zero where a text has no shingle."""
    first = np.full(docs * m, np.inf)
    winner = np.zeros(docs * m, np.uint64)
    last = np.full(docs, np.inf)
    clock, rate, done = np.zeros(len(h)), weight.astype(np.float64), np.uint64(0)
    while len(h):
        # few shingles left: draw many arrivals of each at once
        many = int(min(256, max(1, 8192 // len(h))))
        r = K.mix((h[:, None] + (done + np.arange(1, many + 1, dtype=np.uint64)) * _GOLDEN))
        done += np.uint64(many)
        times = clock[:, None] + np.cumsum(-np.log1p(-(r >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate[:, None], axis=1)
        ok = times < last[owner][:, None]
        t = times[ok]
        at = (owner[:, None] * m + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64))[ok]
        np.minimum.at(first, at, t)
        won = first[at] == t
        winner[at[won]] = np.broadcast_to(h[:, None], times.shape)[ok][won]
        last = first.reshape(docs, m).max(1)
        clock = times[:, -1]
        alive = clock < last[owner]
        h, rate, owner, clock = h[alive], rate[alive], owner[alive], clock[alive]
    return winner.reshape(docs, m)


def signatures(docs: DataFrame, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, fp1, fp2, bands, sketch) of the rows that have words and a doc_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    m = bands * rows

    def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
        block = K.Block(texts_of(part))
        h, n, owner = shingles(block, k)
        if not len(h):
            return None
        docs = np.unique(owner)
        slim = np.searchsorted(docs, owner)
        won = probminhash(h, n, slim, len(docs), m)
        band = won.reshape(len(docs), bands, rows)
        key = np.zeros((len(docs), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN
        for j in range(rows):
            key = K.mix(key + band[:, :, j])
        first = np.flatnonzero(np.diff(slim, prepend=-1))
        one = K.mix(h ^ K.mix(n.astype(np.uint64)))
        sketch = (won >> np.uint64(48)).astype("<u2")
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(docs)), pa.array(signed(np.add.reduceat(one, first))), pa.array(signed(np.bitwise_xor.reduceat(one, first))), lists(np.arange(len(docs) + 1) * bands, signed(key.ravel()), pa.int64()), pa.array([s.tobytes() for s in sketch], pa.binary())],
            ["doc_id", "fp1", "fp2", "bands", "sketch"],
        )

    rows_in = docs.where("text is not null and doc_id is not null").select("doc_id", "text")
    return map_text(rows_in, run, f"doc_id {kind}, fp1 long, fp2 long, bands array<long>, sketch binary", chars=K_CHARS)


#: Smaller blocks here: a shingle takes more working memory than a character.
K_CHARS = 1 << 18


def weighted(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, hs, ns): the shingles in ascending order as 32-bit hashes, and their counts unless all are 1."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        block = K.Block(texts_of(part))
        h, n, owner = shingles(block, k)
        h = (h >> np.uint64(32)).astype("<u4")
        edges = np.searchsorted(owner, np.arange(len(block.starts) + 1)).tolist()
        ids = [h[a:b].tobytes() for a, b in zip(edges, edges[1:])]
        counts = [n[a:b].astype("<u4").tobytes() if (n[a:b] > 1).any() else b"" for a, b in zip(edges, edges[1:])]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "hs", "ns"])

    return map_text(docs.select("doc_id", "text"), run, f"doc_id {kind}, hs binary, ns binary")


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """J_P of two weighted sets given by ascending keys and positive weights."""
    if not len(ha) or not len(hb):
        return 0.0
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    ia = np.flatnonzero(hb[at] == ha)
    if not len(ia):
        return 0.0
    ib = at[ia]
    a, b = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    only_a, only_b = wa.sum() - a.sum(), wb.sum() - b.sum()
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    return float((1 / ((only_a + a.sum() - np.cumsum(a)) / a + (only_b + np.cumsum(b)) / b)).sum())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sides = ("a_hs", "a_ns", "b_hs", "b_ns")
    for batch in batches:
        size = np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in sides) + 1, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + VERIFY_BYTES, "right")))
            part = batch.slice(at, to - at)
            ha, na, hb, nb = ([np.frombuffer(x, "<u4") for x in part.column(c).to_pylist()] for c in sides)
            got = [probability_jaccard(h, n if len(n) else np.ones(len(h), np.uint32), g, m if len(m) else np.ones(len(g), np.uint32)) for h, n, g, m in zip(ha, na, hb, nb)]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(got, pa.float64())], ["a", "b", "similarity"])
            at = to


def similarities(docs: DataFrame, pairs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(a, b, similarity) of the pairs; each text of a pair is shingled once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    used = within(docs.where("text is not null").select("doc_id", "text"), ids)
    sets = materialise(weighted(used, k).dropDuplicates(["doc_id", "hs", "ns"]), "shingle-sets")
    a, b = (sets.select(F.col("doc_id").alias(s), F.col("hs").alias(f"{s}_hs"), F.col("ns").alias(f"{s}_ns")) for s in "ab")
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "a_hs", "a_ns", "b_hs", "b_ns").mapInArrow(_verify, f"a {kind}, b {kind}, similarity double")


def _agreeing(least: float, m: int):
    """Of rows (band, x, y, own, doc_id, root, sketch), sorted by the first three: the pairs (a, b) of a block's members
    of different roots whose sketches agree in at least this share; x = y: pairs within one part of a bucket."""

    def pairs(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        x, y = rows.column("x")[0].as_py(), rows.column("y")[0].as_py()
        own, (_, root) = rows.column("own").to_numpy(), np.unique(np.array(rows.column("root").to_pylist()), return_inverse=True)
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), "<u2").reshape(-1, m)
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        out = []
        for i in left:
            j = right[right > i] if x == y else right
            j = j[root[j] != root[i]]
            j = j[(sketch[j] == sketch[i]).mean(1) >= least] if len(j) else j
            if len(j):
                out.append(np.stack([np.full(len(j), i), j]))
        if not out:
            return None
        i, j = np.concatenate(out, 1)
        ids = rows.column("doc_id")
        a, b = ids.take(pa.array(i)), ids.take(pa.array(j))
        swap = pc.greater(a, b)
        return pa.RecordBatch.from_arrays([pc.if_else(swap, b, a), pc.if_else(swap, a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("band", "x", "y")])
            edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                now = tuple(key[:, a].tolist())
                if held and now != last:
                    out = pairs(_joined(held))
                    held = []
                    if out is not None:
                        yield out
                held.append(batch.slice(a, b - a))
                last = now
        if held and (out := pairs(_joined(held))) is not None:
            yield out

    return run


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def open_pairs(members: DataFrame, labels: DataFrame, sketches: DataFrame, least: float, m: int, block: int = BLOCK_MEMBERS) -> DataFrame:
    """(a, b): members (doc_id, band) of one bucket and different groups (labels: id, root) whose sketches agree."""
    kind = members.schema["doc_id"].dataType.simpleString()
    named = materialise(members.join(labels, members["doc_id"] == labels["id"], "left").select("doc_id", "band", F.coalesce("root", "doc_id").alias("root")), "roots")
    mixed = named.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("band", "n")
    rows = materialise(meeting(named, materialise(mixed, "mixed-bands"), "band", 16), "mixed")
    sketched = rows.join(within(sketches, rows.select("doc_id").distinct()), "doc_id")
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    placed = sketched.select("band", "doc_id", "root", "sketch", parts.alias("parts"), F.pmod(F.xxhash64("doc_id"), parts).cast("int").alias("own"))
    other = placed.select("band", "doc_id", "root", "sketch", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    blocks = other.select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "doc_id", "root", "sketch")
    return blocks.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y").mapInArrow(_agreeing(least, m), f"a {kind}, b {kind}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of the ids of edges (a, b): the smallest id that each is connected with, by alternating large-star and
    small-star rounds; each round is written, so the lineage stays short."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialise(small, "edges")
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == state:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = got


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, keep_id) of every document that isn't the smallest of its group."""
    sigs = materialise(signatures(docs, k, bands, rows), "signatures")
    alike = sigs.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("most")).where("rep <> most").drop("most")
    # by row: an id may have other texts, whose signatures stay
    same = materialise(sigs.select("doc_id", "fp1", "fp2").join(sized(alike, 32), ["fp1", "fp2"]).where("doc_id <> rep").distinct(), "same")
    gone = same.select(F.col("doc_id").alias("gone"), F.col("fp1").alias("gone1"), F.col("fp2").alias("gone2"))
    first = sigs.join(sized(gone, 32), (F.col("doc_id") == F.col("gone")) & (F.col("fp1") == F.col("gone1")) & (F.col("fp2") == F.col("gone2")), "left_anti")
    each = first.select("doc_id", F.explode("bands").alias("band"))
    # a row a task and bucket is all that goes to the bucket; most buckets are of one member and end here
    hubs = materialise(each.groupBy("band").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("most")).where("hub <> most").drop("most"), "hubs")
    members = materialise(meeting(each, hubs, "band", 16), "buckets")
    star = materialise(members.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), "star")
    checked = similarities(docs, star, k).where(F.col("similarity") >= threshold).select("a", "b")
    good = materialise(checked.unionByName(same.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))), "links")
    labels = components(good)
    # what the first round left open: pairs of one bucket in different groups
    m = bands * rows
    least = threshold - SLACK * (threshold * (1 - threshold) / m) ** 0.5
    agreed = open_pairs(members.select("doc_id", "band"), labels, first.select("doc_id", "sketch"), least, m)
    more = materialise(agreed.join(star, ["a", "b"], "left_anti"), "cross")
    if not more.isEmpty():
        found = similarities(docs, more, k).where(F.col("similarity") >= threshold).select("a", "b")
        labels = components(good.unionByName(found))
    return labels.select(F.col("id").alias("doc_id"), F.col("root").alias("keep_id")).where("doc_id <> keep_id").groupBy("doc_id").agg(F.min("keep_id").alias("keep_id"))


def near_deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs with the smallest document of each group of near copies."""
    gone = materialise(near_groups(docs, **options), "near-copies")
    return without(docs, gone)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, dup_of): near copies and the document of their group that stays."""
    return near_groups(read(spark, sf_dir, "documents")).withColumnRenamed("keep_id", "dup_of")
