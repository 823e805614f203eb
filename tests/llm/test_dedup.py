import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from loomquery.llm import common, exact_dedup, near_dedup
from loomquery.llm import kernels as K

SCHEMA = "doc_id long, text string, lang string, key long, ids string, band long, drop_id long, n int"


def rows(spark, pairs):
    return spark.createDataFrame([(i, t, None, 7, "x", 1, i, None) for i, t in pairs], SCHEMA)


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(3)
    base = [words(r, n) for n in (3, 40, 400, 5000, 60, 60)]
    pairs = [(i, t) for i, t in enumerate(base)]
    pairs += [(100, base[1]), (101, base[1]), (102, base[3]), (None, base[2]), (None, "only without id"), (None, "only without id"), (103, None), (104, None), (105, ""), (106, ""), (1, base[1]), (107, "short"), (107, "another text of one id")]
    return pairs


@pytest.mark.parametrize("bits,limit", [(64, common.BROADCAST_BYTES), (3, common.BROADCAST_BYTES), (64, 0)])
def test_exact(spark, corpus, bits, limit, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    docs = rows(spark, corpus)
    want, keep = set(), Counter()
    for text, group in itertools.groupby(sorted((x for x in corpus if x[1] is not None), key=lambda x: x[1]), key=lambda x: x[1]):
        ids = [i for i, _ in group]
        known = [i for i in ids if i is not None]
        first = min(known) if known else None
        want |= {(i, first) for i in known if i != first}
        keep[(first, text)] += 1
    assert {tuple(r) for r in exact_dedup.copies(docs, bits).collect()} == want
    left = exact_dedup.deduplicate(docs, bits)
    assert left.columns == docs.columns
    keep[(103, None)] += 1
    keep[(104, None)] += 1
    assert Counter((r.doc_id, r.text) for r in left.collect()) == keep


def test_chunks_follow_the_content():
    r = random.Random(0)
    a = words(r, 20000).encode()
    cut = exact_dedup.cuts(a)
    assert cut[-1] == len(a) and all(0 < y - x <= exact_dedup.MOST_CHUNK for x, y in zip([0, *cut], cut))
    moved = b"inserted at the front " + a
    shared = {a[x:y] for x, y in zip([0, *cut], cut)} & {moved[x:y] for x, y in zip([0, *exact_dedup.cuts(moved)], exact_dedup.cuts(moved))}
    assert len(shared) > 0.8 * len(cut)
    assert exact_dedup.cuts(b"") == [] and exact_dedup.cuts(b"x") == [1]
    assert exact_dedup.cuts(b"\0" * 50000)[-1] == 50000


def test_empty_tables(spark):
    empty = rows(spark, [])
    assert exact_dedup.copies(empty).collect() == [] and exact_dedup.deduplicate(empty).collect() == []
    assert near_dedup.near_groups(empty).collect() == [] and near_dedup.near_deduplicate(empty).collect() == []


def naive(a, b):
    a, b = Counter(a), Counter(b)
    total = 0.0
    for d in a.keys() & b.keys():
        total += 1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys())
    return total


def test_probability_jaccard_and_its_estimate():
    r = random.Random(5)
    for _ in range(20):
        a, b = (Counter(r.choices(range(12), k=r.randint(1, 30))) for _ in "ab")
        arrays = [(np.array(sorted(x)), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert near_dedup.probability_jaccard(*arrays[0], *arrays[1]) == pytest.approx(naive(a, b))
    h = K.mix(np.arange(1, 60, dtype=np.uint64))
    a, b = {i: 1 + i % 5 for i in range(40)}, {i: 1 + i % 3 for i in range(15, 59)}
    m = 4096
    sig = [near_dedup.probminhash(h[list(x)], np.array(list(x.values())), np.zeros(len(x), int), 1, m)[0] for x in (a, b)]
    assert (sig[0] == sig[1]).mean() == pytest.approx(naive(a, b), abs=4 * (0.25 / m) ** 0.5)
    alone = near_dedup.probminhash(h[:1], np.array([3]), np.zeros(1, int), 1, 192)
    assert (alone == h[0]).all()


def brute_groups(pairs, threshold):
    texts = {}
    for i, t in pairs:
        if i is not None and t:
            texts.setdefault(i, []).append(t)
    sets = []
    for i, ts in texts.items():
        for t in ts:
            b = K.Block([t])
            h, n, _ = near_dedup.shingles(b)
            if len(h):
                sets.append((i, h, n))
    root = {i: i for i, _, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, h, n), (j, g, m) in itertools.combinations(sets, 2):
        if near_dedup.probability_jaccard(h, n, g, m) >= threshold:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in root if find(i) != i}


def test_near(spark):
    r = random.Random(9)
    pairs = []
    for g in range(6):
        base = words(r, 150).split()
        for c in range(1 if g == 5 else 6):
            w = list(base)
            for _ in range(c):
                w[r.randrange(len(w))] = words(r, 1)
            pairs.append((g * 10 + c, " ".join(w)))
    chain = words(r, 80).split()
    pairs += [(200 + s, " ".join(chain[s * 6 : s * 6 + 40])) for s in range(5)]  # each like the next, the ends unlike
    passage = words(r, 60)
    pairs += [(300 + s, words(r, 200) + " " + passage) for s in range(12)]  # one passage in different texts
    pairs += [(400, "two words"), (401, "two words"), (402, "Two, words!"), (403, "other words"), (None, "two words"), (404, None), (405, ""), (406, "..."), (0, pairs[0][1])]
    docs = rows(spark, pairs)
    got = {x.doc_id: x.keep_id for x in near_dedup.near_groups(docs).collect()}
    want = brute_groups(pairs, near_dedup.THRESHOLD)
    assert got == want
    left = Counter((x.doc_id, x.text) for x in near_dedup.near_deduplicate(docs).collect())
    assert left == Counter((i, t) for i, t in pairs if i not in want)


def test_cross_pairs_join_groups(spark):
    """Without the second round the members of a bucket are compared with its smallest only."""
    r = random.Random(2)
    base = words(r, 100).split()
    a, b, c = base[:70], base[12:82], base[24:94]
    pairs = [(1, " ".join(a)), (2, " ".join(c)), (3, " ".join(b))]
    got = {x.doc_id: x.keep_id for x in near_dedup.near_groups(rows(spark, pairs), threshold=0.65).collect()}
    assert got == brute_groups(pairs, 0.65)


def test_blocks_give_all_pairs(spark):
    """Members of mixed buckets meet whatever the size of the blocks, in copies that no pair of one root is in."""
    r = np.random.default_rng(6)
    sketch = r.integers(0, 3, (60, 8)).astype("<u2")
    members = spark.createDataFrame([(i, b) for i in range(60) for b in (1, 2 + i % 2)], "doc_id long, band long")
    labels = spark.createDataFrame([(i, i // 7) for i in range(60)], "id long, root long")
    sketches = spark.createDataFrame([(i, sketch[i].tobytes()) for i in range(60)], "doc_id long, sketch binary")
    want = {(i, j) for i, j in itertools.combinations(range(60), 2) if i // 7 != j // 7 and (sketch[i] == sketch[j]).mean() >= 0.5}
    for block in (5, 1000):
        got = [tuple(x) for x in near_dedup.open_pairs(members, labels, sketches, 0.5, 8, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_hot_bucket_of_near_copies(spark):
    """One group of many near copies: pairs verified grow with its members, and all are found."""
    r = random.Random(11)
    base = words(r, 60).split()
    pairs = []
    for i in range(2000):
        w = list(base)
        w[i % 60] = words(r, 1)
        pairs.append((i, " ".join(w)))
    got = {x.doc_id: x.keep_id for x in near_dedup.near_groups(rows(spark, pairs)).collect()}
    assert got == {i: 0 for i in range(1, 2000)}


def test_long_text(spark):
    r = random.Random(12)
    long = words(r, 120_000)
    got = {x.doc_id: x.keep_id for x in near_dedup.near_groups(rows(spark, [(1, long), (2, long + " a tail of words"), (3, words(r, 50))])).collect()}
    assert got == {2: 1}


def test_filters_of_ids_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    docs = rows(spark, [(i if i else None, str(i)) for i in range(500)])
    ids = spark.range(0, 1000, 3).select(F.col("id").cast("int").alias("doc_id"))
    assert sorted(x.doc_id for x in common.within(docs, ids).collect()) == [i for i in range(3, 500, 3)]
    left = common.without(docs, ids)
    assert left.columns == docs.columns and sorted(x.doc_id or 0 for x in left.collect()) == [0] + [i for i in range(1, 500) if i % 3]
    bloom = common.Bloom.of(spark.range(5000).select(F.xxhash64("id")), 5000)
    h = np.array([x[0] for x in spark.range(20_000).select(F.xxhash64("id")).collect()]).view(np.uint64)
    assert bloom.holds(h[:5000]).all() and bloom.holds(h[5000:]).mean() < 0.05


def test_repeated_ids_keep_their_other_texts(spark):
    r = random.Random(4)
    a, b = words(r, 80), words(r, 80)
    pairs = [(3, a), (7, a), (7, b), (9, b + " and more")]
    got = {x.doc_id: x.keep_id for x in near_dedup.near_groups(rows(spark, pairs)).collect()}
    assert got == brute_groups(pairs, near_dedup.THRESHOLD) == {7: 3, 9: 3}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(50, 41), (41, 60), (7, 7)]
    got = {r.id: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 50: 41, 60: 41}


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="the tables aren't here")
def test_recall_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute_groups(pairs, near_dedup.THRESHOLD)
    got = {r.doc_id: r.keep_id for r in near_dedup.near_groups(docs).collect()}
    assert len(got.keys() & want.keys()) >= 0.9 * len(want) and got.keys() <= want.keys()
