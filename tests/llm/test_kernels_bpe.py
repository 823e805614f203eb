import base64
import os

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomquery.llm import bpe
from loomquery.llm import kernels as K

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'stremvdl \n\t .!é中1２ x́😀<|>"), max_size=30), min_size=1, max_size=8))
def test_encode_like_the_reference_and_back(reference, texts):
    e = bpe.encoder(bpe.VOCABULARY)
    ids, n, offsets = e.encode(K.Block(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [reference.encode_ordinary(t) for t in texts]
    data, size = e.decode(ids, n)
    assert data.tobytes() == "".join(texts).encode() and size.tolist() == [len(t.encode()) for t in texts]
    for t, i, o in zip(texts, np.split(ids, np.cumsum(n)[:-1]), np.split(offsets, np.cumsum(n)[:-1])):
        assert all(t.encode()[a : a + len(e.bytes[x])] == e.bytes[x] for x, a in zip(i, o))


def test_long_runs(reference):
    rnd = np.random.default_rng(8)
    texts = ["a" * 5000, " " * 3000 + "x", "ab" * 3000, "", "word " * 40000, "".join(map(chr, rnd.integers(97, 123, 20_000))), "x" * 500_000, "thing" * 60]
    ids, n, _ = bpe.encoder(bpe.VOCABULARY).encode(K.Block(texts))
    texts, n, ids = texts[:-2] + texts[-1:], np.delete(n, -2), np.delete(ids, np.arange(n[:-2].sum(), n[:-1].sum()))  # the reference takes too long over one
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [reference.encode_ordinary(t) for t in texts]


def test_scan_equals_a_walk():
    sym = np.random.default_rng(1).integers(0, 8, 5000).astype(np.uint8)
    nxt, cut, _, _ = bpe.automaton()
    state, want = 0, []
    for s in sym:
        want.append(cut[s, state])
        state = nxt[s, state]
    assert (bpe.boundaries(sym) == want).all()


def test_tables(spark):
    rows = [(1, "It's a test.", 5), (1, "It's a test.", 5), (None, "", None), (2, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = bpe.encode(docs)
    assert got.columns == ["doc_id", "ids", "offsets", "round_trip"]
    back = sorted(((r.doc_id or 0, r.text) for r in bpe.decode(got).collect()), key=str)
    assert back == sorted(((d or 0, t) for d, t, _ in rows), key=str)
    assert {r.round_trip for r in got.collect()} == {True, None}
    assert bpe.encode(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        bpe.encoder(bpe.VOCABULARY).decode(np.array([10**6]), np.array([1]))


def test_sorted_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 60, 5000).astype(np.uint64))
    t = K.SortedHash(keys)
    at = t.find(keys)
    assert (keys[t.order][at] == keys).all()
    assert (t.find(keys + np.uint64(1)) >= 0).sum() == np.isin(keys + np.uint64(1), keys).sum()
    assert (K.SortedHash(np.empty(0, np.uint64)).find(keys) == -1).all()


def test_span_hashes_do_not_depend_on_the_place():
    b = K.Block(["Some WORDS here", "and some words HERE", "", "some"])
    h, owner = K.word_hashes(b)
    words = ["some", "words", "here", "and", "some", "words", "here", "some"]
    assert owner.tolist() == [0, 0, 0, 1, 1, 1, 1, 3]
    assert len(set(h.tolist())) == len(set(words))
    assert all((h[i] == h[j]) == (words[i] == words[j]) for i in range(8) for j in range(8))


def test_slices_of_one_hash(reference, monkeypatch):
    real = K.span
    monkeypatch.setattr(K, "span", lambda *a: real(*a) & np.uint64(7))
    e = bpe.Encoder(bpe.VOCABULARY)
    texts = ["several different words, all of few hashes: é 12", "", "again and again different"]
    for _ in range(2):
        ids, n, _ = e.encode(K.Block(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [reference.encode_ordinary(t) for t in texts]


def test_cache_table():
    c = bpe.Cache()
    h = np.unique(np.random.default_rng(3).integers(1, 1 << 62, 200_000).astype(np.uint64))
    h[:5000] = (np.uint64(1) << np.uint64(50)) + np.arange(5000, dtype=np.uint64)  # one neighbourhood
    h = np.unique(h)
    for part in np.array_split(h, 7):
        c.add(part)
    assert (c.get(h) == np.arange(len(h))).all() and (c.get(h + np.uint64(1 << 63)) == -1).all()
