import os
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomquery.llm import bpe, html_crf, link_graph, sharding, wavelet
from loomquery.llm import kernels as K

DATA = "/root/testdata/sf0.001"


# sharding


def sort_key(*values):
    return tuple((0,) if v is None or v != v else (1, v) for v in values)


def check_shards(out, keys, target, column):
    """By brute force: shards are runs of the sorted keys, in one partition each, none overfull but those of one key."""
    key = lambda x: sort_key(*(x[k] for k in keys))
    by = {}
    for x in out:
        by.setdefault(x[column], []).append(x)
    assert all(len({x.part for x in v}) == 1 for v in by.values())
    order = sorted(by)
    for a, b in zip(order, order[1:]):
        assert max(map(key, by[a])) < min(map(key, by[b]))
    for v in by.values():
        assert sum(len((x.text or "").encode()) + 1 for x in v) <= sharding.OVERFULL * target or len({key(x) for x in v}) == 1
    return by


def test_shards(spark):
    r = random.Random(4)
    rows = [(i if i % 50 else None, "w" * (20000 if i == 7 else r.randint(0, 60)) if i % 11 else None, r.choice(["hot"] * 8 + ["a", "b", None]), "taken") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string")
    target = 4000
    got = sharding.shard(docs, ["source", "doc_id"], target).withColumn("part", sharding.F.spark_partition_id())
    assert got.columns == [*docs.columns, "_shard", "part"]
    out = got.collect()
    assert sorted((str(x.doc_id), str(x.text), str(x.source)) for x in out) == sorted((str(a), str(b), str(c)) for a, b, c, _ in rows)
    assert len(check_shards(out, ["source", "doc_id"], target, "_shard")) > 20
    assert sharding.shard(docs.limit(0), ["source", "doc_id"]).collect() == []
    assert {x.shard for x in sharding.shard(docs.drop("shard"), ["source", "doc_id"]).collect()} == {0}


def test_shard_keys_of_any_name_and_type(spark):
    r = random.Random(5)
    odd = ["", "a", "a\0", "a\0b", "ab", "é", "😀", None, "z" * 5000]
    rows = [(r.choice([None, float("nan"), -0.0, 1.5, -2.5, 1e300, float("-inf")]), r.choice(odd), r.choice([None, -(1 << 63), -1, 0, (1 << 63) - 1]), r.choice([None, True, False]), bytes(r.choices(range(3), k=r.randint(0, 3))), "x" * r.randint(0, 40)) for _ in range(600)]
    docs = spark.createDataFrame(rows, "size double, key string, range long, first boolean, weight binary, text string")
    for keys in (["size"], ["weight", "size"], ["key", "range"], ["first", "range", "key"], ["range", "weight"]):
        out = sharding.shard(docs, keys, 300).withColumn("part", sharding.F.spark_partition_id()).collect()
        assert len(out) == 600 and len(check_shards(out, keys, 300, "shard")) > 2
    # nearly all is one key's, and a key that comes last
    few = spark.createDataFrame([(1, "x" * 500)] * 40 + [(2, "x"), (0, "y")], "k int, text string")
    assert {x.k: x.shard for x in sharding.shard(few, ["k"], 1000).collect()} == {0: 0, 1: 1, 2: 2}


@pytest.mark.skipif(not os.path.exists(DATA), reason="the tables aren't here")
def test_sharding_query(spark):
    out = sharding.op2_sharding(spark, DATA).withColumn("part", sharding.F.spark_partition_id()).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert sorted(x[: len(docs[0])] for x in out) == sorted(tuple(d) for d in docs)
    assert len(check_shards(out, ["source", "doc_id"], sharding.TARGET_BYTES, "shard")) > 1


# token shards


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=300), st.integers(0, 300))
def test_wavelet(tokens, i):
    a = np.array(tokens, np.uint16)
    w = wavelet.WaveletMatrix(wavelet.build(a, [], np.zeros(0), 6))
    assert [w.access(j) for j in range(len(a))] == tokens
    for t in {*tokens, 41, 63, 64}:
        at = [j for j, x in enumerate(tokens) if x == t]
        assert w.rank(t) == len(at) and w.rank(t, i) == sum(j < i for j in at)
        assert [w.select(t, k) for k in range(len(at))] == at
        with pytest.raises(IndexError):
            w.select(t, len(at))


def test_blocks_and_shards(spark, tmp_path):
    a = np.random.default_rng(0).zipf(1.3, 120_000) % 50_000
    w = wavelet.WaveletMatrix(wavelet.build(a.astype(np.uint16), [], np.zeros(0), 16))
    assert [w.access(i) for i in range(0, len(a), 997)] == a[::997].tolist()
    assert w.tokens(0, len(a)).tolist() == a.tolist() and w.tokens(70_001, 70_007).tolist() == a[70_001:70_007].tolist() and not len(w.tokens(5, 5))
    with pytest.raises(IndexError):
        w.tokens(1, len(a) + 1)
    at = np.flatnonzero(a == 1)
    assert w.rank(1) == len(at) and w.select(1, len(at) - 5) == at[-5]
    if not os.path.exists(bpe.VOCABULARY):
        return
    rows = [(i, "text of number %d " % i * (i % 7), 9) for i in range(60)] + [(None, "x", 9), (3, None, 9), (3, "again", 9), (3, "again", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long")
    shards = wavelet.token_shards(docs, shard_bytes=1000).collect()
    assert len(shards) > 3 and len({s.shard for s in shards}) == len(shards) and sum(s.n_docs for s in shards) == len(rows)
    e, seen = bpe.encoder(bpe.VOCABULARY), []
    for s in shards:
        w = wavelet.WaveletMatrix(s.file)
        assert w.doc_ids == s.doc_ids and w.n == s.n_tokens
        for i, d in enumerate(w.doc_ids):
            ids = w.document(i)
            seen.append((str(d), e.decode(ids, np.array([len(ids)]))[0].tobytes().decode()))
    assert sorted(seen) == sorted((str(d), t or "") for d, t, _ in rows)
    assert wavelet.token_shards(docs.limit(0)).collect() == []
    written = wavelet.write_files(wavelet.token_shards(docs, shard_bytes=1000), str(tmp_path / "out")).collect()
    assert {r.shard: wavelet.WaveletMatrix.open(r.path).n for r in written} == {s.shard: s.n_tokens for s in shards}


@pytest.mark.skipif(not (os.path.exists(DATA) and os.path.exists(bpe.VOCABULARY)), reason="the tables or the vocabulary aren't here")
def test_token_shards_query(spark):
    """All documents of the table, whole, from several shards."""
    shards, e, got = wavelet.op9_token_shards(spark, DATA.replace("0.001", "0.01")).collect(), bpe.encoder(bpe.VOCABULARY), {}
    assert len(shards) > 3
    for s in shards:
        w = wavelet.WaveletMatrix(s.file)
        flat, n = w.tokens(0, w.n), np.diff(w.doc_starts)
        data, size = e.decode(flat, n)
        ends = np.cumsum(size).tolist()
        got |= {d: data[b - k : b].tobytes().decode() for d, b, k in zip(w.doc_ids, ends, size.tolist())}
    assert got == {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet").collect()}


def test_shards_of_other_ids_and_a_long_text(spark):
    docs = spark.createDataFrame([(1.5, "word " * 400_000), (None, "x"), (2.5, "")], "doc_id double, text string")
    out = {s.shard: wavelet.WaveletMatrix(s.file) for s in wavelet.token_shards(docs, shard_bytes=1 << 20).collect()}
    assert sorted((str(d), n) for w in out.values() for d, n in zip(w.doc_ids, np.diff(w.doc_starts).tolist())) == [("1.5", 400_001), ("2.5", 0), ("None", 1)]


# link graph


def pages_of(spark, links):
    rows = [(i, f"http://{h}/p{i}" if h else h, None if t is None else "".join(f'<a href="http://{x}/">x</a>' for x in t), "x") for i, (h, t) in enumerate(links)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string")


LINKS = [("good.test", ["mid.test", "mid.test"]), ("mid.test", ["leaf.test", "good.test"]), ("farm.test", ["bad.test", "farm.test"]), ("www.bad.test", ["bad.test"]), ("leaf.test", []), (None, ["good.test"]), ("lone.test", None), ("farm.test", ["bad.test"])]


def brute(links, trusted, blocked, steps, family):
    edges = {}
    hosts = set()
    for h, to in links:
        if h is None:
            continue
        hosts.add(h)
        for t in set(to or []) - {h}:
            edges[h, t] = edges.get((h, t), 0) + 1
    for h in list(hosts):
        parent = h.split(".", 1)[1]
        if "." in parent and parent not in link_graph.SUFFIXES:
            edges[h, parent] = edges.get((h, parent), 0) + family
            edges[parent, h] = edges.get((parent, h), 0) + family
    hosts |= {t for _, t in edges}

    def rank(pairs, seeds):
        out = {h: sum(w for (a, _), w in pairs.items() if a == h) for h in hosts}
        now = {h: float(h in seeds) for h in hosts}
        for _ in range(steps):
            now = {h: 0.15 * (h in seeds) + 0.85 * sum(now[a] * w / out[a] for (a, b), w in pairs.items() if b == h) for h in hosts}
        return {h: x / 0.15 for h, x in now.items()}

    cover = lambda seeds: {h for h in hosts if any(h == s or h.endswith("." + s) for s in seeds)}
    bad = cover(blocked)
    t, d = rank(edges, cover(trusted) - bad), rank({(b, a): w for (a, b), w in edges.items()}, bad)
    return {h: (round(t[h], 6), round(d[h], 6), h in bad or (d[h] >= link_graph.LEAST and d[h] > t[h])) for h in hosts}


@pytest.mark.parametrize("hot_edges", [link_graph.HOT_EDGES, 1])
def test_propagation(spark, hot_edges, monkeypatch):
    monkeypatch.setattr(link_graph, "HOT_EDGES", hot_edges)
    got = {r.host: (r.trust, r.distrust, r.rejected) for r in link_graph.host_scores(pages_of(spark, LINKS), ("good.test",), ("bad.test",), tolerance=0.3).collect()}
    assert link_graph.rounds(tolerance=0.3) == 8
    want = brute(LINKS, ("good.test",), ("bad.test",), 8, link_graph.FAMILY)
    assert got.keys() == want.keys()
    for h in want:
        assert got[h] == pytest.approx(want[h], abs=2e-6)
    assert got["farm.test"][2] and got["www.bad.test"][2] and not got["mid.test"][2] and not got["leaf.test"][2]


def test_urls_of_odd_pages(spark):
    per_page = link_graph.filter_urls(pages_of(spark, LINKS), trusted=("good.test",), blocked=("bad.test",), tolerance=0.5).collect()
    assert len(per_page) == len(LINKS) and [r.rejected for r in per_page if r.host is None] == [True]
    none = link_graph.filter_urls(pages_of(spark, LINKS), trusted=(), blocked=(), tolerance=0.9).collect()
    assert [r.rejected for r in none if r.host] == [False] * 7
    assert link_graph.filter_urls(pages_of(spark, []).limit(0), tolerance=0.9).collect() == []


def test_hosts_under_a_public_suffix_are_strangers(spark):
    links = [("spam.co.uk", []), ("a.co.uk", []), ("b.co.uk", ["a.co.uk"]), ("me.github.io", []), ("you.github.io", []), ("shop.spam.co.uk", []), ("friend.test", ["spam.co.uk"])]
    got = {r.host: r.rejected for r in link_graph.host_scores(pages_of(spark, links), (), ("spam.co.uk", "me.github.io"), tolerance=0.5).collect()}
    assert got == {"spam.co.uk": True, "a.co.uk": False, "b.co.uk": False, "me.github.io": True, "you.github.io": False, "shop.spam.co.uk": True, "friend.test": True}


def test_thresholds_hold_for_many_seeds_and_long_ways(spark):
    """One link to one of 3,000 blocked hosts rejects; so does a way of 12 links; seeds may be a table."""
    links = [(f"bad{i}.test", []) for i in range(3000)] + [("friend.test", ["bad7.test"])] + [(f"way{i}.test", [f"way{i + 1}.test"]) for i in range(12)] + [("way12.test", ["bad9.test"])] + [("clean.test", [])]
    seeds = spark.createDataFrame([(f"BAD{i}.test",) for i in range(3000)], "name string")
    got = {r.host: r.rejected for r in link_graph.host_scores(pages_of(spark, links), (), seeds, tolerance=0.1).collect()}
    assert got["friend.test"] and all(got[f"way{i}.test"] for i in range(13)) and not got["clean.test"] and all(got[f"bad{i}.test"] for i in range(3000))


def test_long_pages_and_urls(spark):
    rows = [(1, "http://good.test/" + "x" * 200_000, '<a href="http://bad.test/">x</a>' + "y" * 2_000_000), (2, "http://late.test/", "z" * 1_000_000 + '<a href="http://bad.test/">x</a>')]
    got = {r.host: r.rejected for r in link_graph.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), trusted=(), blocked=("bad.test",), tolerance=0.5).collect()}
    assert got == {"good.test": True, "late.test": True}


@pytest.mark.skipif(not os.path.exists(DATA), reason="the tables aren't here")
def test_propagation_sql(spark):
    got = {tuple(r) for r in link_graph.op3_url_filter(spark, DATA).collect()}
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{DATA}/pages.parquet'")
    assert got == set(con.sql(f"select page_id, host, trust, distrust, rejected from ({link_graph.oracle()})").fetchall())


# HTML


def test_held_out_blocks():
    field = html_crf.default_field()
    pages = [html_crf.leaves(p) for p in html_crf.labelled_pages(80, 1234)]
    got = field.decode([html_crf.features(p) for p in pages])
    pairs = [(bool(y), leaf.gold) for p, ys in zip(pages, got) for leaf, y in zip(p, ys)]
    assert sum(a == b for a, b in pairs) >= 0.97 * len(pairs)


def test_viterbi_by_brute_force():
    import itertools

    r = np.random.default_rng(0)
    f = html_crf.Field(r.normal(size=(4, 2)), r.normal(size=(2, 2)), r.normal(size=2), r.normal(size=2))
    pages = [r.normal(size=(n, 4)) for n in (1, 3, 0, 6)]
    for x, y in zip(pages, f.decode(pages)):
        if len(x):
            s = x @ f.emission
            value = lambda p: f.start[p[0]] + f.end[p[-1]] + sum(s[i, l] for i, l in enumerate(p)) + sum(f.transition[a, b] for a, b in zip(p, p[1:]))  # noqa: E731,E741
            assert tuple(y) == max(itertools.product((0, 1), repeat=len(x)), key=value)


def test_gradient_by_finite_differences():
    r = np.random.default_rng(2)
    pages = [r.integers(0, 2, (n, 5)).astype(np.float32) for n in (1, 4, 7)]
    data = html_crf.Examples(pages, [r.integers(0, 2, len(p)).tolist() for p in pages])
    weights = [r.normal(size=s) for s in ((5, 2), (2, 2), 2, 2)]
    _, grads = html_crf.likelihood(weights, data, 0.1)
    for i, w in enumerate(weights):
        for at in np.ndindex(w.shape):
            sides = []
            for step in (1e-5, -1e-5):
                moved = [x.copy() for x in weights]
                moved[i][at] += step
                sides.append(html_crf.likelihood(moved, data, 0.1)[0])
            assert grads[i][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-6)


def test_likelihood_by_brute_force():
    import itertools
    import math

    r = np.random.default_rng(3)
    x = r.integers(0, 2, (4, 3)).astype(np.float32)
    w = [r.normal(size=s) for s in ((3, 2), (2, 2), 2, 2)]
    score = lambda y: sum((x[i] @ w[0])[l] for i, l in enumerate(y)) + sum(w[1][a, b] for a, b in zip(y, y[1:])) + w[2][y[0]] + w[3][y[-1]]  # noqa: E731,E741
    want = score((0, 1, 1, 0)) - math.log(sum(math.exp(score(y)) for y in itertools.product((0, 1), repeat=4)))
    assert html_crf.likelihood(w, html_crf.Examples([x], [[0, 1, 1, 0]]), 0.0)[0] == pytest.approx(want)


@pytest.mark.skipif(not os.path.exists(DATA), reason="the tables aren't here")
def test_extraction_query_against_a_parser(spark):
    """What the query keeps of the given pages, word by word, against the texts of their article elements, which another
    parser reads."""
    from collections import Counter
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.hidden, self.words, self.seen = 0, 0, [], False

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.seen |= tag == "article"
            self.hidden += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.hidden -= tag in ("script", "style")

        def handle_data(self, data):
            if self.inside > 0 and self.hidden <= 0:
                self.words += data.split()

    got = {r.page_id: r.text for r in html_crf.op8_html_extract(spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert got.keys() == {p.page_id for p in pages}
    kept = wanted = both = 0
    for p in pages:
        gold = Article()
        gold.feed(p.html)
        if gold.seen:
            a, b = Counter(got[p.page_id].split()), Counter(gold.words)
            kept, wanted, both = kept + a.total(), wanted + b.total(), both + (a & b).total()
    assert wanted > 1000 and both / kept > 0.95 and both / wanted > 0.95


def test_parser_and_odd_pages(spark):
    page = '<p>one &amp; two<p>three <a href="x">link</a><script>var t = "</p>";</script><!-- no <p>comment --><div class="ad">buy'
    assert [(b.text, b.tags[-1], round(b.links, 2)) for b in html_crf.leaves(page)] == [("one & two", "p", 0), ("three link", "p", 0.44), ("buy", "div", 0)]
    odd = ["", None, "<", "<<<p", "</p></div>", "<a href='", "just text", "<script>never closed", "<p>" * 3000 + "deep", "<div " * 2000, "x" * 300_000, "<p>a<b>c</p>" * 20_000]
    pages = spark.createDataFrame([(i if i else None, None, h, 1) for i, h in enumerate(odd)], "page_id long, url string, html string, text int")
    got = html_crf.extract(pages).collect()
    assert len(got) == len(odd) and [r.text for r in got if r.page_id == 1] == [None] and [r.text for r in got if r.page_id is None] == [""]
    assert html_crf.extract(pages.limit(0)).collect() == []


def test_code_points():
    assert K.Block(["é", ""]).cps.tolist() == [233, 10, 10]
