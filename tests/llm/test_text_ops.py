import math
import os
import random
from collections import defaultdict

import numpy as np
import pytest

from loomquery.llm import common, decontaminate, langid, license_scan
from loomquery.llm import kernels as K

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="the tables aren't here")


def table(spark, rows, more="first long, last string, h int, n long, hash int, item_id int"):
    return spark.createDataFrame([(i, t, lang, 1, "x", None, 3, 4, 5) for i, t, lang in rows], f"doc_id long, text string, lang string, {more}")


# language ID


def brute_entropy(train, text, order):
    """Interpolated Kneser-Ney by dictionaries over strings, in the words of the textbook."""

    def clean(t):
        out = ""
        for ch in t.lower():
            out += ch if ch.isalpha() else ("" if not out or out.endswith(" ") else " ")
        return out + ("" if out.endswith(" ") or not out else " ")

    counts = defaultdict(int)
    alphabet = set()
    for t in train:
        s = clean(t)
        alphabet |= set(s)
        for i in range(len(s)):
            counts[(" " * order + s)[i + 1 : i + order + 1]] += 1
    levels = [None] * (order + 1)
    levels[order] = dict(counts)
    for n in range(order - 1, 0, -1):
        levels[n] = defaultdict(int)
        for g in levels[n + 1]:
            levels[n][g[1:]] += 1
    discount, total, kinds = {}, {}, {}
    for n in range(1, order + 1):
        v = list(levels[n].values())
        n1, n2 = v.count(1), v.count(2)
        discount[n] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total[n], kinds[n] = defaultdict(int), defaultdict(int)
        for g, c in levels[n].items():
            total[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1

    def p(g, letters):
        n = len(g)
        below = 1 / letters if n == 1 else p(g[1:], letters)
        ctx = g[:-1]
        if not total[n].get(ctx):
            return below
        return max(levels[n].get(g, 0) - discount[n], 0) / total[n][ctx] + discount[n] * kinds[n][ctx] / total[n][ctx] * below

    s = clean(text)
    return alphabet, lambda letters: -sum(math.log(p((" " * order + s)[i + 1 : i + order + 1], letters)) for i in range(len(s))) / len(s)


def test_kneser_ney_by_brute_force():
    train = {"aa": ["the cat sat on the mat", "a cat and the hat, that cat"], "bb": ["der hund und die katze", "das ist der hund"]}
    order = 3
    grams = []
    for lang in train:
        codes, owner = langid.sequence(K.Block(train[lang]))
        grams.append(np.unique(langid.ngrams(codes, owner, order), return_counts=True))
    model = langid.kneser_ney(grams, list(train), order)
    letters = len({c for lang in train for c in brute_entropy(train[lang], "a", order)[0]}) + 1
    tests = ["the cat und der hat", "xyzzy quark", "Katze; mat"]
    _, entropy, _ = model.entropies(K.Block(tests))
    for i, t in enumerate(tests):
        for j, lang in enumerate(train):
            assert entropy[i, j] == pytest.approx(brute_entropy(train[lang], t, order)[1](letters), rel=1e-4)


@needs_data
def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1")
    truth = {r.doc_id: (r.lang, r.n_chars) for r in held.collect()}
    got = langid.identify(held, model).collect()
    kept = [r for r in got if not r.rejected]
    assert len(kept) >= 0.97 * len(got)
    assert sum(truth[r.doc_id][0] == r.lang_id for r in kept) >= 0.97 * len(kept)
    rnd = random.Random(1)
    junk = ["".join(rnd.choice("qxzjkvwy") for _ in range(400)), "这是一个完全不同的语言" * 20, "", None, "12 34 !!"]
    bad = table(spark, [(i, t, None) for i, t in enumerate(junk)])
    assert all(r.rejected for r in langid.identify(bad, model).collect())
    both = bad.unionByName(table(spark, [(None, "the thing and that other with this of the for", "xx")]))
    left = langid.keep_identified(both, model)
    assert left.columns == bad.columns and left.where("doc_id is not null").count() == 0


def test_language_ids_of_odd_tables(spark):
    few = table(spark, [(1, "hello there my friend", "en"), (2, "guten tag mein freund", "de"), (3, None, "de"), (4, "", "en"), (None, "hello", "en"), (1, "hello there my friend", "en"), (5, "123", "en")])
    got = {(r.doc_id, r.lang_id, r.rejected) for r in langid.identify(few).collect()}
    assert (1, "en", False) in got and (2, "de", False) in got and (3, None, True) in got
    assert langid.identify(few).count() == 7
    assert langid.identify(few.limit(0)).collect() == [] and langid.keep_identified(few.limit(0)).collect() == []
    unlabelled = table(spark, [(1, "hello", None)])
    assert [r.rejected for r in langid.identify(unlabelled).collect()] == [True]
    assert langid.keep_identified(unlabelled).collect() == []


@needs_data
def test_a_very_long_text_is_identified_as_its_parts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    parts = defaultdict(list)
    for r in docs.collect():
        parts[r.lang].append(r.text or "")
    languages = sorted(parts)
    long = [(" ".join(parts[x]) + " ") * (1 + 2_000_000 // sum(map(len, parts[x]))) for x in languages]
    got = langid.identify(table(spark, [(i, t, None) for i, t in enumerate(long)]), langid.train(docs)).collect()
    assert {r.doc_id: r.lang_id for r in got} == dict(enumerate(languages))


# decontamination

ITEMS = [(1, "Tom has 5 apples and buys 3 more apples from Anna for 2 dollars each. How many apples does Tom have now?"), (2, "tiny item here"), (3, None), (4, ""), (None, "an item without any id at all in this list"), (5, "The train of 1,200 tons leaves Paris at 9 and the ship leaves Paris at 9 too")]
LEAKS = [
    (1, "noise " + ITEMS[0][1] + " more", {1: False}),
    (2, "Maria has 7 apples and buys 12 more apples from Joe for 9 euros each. How many apples does Maria have now?", {1: True}),
    (3, ITEMS[0][1].upper(), {1: False}),
    (4, "we saw a Tiny item, here", {2: False}),
    (5, "The train of 800 tons leaves Rome at 7 and the ship leaves Rome at 7 too", {5: True}),
    (6, "The train of 800 tons leaves Rome at 7 and the ship leaves Oslo at 8 too", {}),
    (7, "Nothing of this is in the list, though it has 5 apples and 3 pears.", {}),
    (8, None, {}), (9, "", {}), (None, ITEMS[0][1], {}),
    (10, "tom has many apples. " * 500, {}),
]


@pytest.mark.parametrize("bits", [common.MOST_BITS, 1 << 10])
def test_decontamination(spark, bits, monkeypatch):
    """The same with a filter that all windows pass, nearly."""
    monkeypatch.setattr(common, "MOST_BITS", bits)
    bench = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id int, text string, doc_id int")
    docs = table(spark, [(i, t, None) for i, t, _ in LEAKS])
    got = {(r.doc_id, r.item_id): r.rewritten for r in decontaminate.matches(docs, bench).collect()}
    assert got == {(d, i): w for d, _, items in LEAKS for i, w in items.items()}
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _, items in LEAKS if not items)
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(LEAKS)
    assert decontaminate.matches(docs.limit(0), bench).collect() == []


def brute_leaks(docs, items):
    """(doc, item) -> rewritten of whole items standing in documents with other values in their slots: every alignment of
    an item, word by word, with slots mapped both ways one to one."""
    import re

    numbers, units = set(decontaminate._NUMBER_WORDS.split()), set(decontaminate._UNIT_WORDS.split())

    def cut(text):
        out = []
        for w in re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+", text):
            low, number = w.lower(), w[0].isdigit()
            unit = bool(out) and out[-1][1] == 1 and low in units
            kind = 1 if number or low in numbers else 2 if unit else 3 if w[0].isupper() and not w[1:2].isupper() else 0
            out.append((low.replace(",", "").replace(".", "") if number else low, kind))
        return out

    found = {}
    for d, text in docs:
        own = cut(text)
        for i, item in items:
            want = cut(item)
            for at in range(len(own) - len(want) + 1):
                pairs = [(a, b) for a, b in zip(want, own[at:])]
                if all(a[1] == b[1] and (a[1] or a[0] == b[0]) for a, b in pairs):
                    slots = {(a[1], a[0], b[0]) for a, b in pairs if a[1]}
                    if len(slots) == len({x[:2] for x in slots}) == len({(x[0], x[2]) for x in slots}):
                        found[d, i] = found.get((d, i), True) and any(x[1] != x[2] for x in slots)
    return found


def test_rewritten_items_by_brute_force(spark):
    """Items of several numbers, names and units, verbatim, rewritten consistently and not, among prose and very long texts."""
    r = random.Random(21)
    words = "the red train goes to a town and takes many boxes with it when it rains on some days of spring but not always".split()
    names, units = "Anna Bob Carl Dora Emil Fay Gus Hana".split(), "km kg hours dollars miles".split()
    items, docs = [], []
    for i in range(12):
        t = [r.choice(words) for _ in range(14)]
        for at in (2, 6, 10):
            t[at] = r.choice(names)
        t[4], t[5], t[12] = str(r.randint(2, 99)), r.choice(units), str(r.randint(2, 99))
        items.append((i, " ".join(t)))
        for c in range(3):  # verbatim, rewritten, at random
            new = dict(zip(r.sample(names, 8), r.sample(names, 8)))
            number = {x: str(r.randint(100, 999)) for x in {t[4], t[12]}}
            u = t if c == 0 else [new.get(x, number.get(x, x)) for x in t] if c == 1 else [r.choice(names) if x in names else str(r.randint(100, 999)) if x.isdigit() else x for x in t]
            filler = lambda n: " ".join(r.choice(words) for _ in range(n))
            docs.append((len(docs), filler(5) + " " + " ".join(u) + " " + filler(20_000 if i == 0 else 7)))
    want = {k: w for k, w in brute_leaks(docs, items).items()}
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = {(x.doc_id, x.item_id): x.rewritten for x in decontaminate.matches(table(spark, [(i, t, None) for i, t in docs]), bench).collect()}
    assert {k: got.get(k) for k in want} == want and len(want) >= 24
    wrong = {k for k in got if k not in want}
    assert all(k[0] % 3 == 2 and k[0] // 3 == k[1] for k in wrong)  # inconsistent in some slots only: partly covered


@needs_data
def test_benchmark_passages_are_found(spark):
    import re

    def plain(t):
        return " ".join(re.findall(r"\w+", (t or "").lower()))

    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: plain(r.text) for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in plain(r.text)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()} == want


# licenses


def test_licenses(spark):
    filler = "some other words of a text " * 30
    cases = [
        (1, filler + license_scan.TEMPLATES["MIT"] + ".\n" + filler, {"MIT"}),
        (2, "LICENSED under the apache license version 2.0", {"Apache-2.0"}),
        (3, license_scan.TEMPLATES["BSD-clauses"].replace("binary forms", "binary or other forms"), {"BSD-clauses"}),
        (4, "the license of the work is not licensed under the sun", set()),
        (5, filler + license_scan.TEMPLATES["GPL-3.0"] + filler + license_scan.TEMPLATES["GPL-3.0"], {"GPL-3.0"}),
        (6, "Licensed under CC BY-NC 4.0.", {"CC-BY-NC-4.0"}),
        (7, None, set()), (8, "", set()), (None, license_scan.TEMPLATES["MIT"], set()), (9, "x", set()),
    ]
    docs = table(spark, [(i, t, None) for i, t, _ in cases])
    docs = docs.withColumnRenamed("n", "spans").withColumnRenamed("h", "id").withColumnRenamed("first", "license")
    found = license_scan.scan(docs).collect()
    text = {i: t for i, t, _ in cases}
    assert {i: {r.license for r in found if r.doc_id == i} for i, _, _ in cases if i} == {i: w for i, _, w in cases if i}
    assert sum(r.doc_id == 5 for r in found) == 2
    assert [text[1][r.start : r.end] for r in found if r.doc_id == 1] == [license_scan.TEMPLATES["MIT"]]
    assert license_scan.scan(docs.limit(0)).collect() == [] and license_scan.scan(docs, {}).collect() == []
    twice = license_scan.scan(docs.unionByName(docs)).count()
    assert twice == len(found)


def test_common_words():
    assert license_scan.common_words([1, 2, 3, 4], [2, 9, 4]) == [1, 3]
    assert license_scan.common_words([], [1]) == []


def test_license_variants_and_full_texts(spark):
    templates = license_scan.all_templates()
    cases = [
        (1, "Licensed under CC BY-ND 4.0", {"CC-BY-ND-4.0"}),
        (2, "This work is licensed under the GNU Lesser General Public License, version 3", {"LGPL-3.0"}),
        (3, "This work is licensed under the GNU Affero General Public License, version 3", {"AGPL-3.0"}),
        (4, "This work is licensed under the GNU General Public License, version 2", {"GPL-2.0"}),
        (5, "Released under the ISC License", {"ISC"}),
        (6, "Licensed under CC BY 9.0", set()),
        (7, "Licensed under the Foobar License, Version 2.0", set()),
        (8, "under the GNU Lesser General Public License, version 2.1", {"LGPL-2.1"}),
        (9, "SPDX-License-Identifier: EPL-2.0", {"EPL-2.0"}),
        (10, "released under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", {"CC-BY-NC-SA-4.0"}),
    ]
    full = [n for n in templates if n.endswith("-full")]
    cases += [(100 + i, "a b c d e " * 9 + templates[n] + " f g h i j", {n.removesuffix("-full")}) for i, n in enumerate(full)]
    found = license_scan.scan(table(spark, [(i, t, None) for i, t, _ in cases])).collect()
    ids = sorted({n.removesuffix("-full") for n in full} | {"CC-BY-ND-4.0", "AGPL-3.0", "EPL-2.0", "CC-BY-NC-SA-4.0"}, key=len, reverse=True)
    got = {i: {next((x for x in ids if r.license == x or r.license.startswith(x + "-")), r.license) for r in found if r.doc_id == i} for i, _, _ in cases}
    assert got == {i: w for i, _, w in cases}


def test_numbers_are_found_verbatim(spark):
    sums, short = "What is 12 + 35 + 7 + 18 + 4 + 6?", "1 2 3 4"
    mixed = "the list of all figures follows here now: 4 8 15 16 23 42 77 91 20 31 65 12"
    bench = spark.createDataFrame([(1, sums), (2, short), (3, mixed)], "item_id int, text string")
    docs = table(spark, [(1, "so " + sums + " yes", None), (2, "What is 13 + 36 + 8 + 19 + 5 + 7?", None), (3, "x " + short + " y", None), (4, mixed, None), (5, "5 6 7 8 9 10 11 12 13", None)])
    got = {(r.doc_id, r.item_id): (r.coverage, r.rewritten) for r in decontaminate.matches(docs, bench).collect()}
    assert got == {(1, 1): (1.0, False), (3, 2): (1.0, False), (4, 3): (1.0, False)}


def test_repeated_lines_are_all_reported(spark):
    lines = "All rights reserved.\n" * 7
    got = sorted((r.start, r.end) for r in license_scan.scan(table(spark, [(1, lines, None)])).collect())
    assert got == [(21 * i, 21 * i + 19) for i in range(7)]


def longest_common(a, b):
    """Length of a longest common subsequence, by the textbook's table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_licenses_by_brute_force(spark):
    """Copies of made-up templates, some changed in a few words, at random places of random texts, back to back too: all
    spans and scores."""
    r = random.Random(31)
    word = lambda p: p + "".join(r.choice("bcdfghjklm") for _ in range(6))
    templates = {f"T{i}": " ".join(word("q") for _ in range(r.randint(18, 40))) for i in range(6)}
    docs, want = [], set()
    for d in range(25):
        text = ""
        for _ in range(r.randint(1, 7)):
            text += " ".join(word("x") for _ in range(r.choice([0, 1, 4, 90, 30_000 if d == 0 else 9]))) + " "
            name = r.choice(sorted(templates))
            own, kept = templates[name].split(), templates[name].split()
            for _ in range(r.choice([0, 0, 1, 2])):
                at = r.randrange(3, len(own) - 3)
                own[at : at + 1] = r.choice([[], [word("x")], [own[at], word("x")]])
            at = len(text)
            text += " ".join(own) + "\n"
            want.add((d, name, at, at + len(" ".join(own)), round(longest_common(kept, own) / len(kept), 6)))
        docs.append((d, text, None))
    got = {tuple(x) for x in license_scan.scan(table(spark, docs), templates).collect()}
    assert got == want


@needs_data
def test_license_query_by_brute_force(spark):
    """Over the whole table: each verbatim template is covered by a span of at least as many words, and the score of each
    span is that of a longest common subsequence of its words."""
    words = lambda t: [(t[a:b].lower(), a, b) for a, b in zip(*(x.tolist() for x in K.word_spans(K.Block([t]))[:2]))]
    templates = {n: [w for w, _, _ in words(t)] for n, t in license_scan.all_templates().items()}
    begins = defaultdict(list)
    for n, w in templates.items():
        begins[w[0], w[1]].append((n, w))
    found = defaultdict(list)
    for x in license_scan.op7_license_scan(spark, DATA).collect():
        found[x.doc_id].append(x)
    checked = 0
    for row in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        own = words(row.text or "")
        only = [w for w, _, _ in own]
        for x in found[row.doc_id]:
            inside = [w for w, a, b in own if x.start <= a and b <= x.end]
            assert round(longest_common(templates[x.license], inside) / len(templates[x.license]), 6) == x.score
        for i, pair in enumerate(zip(only, only[1:])):
            for n, w in begins.get(pair, ()):
                if only[i : i + len(w)] == w and license_scan.GRAM <= len(w):
                    checked += 1
                    a, b = own[i][1], own[i + len(w) - 1][2]
                    # the license's own span, a longer one that overlaps it, or none where the words after it name another version
                    assert any(x.start < b and a < x.end for x in found[row.doc_id]), (row.doc_id, n, row.text[a - 20 : b + 40])
    assert checked > 3
