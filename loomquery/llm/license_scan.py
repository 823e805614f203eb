"""License scans by diagonal voting.

All rolling word k-gram hashes of all documents are joined in Spark with the positions of the templates' k-grams. Each
match votes for its diagonal (position in the document less position in the template); neighbouring diagonals, apart by
inserted or lost words, are merged into spans; all copies of the template in spans with enough votes are verified against
the text word by word (longest common subsequence over the template's words) and reported with their character offsets.
A copy isn't verified if a word that tells variants apart (``told_apart``) was added or changed.

Templates are the full texts in ``licenses/`` (``<id>-full``), standard notices, titles (``<id>-name``) and SPDX tags.

Defined cases: null, empty or short texts match nothing; rows with a null ``doc_id`` aren't reported; repeated rows
report each span once; of overlapping spans the one with most words found is reported, then the best score, then the
first name; a license that is repeated, back to back too, is reported each time; a very long text is scanned whole, in one
block of about 60 bytes a character; empty tables give empty results; other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import kernels as K
from .common import lists, map_text, materialise, pieces, read, signed, sized, small, texts_of

GRAM = 3
#: Diagonals that lie apart by at most so many words are one span.
NEIGHBOUR = 3
#: Votes of a span, as a share of the template's k-grams, that make it worth verifying; words found that verify it.
VOTES, FOUND = 0.4, 0.75
#: What a span takes in a broadcast table.
SPAN_BYTES = 64

TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-text": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "all-rights-reserved": "All rights reserved",
}
_GPL_NOTICE = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_NOTICES = {
    "GPL-2.0-notice": _GPL_NOTICE.format("General", "2"),
    "LGPL-2.0-notice": _GPL_NOTICE.format("Library General", "2"),
    "LGPL-2.1-notice": _GPL_NOTICE.format("Lesser General", "2.1"),
    "LGPL-3.0-notice": _GPL_NOTICE.format("Lesser General", "3"),
    "AGPL-3.0-notice": _GPL_NOTICE.format("Affero General", "3"),
    "GFDL-notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation",
    "EPL-1.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "OFL-1.1-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "Unlicense-notice": "This is free and unencumbered software released into the public domain",
}
#: Titles that come with a version.
_VERSIONED = {
    "GPL": ("GNU General Public License", ("1.0", "2.0", "3.0")), "LGPL": ("GNU Lesser General Public License", ("2.1", "3.0")), "LGPL-library": ("GNU Library General Public License", ("2.0",)),
    "AGPL": ("GNU Affero General Public License", ("3.0",)), "GFDL": ("GNU Free Documentation License", ("1.1", "1.2", "1.3")), "Apache": ("Apache License", ("1.1", "2.0")), "MPL": ("Mozilla Public License", ("1.0", "1.1", "2.0")),
    "EPL": ("Eclipse Public License", ("1.0", "2.0")), "BSL": ("Boost Software License", ("1.0",)), "Artistic": ("Artistic License", ("1.0", "2.0")), "CDDL": ("Common Development and Distribution License", ("1.0", "1.1")),
    "EUPL": ("European Union Public Licence", ("1.1", "1.2")), "OFL": ("SIL Open Font License", ("1.1",)), "AFL": ("Academic Free License", ("3.0",)),
}
_TITLES = {
    "MIT": ("the MIT License",), "MIT-0": ("MIT No Attribution License", "MIT No Attribution"), "ISC": ("the ISC License",), "Zlib": ("the zlib License",), "Unlicense": ("under the Unlicense",), "WTFPL": ("Do What The Fuck You Want To Public License",),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD License", "0-clause BSD License"), "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "the Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "the New BSD License", "the Modified BSD License"), "BSD-4-Clause": ("BSD 4-Clause License", "4-Clause BSD License", "the Original BSD License"),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "Licensed under CC0 1.0", "Creative Commons CC0 License"), "MS-PL": ("Microsoft Public License",), "PSF-2.0": ("Python Software Foundation License Version 2",),
}
_TAGS = "0BSD AFL-3.0 AGPL-3.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC0-1.0 CDDL-1.0 CDDL-1.1 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.0 LGPL-2.1 LGPL-3.0 MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL OFL-1.1 PSF-2.0 Unlicense WTFPL Zlib".split()
_CC_WORDS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
_CC_SPACED = {"BY": "Attribution", "SA": "Share Alike", "NC": "Non-Commercial", "ND": "No Derivatives"}
#: Words that tell licenses and their variants apart; in texts of at least FULL words only the strong ones count, and
#: numbers only as versions.
_STRONG = frozenset("lesser affero noncommercial noderivatives noderivs sharealike nc nd sa mozilla eclipse apache".split())
_WEAK = frozenset("library general free documentation only later no non commercial derivatives derivative share alike attribution zero universal mit isc bsd zlib boost unlicense gnu gpl lgpl agpl gfdl mpl epl bsl cddl eupl ofl afl psf ms pl wtfpl cc cc0 creative commons artistic academic common european sil python microsoft new modified simplified original clause clear patent".split())
FULL = 60


def all_templates() -> dict[str, str]:
    """TEMPLATES with the notices, titles and tags of the common licenses and the full texts in ``licenses/``."""
    out = dict(TEMPLATES) | _NOTICES
    for short, (title, versions) in _VERSIONED.items():
        gnu = title.startswith("GNU") and "Documentation" not in title
        for v in versions:
            id_ = f"{short.removesuffix('-library')}-{v}"
            forms = [f"{title}, Version {v}", f"{title} v {v}", f"{title} v{v}", f"{title} {v}"]
            if gnu:  # version 3 as well as 3.0
                n = v.removesuffix(".0")
                forms += [f"{title}, version {n}", f"{title} v{n}", f"version {n} of the {title}", f"GNU {short.removesuffix('-library')} v{n}", f"GNU {short.removesuffix('-library')} version {n}"]
                out[f"{id_}-or-later-name"] = f"{title}, version {n} or any later version"
            for i, form in enumerate(dict.fromkeys(forms)):
                out[f"{id_}-name" + (f"-{i + 1}" if i else "")] = form
    for id_, titles in _TITLES.items():
        for i, title in enumerate(titles):
            out[f"{id_}-name" + (f"-{i + 1}" if i else "")] = title
    tags = list(_TAGS)
    for parts in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for v, where in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
            id_ = f"CC-{parts}-{v}"
            tags.append(id_)
            out.setdefault(id_, f"Licensed under CC {parts} {v}")
            for name, words in (("name", _CC_WORDS), ("name-spaced", _CC_SPACED)):
                out[f"{id_}-{name}"] = f"Creative Commons {'-'.join(words[p] for p in parts.split('-'))} {v} {where} License"
    for tag in tags:
        out[f"{tag}-spdx"] = f"SPDX-License-Identifier: {tag}"
    for f in sorted(resources.files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name):
        out[f"{f.name.removesuffix('.txt')}-full"] = f.read_text(encoding="utf-8")
    return out


def told_apart(words: list[str], full: bool) -> list[bool]:
    """Which words tell variants apart."""
    out, version = [], False
    for w in words:
        digit = any(c.isdigit() for c in w)
        strong = w in _STRONG or (digit and (version or not full))
        out.append(strong or (not full and w in _WEAK))
        # 2.0 is two words; v2 holds its v
        version = w in ("version", "v") or (digit and (version or w[0] == "v"))
    return out


def grams(docs: DataFrame, k: int = GRAM) -> DataFrame:
    """(doc_id, grams): the hashes of all k consecutive words of each document in order."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        words, owner = K.word_hashes(K.Block(texts_of(part)))
        h, inside = K.windows(words, owner, k)
        n = np.maximum(np.bincount(owner, minlength=part.num_rows) - k + 1, 0)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), lists(np.append(0, np.cumsum(n)), signed(h[inside]), pa.int64())], ["doc_id", "grams"])

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    return map_text(rows, run, f"doc_id {kind}, grams array<long>")


def template_grams(spark: SparkSession, templates: dict[str, str], k: int = GRAM) -> DataFrame:
    """(license, pos, gram, total): the k-grams of the templates; total: how many the template has."""
    rows = []
    for name, text in templates.items():
        words, owner = K.word_hashes(K.Block([text]))
        h, _ = K.windows(words, owner, k)
        rows += [(name, i, x, len(h)) for i, x in enumerate(signed(h).tolist())]
    return spark.createDataFrame(rows, "license string, pos int, gram long, total int")


def spans(docs: DataFrame, templates: dict[str, str], k: int = GRAM, neighbour: int = NEIGHBOUR, votes: float = VOTES) -> DataFrame:
    """(doc_id, license, from, to): word spans whose merged diagonals have enough votes."""
    places = sized(template_grams(docs.sparkSession, templates, k), 64)
    hits = grams(docs, k).select("doc_id", F.posexplode("grams").alias("at", "gram")).join(places, "gram")
    diagonals = hits.groupBy("doc_id", "license", (F.col("at") - F.col("pos")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("at").alias("from"), F.max("at").alias("to"), F.max("total").alias("total"))
    w = W.partitionBy("doc_id", "license").orderBy("diagonal")
    new = F.when(F.col("diagonal") - F.lag("diagonal").over(w) <= neighbour, 0).otherwise(1)
    merged = diagonals.withColumn("new", new).withColumn("span", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    voted = merged.groupBy("doc_id", "license", "span").agg(F.sum("votes").alias("votes"), F.min("from").alias("from"), (F.max("to") + k).alias("to"), F.max("total").alias("total"))
    return voted.where(F.col("votes") >= votes * F.col("total")).select("doc_id", "license", "from", "to")


def _spelled(block: K.Block) -> list[str]:
    starts, ends, _ = K.word_spans(block)
    return [block.text[a:b].lower() for a, b in zip(starts.tolist(), ends.tolist())]


def _earliest(x: list[int], y: list[int]) -> list[int]:
    """Positions in x of a longest common subsequence of x and y that ends as early as it can, by bit rows over y (a zero
    bit where the length grows)."""
    places: dict[int, int] = {}
    for j, w in enumerate(y):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows = [full]
    v = full
    for w in x:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, i, j = [], len(x), len(y)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    now = length(i, j)
    while now:
        if length(i - 1, j) == now:
            i -= 1
        elif length(i, j - 1) == now:
            j -= 1
        else:
            i, j, now = i - 1, j - 1, now - 1
            out.append(i)
    return out[::-1]


def common_words(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b: of those that end first, one that starts last."""
    got = _earliest(a, b)
    if not got:
        return got
    end = got[-1]
    return [end - i for i in _earliest(a[end::-1], b[::-1])][::-1]


def copies(own: list[int], want: list[int], accept, need: int) -> Iterator[list[int]]:
    """Positions of the words of each copy of want in own, from left to right; copies don't overlap. accept: the positions
    to keep of a copy, or none if it is another variant's."""
    at, size = 0, 2 * len(want) + 2 * NEIGHBOUR
    while len(own) - at >= need:
        part = own[at : at + size]
        got = common_words(part, want)
        if len(got) >= need:
            kept = accept([at + i for i in got])
            # words before may be a copy that is less complete
            if got[0] >= need:
                before = own[at : at + got[0]]
                yield from ([at + i for i in c] for c in copies(before, want, lambda c, at=at: [i - at for i in accept([at + i for i in c])], need))
            if kept:
                yield kept
            at += (got[-1] if kept or len(want) >= FULL else got[0]) + 1
        elif at + size >= len(own):
            break
        else:
            at += max(1, len(want) // 2)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, found: float = FOUND, k: int = GRAM, **options) -> DataFrame:
    """(doc_id, license, start, end, score): verified spans in characters; score: the share of the template's words found."""
    templates = all_templates() if templates is None else templates
    kind = docs.schema["doc_id"].dataType.simpleString()
    sides = spans(docs, templates, k, **options).groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("license", "from", "to"))).alias("spans"))
    sides = materialise(sides, "license-spans")
    # a row holds as many spans as its document: counted as such
    sides = F.broadcast(sides) if small(sides.agg(F.coalesce(F.sum(F.size("spans") + 1), F.lit(0))).first()[0], SPAN_BYTES) else sides
    words, apart, last = {}, {}, {}
    for name, text in templates.items():
        block = K.Block([text])
        words[name] = K.word_hashes(block)[0].tolist()
        last[name] = (_spelled(block) or [""])[-1]
        apart[name] = Counter(w for w, x in zip(words[name], told_apart(_spelled(block), len(words[name]) >= FULL)) if x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                block = K.Block(texts_of(part))
                starts, ends, owner = K.word_spans(block)
                h = K.span(K.prefix_sums(K.tables()[1][block.cps]), starts, ends)
                first = np.searchsorted(owner, np.arange(part.num_rows + 1))
                out = []
                for d, (doc_id, found_spans) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("spans").to_pylist())):
                    own, base = h[first[d] : first[d + 1]].tolist(), first[d]
                    begins, stops = starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]]
                    spelled = lambda i, j: [block.text[begins[x] : stops[x]].lower() for x in range(i, j)]  # noqa: B023, E731
                    seen = []
                    for s in found_spans:
                        want = words[s["license"]]
                        full, need = len(want) >= FULL, max(1, int(np.ceil(found * len(want) - 1e-9)))

                        def accept(got: list[int]) -> list[int]:
                            while len(got) >= need:
                                i, j = got[0], got[-1] + 1
                                matched = set(got)
                                marks = told_apart(spelled(i, j), full)
                                changed = any(m and x not in matched for x, m in enumerate(marks, i))
                                have = Counter(own[x] for x, m in enumerate(marks, i) if m and x in matched)
                                # 2.1 isn't 2, nor BSD-3-Clause-Clear BSD-3-Clause
                                joined = j < len(own) and begins[j] == stops[j - 1] + 1 and block.text[stops[j - 1]] in ".-" and (w := spelled(j, j + 1))[0] not in ("only", "or") and (told_apart(w, False)[0] and (block.text[stops[j - 1]] == "-" or (w[0].isdigit() and spelled(j - 1, j)[0][-1:].isdigit())))
                                lost = apart[s["license"]] - have
                                if lost == Counter(want[-1:]) and j < len(own):  # run together with the next word
                                    tail = spelled(j, j + 1)[0].removeprefix(last[s["license"]])
                                    lost = {} if tail[:1].isalpha() and tail != spelled(j, j + 1)[0] else lost
                                if not changed and not joined and (full or not lost):
                                    return got
                                # words far from the rest may be chance matches
                                if len(got) > 1 and got[1] - got[0] > NEIGHBOUR + 1:
                                    got = got[1:]
                                elif len(got) > 1 and got[-1] - got[-2] > NEIGHBOUR + 1:
                                    got = got[:-1]
                                else:
                                    cut = next((x for x in range(1, len(got)) if got[x] - got[x - 1] > NEIGHBOUR + 1), 0)
                                    got = got[cut:] if cut and 2 * cut < len(got) else got[:cut] if cut else []
                            return []

                        # words before and after the outermost matches may belong to the template too
                        a, b = max(0, s["from"] - len(want) // 2), min(len(own), s["to"] + len(want) // 2)
                        for got in copies(own[a:b], want, lambda c, a=a: [x - a for x in accept([a + x for x in c])], need):
                            i, j = base + a + got[0], base + a + got[-1]
                            seen.append((len(got), len(got) / len(want), s["license"], int(starts[i] - block.starts[d]), int(ends[j] - block.starts[d])))
                    taken: list[tuple[int, int]] = []
                    for _, score, name, a, b in sorted(seen, key=lambda x: (-x[0], -x[1], x[2:])):
                        if all(b <= x or a >= y for x, y in taken):
                            taken.append((a, b))
                            out.append((doc_id, name, a, b, round(score, 6)))
                if out:
                    c = list(zip(*dict.fromkeys(out)))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], part.column("doc_id").type), pa.array(c[1]), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4])], ["doc_id", "license", "start", "end", "score"])

    rows = docs.where("text is not null").select("doc_id", "text").join(sides, F.col("doc_id") == F.col("id")).select("doc_id", "text", "spans")
    return rows.mapInArrow(run, f"doc_id {kind}, license string, start long, end long, score double").distinct()


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
