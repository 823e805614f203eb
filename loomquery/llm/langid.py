"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays, with calibrated rejection.

One model per language is fitted on a bounded sample of labelled rows (``TRAIN_DOCS`` and ``CALIBRATE_DOCS``
a language, the rows of smallest id hash): Spark counts the n-grams of the highest order; all lower orders
follow from them by Kneser-Ney continuation counts. Every document is then scored over its whole text under
every language; the lowest cross-entropy a character wins, unless it is beyond the limit that the held-out
half of the sample set for a text of that length, in which case the document is rejected.

Defined cases: null or letterless text is rejected with a null language and score; rows with a null ``lang`` or
``doc_id`` aren't trained on but are scored; without any labelled row all documents are rejected; a tie goes to the
language first in alphabetical order; repeated rows are scored alike; very long texts are scored whole, in one block of
about 60 bytes a character; other columns are ignored by ``identify`` and kept by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import kernels as K
from .common import map_text, pieces, read, signed, texts_of

ORDER = 5
TRAIN_DOCS = 400
CALIBRATE_DOCS = 800
#: Held-out documents are standardised for their length; the limit is this quantile of theirs times the margin. The
#: quantile leaves room for rows of a wrong label.
QUANTILE, MARGIN, LEAST_LIMIT = 0.98, 2.0, 8.0
_BITS = 12
_BLANK = np.uint64(32)


def sequence(block: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """12-bit codes of the lower-cased letters, anything else between them as one blank; their owners. Letters beyond
    U+0FFF are folded into the 12 bits, so that five fit into an integer; those that share a code are one letter to the
    models (of Han, about five a code)."""
    kind, lower, _ = K.tables()
    k = kind[block.cps]
    letter = (k == K.LETTER) | (k == K.MARK)
    at = np.flatnonzero(letter | np.append(False, letter[:-1]))
    cps = np.where(letter[at], lower[block.cps[at]], 32)
    return ((cps ^ (cps >> _BITS)) & ((1 << _BITS) - 1)).astype(np.uint64), block.owner(at)


def ngrams(codes: np.ndarray, owner: np.ndarray, order: int) -> np.ndarray:
    """At each character, it and the order-1 before it packed into an integer; blanks stand before a text."""
    out = codes.copy()
    for j in range(1, order):
        before = np.full(len(codes), _BLANK)
        before[j:] = np.where(owner[j:] == owner[:-j], codes[:-j], _BLANK)
        out |= before << np.uint64(_BITS * j)
    return out


@dataclass
class Model:
    """tables[n-1]: the n-grams seen in any language and their log-probability in each language; contexts[n-1]:
    the contexts of order-n n-grams and the logarithm of their back-off weights."""

    languages: list[str]
    tables: list[tuple[K.SortedHash, np.ndarray]]
    contexts: list[tuple[K.SortedHash, np.ndarray]]
    unseen: np.ndarray
    mean: np.ndarray = None
    within: np.ndarray = None
    between: np.ndarray = None
    limit: np.ndarray = None

    def logp(self, keys: np.ndarray, n: int | None = None) -> np.ndarray:
        """Natural logarithms of the interpolated probabilities: a row a key, a column a language."""
        n = n or len(self.tables)
        table, values = self.tables[n - 1]
        at = table.find(keys)
        out = values[at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            if n == 1:
                out[miss] = self.unseen
            else:
                left = keys[miss]
                weights, logs = self.contexts[n - 1]
                c = weights.find(left >> np.uint64(_BITS))
                out[miss] = self.logp(left & np.uint64((1 << _BITS * (n - 1)) - 1), n - 1) + np.where(c[:, None] >= 0, logs[c], 0)
        return out

    def entropies(self, block: K.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: characters scored, cross-entropy a character by language, mean square of the log-probabilities."""
        codes, owner = sequence(block)
        n = np.bincount(owner, minlength=len(block.starts))
        total = np.zeros((len(n), len(self.languages)))
        square = np.zeros_like(total)
        if len(codes):
            lp = self.logp(ngrams(codes, owner, len(self.tables)))
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            total[owner[first]] = np.add.reduceat(lp, first, axis=0, dtype=np.float64)
            square[owner[first]] = np.add.reduceat(lp * lp, first, axis=0, dtype=np.float64)
        return n, -total / np.maximum(n, 1)[:, None], square / np.maximum(n, 1)[:, None]

    def standard(self, n: np.ndarray, entropy: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """How many standard deviations of a text of n characters the entropy lies above the language's mean."""
        return (entropy - self.mean[lang]) / np.sqrt(self.between[lang] + self.within[lang] / np.maximum(n, 1))


def kneser_ney(grams: list[tuple[np.ndarray, np.ndarray]], languages: list[str], order: int) -> Model:
    """The model from each language's n-grams of the highest order and their counts."""
    by_order: list[list] = [[] for _ in range(order)]
    for keys, counts in grams:
        for n in range(order, 0, -1):
            by_order[n - 1].append((keys, counts))
            short = np.sort(keys & np.uint64((1 << _BITS * (n - 1)) - 1))  # one for each different n-gram: continuation counts
            keys, counts = np.unique(short, return_counts=True)
    letters = len(np.unique(np.concatenate([k for k, _ in by_order[0]]))) + 1
    tables, contexts = [], []
    below: K.SortedHash | None = None
    probs = unseen = None
    for n in range(1, order + 1):
        table = K.SortedHash(np.unique(np.concatenate([k for k, _ in by_order[n - 1]])))
        keys = table.keys[table.order]
        ctx = keys >> np.uint64(_BITS)
        held = K.SortedHash(np.unique(ctx))
        at_ctx = held.find(ctx)
        p = np.zeros((len(keys), len(languages)))
        backoff = np.ones((len(held.order), len(languages)))
        for j, (own, counts) in enumerate(by_order[n - 1]):
            n1, n2 = (counts == 1).sum(), (counts == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            c = held.find(own >> np.uint64(_BITS))
            total = np.bincount(c, counts, len(held.order))
            kinds = np.bincount(c, minlength=len(held.order))
            seen = total > 0
            backoff[seen, j] = d * kinds[seen] / total[seen]
            p[table.find(own), j] = (counts - d) / total[c]
        lower = np.full((1, len(languages)), 1 / letters) if n == 1 else probs[below.find(keys & np.uint64((1 << _BITS * (n - 1)) - 1))]
        probs = p + backoff[at_ctx] * lower
        if n == 1:
            unseen = np.log(backoff[0] / letters)
        tables.append((table, np.log(probs).astype(np.float32)))
        contexts.append((held, np.log(backoff).astype(np.float32)))
        below = table
    for held, _ in (*tables, *contexts):
        held.slim()
    return Model(languages, tables, contexts, unseen.astype(np.float32))


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                block = K.Block(texts_of(part))
                codes, owner = sequence(block)
                keys = ngrams(codes, owner, order)
                label = np.array(part.column("lang").to_pylist(), object)[owner]
                for lang in dict.fromkeys(part.column("lang").to_pylist()):
                    k, c = np.unique(keys[label == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(signed(k)), pa.array(c, pa.int64())], ["lang", "gram", "n"])

    return run


def train(docs: DataFrame, order: int = ORDER, train_docs: int = TRAIN_DOCS, calibrate_docs: int = CALIBRATE_DOCS) -> Model | None:
    """Fit on the labelled rows of smallest id hash: the first ``train_docs`` of a language count n-grams, the next
    ``calibrate_docs`` set the limits. None if there are no labelled rows with letters."""
    labelled = docs.where("lang is not null and doc_id is not null and text is not null").select("doc_id", "lang", "text")
    hashed = labelled.select("lang", F.xxhash64("doc_id").alias("h"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    cuts = hashed.withColumn("r", rank).where(F.col("r") <= train_docs + calibrate_docs).groupBy("lang").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("h")).alias("hs")).collect()
    if not cuts:
        return None
    # where a language has fewer rows than asked for, they are split in the same proportion
    first, last = {}, {}
    for r in cuts:
        some = max(1, round(r.n * train_docs / (train_docs + calibrate_docs)))
        first[r.lang], last[r.lang] = r.hs[some - 1], r.hs[-1]
    spark = docs.sparkSession
    limits = F.broadcast(spark.createDataFrame([(k, first[k], last[k]) for k in first], "lang string, first long, last long"))
    sample = labelled.join(limits, "lang").withColumn("h", F.xxhash64("doc_id")).where("h <= last")
    counted = sample.where("h <= first").select("lang", "text").mapInArrow(_count(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(counted.column("lang").to_pylist(), object)
    gram, n = counted.column("gram").to_numpy().view(np.uint64), counted.column("n").to_numpy()
    languages = sorted(set(langs.tolist()))
    if not languages:
        return None
    grams = []
    for lang in languages:
        own = np.flatnonzero(langs == lang)
        own = own[np.argsort(gram[own])]
        grams.append((gram[own], n[own]))
    model = kneser_ney(grams, languages, order)
    shared = spark.sparkContext.broadcast(model)
    index = {lang: j for j, lang in enumerate(languages)}

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        chars, entropy, square = shared.value.entropies(K.Block(texts_of(part)))
        lang = np.array([index.get(x, -1) for x in part.column("lang").to_pylist()])
        use = np.flatnonzero((lang >= 0) & (chars > 0))
        lang, row = lang[use], entropy[use, lang[use]]
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(chars[use], pa.int64()), pa.array(row), pa.array(square[use, lang])], ["lang", "n", "entropy", "square"])

    held = map_text(sample.select("lang", "text", "h", "first").where("h > first").select("lang", "text"), score, "lang int, n long, entropy double, square double").toArrow()
    if held.num_rows == 0:  # so few rows that none is held out
        held = map_text(sample.select("lang", "text"), score, "lang int, n long, entropy double, square double").toArrow()
    shared.unpersist()
    lang, chars, entropy, square = (held.column(c).to_numpy() for c in ("lang", "n", "entropy", "square"))
    k = len(languages)
    model.mean, model.within, model.between, model.limit = np.zeros(k), np.ones(k), np.ones(k), np.full(k, LEAST_LIMIT)
    for j in range(k):
        own = lang == j if (lang == j).any() else np.ones(len(lang), bool)  # a language without held-out rows: all of them
        n, e = chars[own], entropy[own]
        if not len(n):
            continue
        mean = np.median(np.repeat(e, np.minimum(np.maximum(n // 100, 1), 50)))
        model.mean[j] = mean
        model.within[j] = max(np.average(square[own] - e * e, weights=n), 0.25)
        model.between[j] = max(np.average((e - mean) ** 2 - model.within[j] / n, weights=np.minimum(n, 1000)), 0.01)
        z = model.standard(n, e, np.full(len(n), j))
        model.limit[j] = max(LEAST_LIMIT, MARGIN * np.quantile(z, QUANTILE))
    return model


def identify(docs: DataFrame, model: Model | None = None, **options) -> DataFrame:
    """(doc_id, lang_id, entropy, rejected) of every row of docs."""
    model = model or train(docs, **options)
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("string").alias("lang_id"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        chars, entropy, _ = m.entropies(K.Block(texts_of(part)))
        best = entropy.argmin(1)
        least = entropy[np.arange(len(best)), best]
        none = chars == 0
        rejected = none | (m.standard(chars, least, best) > m.limit[best])
        names = pa.array(np.array(m.languages, object)[best], pa.string(), mask=none | rejected)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), names, pa.array(least, mask=none), pa.array(rejected)], ["doc_id", "lang_id", "entropy", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_text(docs.select("doc_id", "text"), score, f"doc_id {kind}, lang_id string, entropy double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model | None = None, **options) -> DataFrame:
    """The rows of docs that aren't rejected, all columns kept: one pass, no join. The flag is computed beside the
    row, so that rows without an id are judged on their own text."""
    model = model or train(docs, **options)
    if model is None:
        return docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in pieces(batch, "text"):
                chars, entropy, _ = m.entropies(K.Block(texts_of(part)))
                best = entropy.argmin(1)
                least = entropy[np.arange(len(best)), best]
                keep = (chars > 0) & (m.standard(chars, least, best) <= m.limit[best])
                if keep.any():
                    yield part.filter(pa.array(keep)).select(names)

    return docs.mapInArrow(run, docs.schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
