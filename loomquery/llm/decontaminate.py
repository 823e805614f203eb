"""Benchmark decontamination by template canonicalisation.

Texts become tokens: lower-cased words, with typed placeholders for numbers (digits and number words), units (symbols,
and unit words after a number) and, in the first of two families of templates, names (capitalised words); in the second
family names stay words, so that a leak in another letter case is met too. A third family holds the values of the
windows that the templates drop, those that are mostly placeholders. Windows of ``WINDOW`` template tokens of the
documents pass a filter of bounded size, whatever the number of items, and are hash-joined with those of the benchmark
items; pairs of document and item whose windows couldn't cover enough of the item end there. On each diagonal (document
less item position) the slot values must map consistently both ways: the same value of the item always became the same
value of the document. A document is contaminated by an item if consistent diagonals cover at least ``COVERAGE`` of the
item's tokens; it is ``rewritten`` if a slot has another value there.

Number and unit words are those of English, German, French and Spanish.

Defined cases: items shorter than a window are one window of their own length; windows that are mostly placeholders
count only verbatim; null, empty or wordless texts and items match nothing; items without an id and documents without a
``doc_id`` are not reported, and such documents stay; rows that share a ``doc_id`` are judged together; repeated rows
change nothing; repeated items are judged by id; of several ways to cover an item the greatest coverage is reported, a
verbatim one before a rewritten one; a very long text is one block of about 100 bytes a character; empty tables match
nothing, and an empty benchmark leaves all documents; other columns, whatever their names, are kept by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import Bloom, lists, map_text, materialise, read, signed, sized, texts_of, without

WINDOW = 8
COVERAGE = 0.5
#: Slots that agree with the mapping of their diagonal, as a share of its slots.
CONSISTENT = 0.8
LITERAL, NUM, UNIT, NAME = range(4)
#: The family of windows of values.
VERBATIM = 2
_NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice thrice"
_NUMBER_WORDS += " null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million millionen milliarde"
_NUMBER_WORDS += " deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille millions milliard uno dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil millones"
_UNIT_WORDS = "mm cm m km kilometer kilometers kilometre kilometres meter meters metre metres inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds ounce ounces oz ton tons tonnes ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh hz khz mhz ghz w kw mw v kv a j kj cal kcal percent dollar dollars cent cents euro euros usd eur gbp yen degree degrees kelvin celsius fahrenheit"
_UNIT_WORDS += " zentimeter kilogramm gramm sekunden minuten stunde stunden tag tage woche wochen monat monate jahr jahre prozent grad secondes heure heures jour jours semaine semaines mois an ans pourcent centimes segundos minutos hora horas día días semana semanas mes meses año años metros kilómetros gramos litros por ciento grados céntimos dólares"
_SYMBOLS = [ord(c) for c in "%$€£¥°‰"]
_PLACE = K.mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))


def _lexicon(words: str) -> np.ndarray:
    return np.sort(K.word_hashes(K.Block([words]))[0])


def _among(h: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    return lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h


def tokens(block: K.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value hashes (of the lower-cased tokens), types and owners of all tokens."""
    kind, lower, upper = K.tables()
    k = kind[block.cps]
    group = np.where((k == K.LETTER) | (k == K.MARK), 1, np.where(k == K.NUMBER, 2, 0)).astype(np.int8)
    low = block.cps < 0x2031
    group[low & np.isin(block.cps, _SYMBOLS)] = 3
    edge = np.flatnonzero(group[1:] != group[:-1]) + 1
    if group[0]:
        edge = np.append(0, edge)
    token = group[edge] != 0
    starts, ends = edge[token], edge[np.flatnonzero(token) + 1]
    what = group[starts]
    # 1,234.5 is one number
    point = np.zeros(len(starts), bool)
    if len(starts) > 1:
        between = block.cps[ends[:-1]]
        point[1:] = (what[1:] == 2) & (what[:-1] == 2) & (starts[1:] == ends[:-1] + 1) & ((between == 44) | (between == 46))
    head = np.flatnonzero(~point)
    if len(head) < len(starts):
        ends = ends[np.append(head[1:], len(starts)) - 1]
        starts, what = starts[head], what[head]
    owner = block.owner(starts)
    value = K.span(K.prefix_sums(lower[block.cps]), starts, ends)
    type_ = np.zeros(len(starts), np.int8)
    capital = upper[block.cps[starts]] & ~upper[block.cps[np.minimum(starts + 1, len(block.cps) - 1)]]
    type_[(what == 1) & capital] = NAME
    type_[(what == 2) | ((what == 1) & _among(value, _lexicon(_NUMBER_WORDS)))] = NUM
    after = np.append(False, (type_[:-1] == NUM) & (owner[1:] == owner[:-1])) if len(starts) else np.zeros(0, bool)
    type_[(what == 3) | ((what == 1) & after & (type_ != NUM) & _among(value, _lexicon(_UNIT_WORDS)))] = UNIT
    return value, type_, owner


def template_windows(value: np.ndarray, type_: np.ndarray, owner: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(family, size, positions, hashes) of the windows that are at least half words, and of the others by their values."""
    for family in range(2):
        slot = type_ != LITERAL if family == 0 else (type_ != LITERAL) & (type_ != NAME)
        shape = np.where(slot, _PLACE[type_], value)
        words = np.append(0, np.cumsum(~slot))
        for size in sizes:
            h, inside = K.windows(shape, owner, size)
            if len(h):
                ok = np.flatnonzero(inside & (2 * (words[size:] - words[:-size]) >= size))
                yield family, size, ok, h[ok]
    # windows that either family drops
    drop = np.append(0, np.cumsum(type_ == LITERAL))
    for size in sizes:
        h, inside = K.windows(value, owner, size)
        if len(h):
            ok = np.flatnonzero(inside & (2 * (drop[size:] - drop[:-size]) < size))
            yield VERBATIM, size, ok, h[ok]


_COLUMNS = "family int, size int, hash long, pos int, shapes array<int>, vals array<long>, length int"


def _rows(ids: pa.Array, found: list, value: np.ndarray, type_: np.ndarray, owner: np.ndarray, name: str) -> pa.RecordBatch | None:
    if not found:
        return None
    first = np.searchsorted(owner, np.arange(len(ids)))
    length = np.bincount(owner, minlength=len(ids))
    cols: list[list] = [[] for _ in range(7)]
    sizes = []
    for family, size, at, h in found:
        span = (at[:, None] + np.arange(size)).ravel()
        shapes = type_[span]
        if family == 1:  # names are words there
            shapes = np.where(shapes == NAME, LITERAL, shapes)
        elif family == VERBATIM:
            shapes = np.zeros_like(shapes)
        for col, x in zip(cols, (owner[at], np.full(len(at), family), np.full(len(at), size), h, at - first[owner[at]], shapes, value[span])):
            col.append(x)
        sizes.append(np.full(len(at), size))
    own, family, size, h, pos, shapes, vals = (np.concatenate(c) for c in cols)
    edges = np.append(0, np.cumsum(np.concatenate(sizes)))
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(own)), pa.array(family, pa.int32()), pa.array(size, pa.int32()), pa.array(signed(h)), pa.array(pos, pa.int32()), lists(edges, shapes, pa.int32()), lists(edges, signed(vals), pa.int64()), pa.array(length[own], pa.int32())],
        [name, "family", "size", "hash", "pos", "shapes", "vals", "length"],
    )


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All windows of the items; an item of fewer tokens is one window."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
        value, type_, owner = tokens(K.Block(texts_of(part)))
        n = np.bincount(owner, minlength=part.num_rows)
        found = []
        for family, size, at, h in template_windows(value, type_, owner, [s for s in range(1, window + 1) if s == window or (n == s).any()]):
            ok = np.minimum(n[owner[at]], window) == size
            found.append((family, size, at[ok], h[ok]))
        return _rows(part.column("item_id"), found, value, type_, owner, "item_id")

    return map_text(benchmark.where("item_id is not null and text is not null").select("item_id", "text"), run, f"item_id {kind}, {_COLUMNS}")


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, consistent: float = CONSISTENT) -> DataFrame:
    """(doc_id, item_id, coverage, rewritten) of each contaminated document and the item it holds."""
    items = materialise(item_windows(benchmark, window), "item-windows")
    sizes = sorted(r.size for r in items.select("size").distinct().collect())
    known = docs.sparkSession.sparkContext.broadcast(Bloom.of(items.select("hash"), items.count()))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
        value, type_, owner = tokens(K.Block(texts_of(part)))
        found = []
        for family, size, at, h in template_windows(value, type_, owner, sizes):
            hit = known.value.holds(h)
            if hit.any():
                found.append((family, size, at[hit], h[hit]))
        return _rows(part.column("doc_id"), found, value, type_, owner, "doc_id")

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    hits = map_text(rows, run, f"doc_id {kind}, {_COLUMNS}").select("doc_id", "family", "size", "hash", F.col("pos").alias("at"), F.col("shapes").alias("doc_shapes"), F.col("vals").alias("doc_vals"))
    joined = hits.join(items, ["family", "size", "hash"]).where(F.col("shapes") == F.col("doc_shapes"))
    joined = materialise(joined, "window-hits")
    # windows that together are shorter than the share of the item can't cover it
    enough = joined.groupBy("doc_id", "item_id").agg(F.sum("size").alias("most"), F.max("length").alias("of")).where(F.col("most") >= coverage * F.col("of")).select("doc_id", "item_id")
    joined = joined.join(sized(materialise(enough, "window-pairs"), 32), ["doc_id", "item_id"], "left_semi")
    aligned = joined.select("doc_id", "item_id", "family", (F.col("at") - F.col("pos")).alias("diagonal"), "length", "pos", F.posexplode(F.arrays_zip("shapes", "vals", "doc_vals")).alias("j", "t"))
    keys = ["doc_id", "item_id", "family", "diagonal"]
    slot = F.col("shape") != LITERAL
    token = aligned.select(*keys, "length", (F.col("pos") + F.col("j")).alias("place"), F.col("t.shapes").alias("shape"), F.col("t.vals").alias("val"), F.col("t.doc_vals").alias("doc_val")).distinct()
    token = token.where(slot | (F.col("val") == F.col("doc_val")))
    pairs = token.groupBy(*keys, "shape", "val", "doc_val").agg(F.count("*").alias("n"), F.collect_set(F.struct("place", "length")).alias("places"))
    by_key = pairs.withColumn("slot", slot)
    forth = by_key.groupBy(*keys, "shape", "val").agg(F.max("n").alias("n"), F.max("slot").alias("slot")).where("slot").groupBy(*keys).agg(F.sum("n").alias("forth"))
    back = by_key.where("slot").groupBy(*keys, "shape", "doc_val").agg(F.max("n").alias("n")).groupBy(*keys).agg(F.sum("n").alias("back"))
    slots = by_key.where("slot").groupBy(*keys).agg(F.sum("n").alias("slots"))
    bad = slots.join(forth, keys).join(back, keys).where(F.least("forth", "back") < consistent * F.col("slots")).select(*keys)
    good = pairs.join(bad, keys, "left_anti")
    changed = F.col("val") != F.col("doc_val")
    places = good.select("doc_id", "item_id", "family", changed.alias("changed"), F.explode("places").alias("p"))
    # verbatim text counts for the coverage of each family
    families = F.when(F.col("family") == VERBATIM, F.array(*map(F.lit, range(VERBATIM + 1)))).otherwise(F.array("family"))
    places = places.select("doc_id", "item_id", F.explode(families).alias("family"), "changed", "p")
    covered = places.groupBy("doc_id", "item_id", "family", "p.place", "p.length").agg(F.min("changed").alias("changed"))
    total = covered.groupBy("doc_id", "item_id", "family").agg((F.count("*") / F.max("length")).alias("coverage"), F.max("changed").alias("rewritten"))
    best = total.where(F.col("coverage") >= coverage).groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", (~F.col("rewritten")).alias("plain"))).alias("b"))
    return best.select("doc_id", "item_id", F.round("b.coverage", 6).alias("coverage"), (~F.col("b.plain")).alias("rewritten"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones."""
    gone = materialise(matches(docs, benchmark, **options).select("doc_id").distinct(), "contaminated")
    return without(docs, gone)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
