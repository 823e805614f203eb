import os
import random

import pytest

import __spark_entry__
import corpus_pipeline
from loomquery.llm import bpe, decontaminate, exact_dedup, langid, near_dedup
from loomquery.llm import kernels as K
from tests.llm.test_dedup import brute_groups

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="the tables aren't here")


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontaminate", "byte_bpe"]
    known = __spark_entry__.queries()
    assert "pipeline" in known and all(sum(n.startswith(f"op{i}_") for n in known) == 1 for i in range(1, 11))


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    rejected = {r.doc_id for r in langid.identify(docs).where("rejected").collect()}
    rows = {i: t for i, t in rows.items() if i not in rejected}
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i], i)
    rows = {i: t for t, i in first.items()}
    gone = brute_groups(list(rows.items()), near_dedup.THRESHOLD)
    rows = {i: t for i, t in rows.items() if i not in gone}
    import re

    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [plain(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if not any(x in plain(t) for x in items)}
    got = corpus_pipeline.run(spark, DATA)
    out = {r.doc_id: r.ids for r in got.collect()}
    assert out.keys() == rows.keys()
    e = bpe.encoder(bpe.VOCABULARY)
    for i, t in rows.items():
        assert e.encode(K.Block([t]))[0].tolist() == list(out[i])


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("band", langid.F.lit(1)).withColumn("ids", langid.F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_stages_over_an_odd_table(spark, tmp_path):
    """Nulls in every column, empty, very long, repeated and copied texts, and an empty table, through all stages in turn."""
    real = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    pool = " ".join(t for _, t, lang, _, _ in real if lang == "en").split()
    long = " ".join(random.Random(1).choices(pool, k=60_000))  # no passage of the benchmark is left in it
    odd = [(None, None, None, None, None), (9001, None, "en", None, 0), (9002, "", None, "x", 0), (9003, "12 34 !!", None, None, None), (9004, long, None, None, None), (None, long + " in another end", None, None, None), (9005, long, "en", "y", 1), (9004, long, None, None, None), *real[:3]]
    for i, rows in enumerate((real + odd, [])):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{i}")
            stage(spark, docs, DATA).write.parquet(path)
            docs = spark.read.parquet(path)
        out = docs.collect()
        assert docs.columns == ["doc_id", "ids", "offsets", "round_trip"] and all(r.round_trip for r in out)
        ids = [r.doc_id for r in out]
        assert not {9001, 9002, 9003, 9005} & set(ids) and len([x for x in ids if x is not None]) == len({x for x in ids if x is not None})
        assert bool(rows) == bool(out) and (not rows or ids.count(9004) == 1)


def test_modules():
    assert all(m.__doc__ and "Defined cases" in m.__doc__ for m in (bpe, decontaminate, exact_dedup, langid, near_dedup))
