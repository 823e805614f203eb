import math

import pytest
from pyspark.sql import functions as F

from loomquery.functions.text import Tokenizer, stem_word
from loomquery.operators import bm25, fusion, knn


def tokens(spark, text, **options):
    return spark.createDataFrame([(text,)], "text string").select(Tokenizer(**options).tokens(F.col("text")).alias("t")).first().t


def test_tokenizer(spark):
    assert tokens(spark, "The quick brown fox jumps") == ["quick", "brown", "fox", "jumps"]
    assert tokens(spark, "running runner") == ["running", "runner"]
    assert tokens(spark, "foo-bar é x " + "y" * 33) == ["foo", "bar", "é"]
    assert tokens(spark, None) == []
    assert tokens(spark, "can't 3.5 end.") == ["can't", "3.5", "end"]
    assert tokens(spark, "can't 3.5 end.", pattern=r"\w+") == ["can", "end"]


@pytest.mark.parametrize("text,want", [("U.S.A. 1,234.5; 12:30 o’neil", ["u.s.a", "1,234.5", "12", "30", "o’neil"]), ("漢字かな カタカナ", ["漢", "字", "か", "な", "カタカナ"]), ("a.3 3.a x__y __zz ___ foo_", ["x__y", "__zz", "foo_"]), ("'quoted' (don't.stop)", ["quoted", "don't.stop"]), ("नमस्ते ñu naïve", ["नमस्ते", "ñu", "naïve"]), ("", [])])
def test_unicode_words(spark, text, want):
    assert tokens(spark, text) == want == Tokenizer().query(text)


def test_words_of_any_length(spark):
    """Neither overflows the matcher's stack nor is cut."""
    text = "a1" * 50_000 + " " + "1,2" * 50_000 + " " + "x.y" * 50_000
    assert [len(w) for w in tokens(spark, text, most=1 << 20)] == [100_000, 150_000, 150_000]


@pytest.mark.parametrize("word,stem", [("running", "run"), ("jumps", "jump"), ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("relational", "relat"), ("hopeful", "hope"), ("generalization", "general"), ("happy", "happi"), ("skies", "sky"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"), ("national", "nation"), ("probate", "probat"), ("controll", "control"), ("communication", "communic"), ("by", "by")])
def test_stems(word, stem):
    assert stem_word(word) == stem


#: Words of the published vocabularies.
VOCABULARIES = {
    "de": "aufeinander:aufeinand aufeinanderfolge:aufeinanderfolg kategorie:kategori kategorischen:kategor häuser:haus laufen:lauf kleinigkeiten:kleinig schönheit:schonheit ergebnisse:ergebnis straße:strass bauern:bau",
    "fr": "continu:continu continua:continu continuait:continu continuellement:continuel majestueusement:majestu majorité:major mains:main maintenait:mainten mangeaient:mang chevaux:cheval bateaux:bateau nationalité:national contradiction:contradict constamment:const",
    "es": "chicas:chic cheque:chequ torearon:tor toros:tor torres:torr naciones:nacion rápidamente:rapid comprándolo:compr haciendo:hac hablábamos:habl",
    "it": "abbandonata:abbandon abbandonavano:abbandon abbandonerò:abbandon pronto:pront pronunciata:pronunc proporzione:proporzion abitanti:abit",
    "pt": "quilométricas:quilométr quilos:quil quilômetro:quilômetr boa:boa nações:naçõ rapidamente:rapid falando:fal",
    "nl": "lichamelijk:licham lichamelijkheden:licham lichaamsziek:lichaamsziek lichten:licht opgingen:opging opglimpende:opglimp maan:man brood:brod",
    "sv": "jaktkarlarne:jaktkarl jaktkarlens:jaktkarl klokheten:klok klockornas:klock",
    "no": "havnedistriktene:havnedistrikt havnedistrikter:havnedistrikt havneeffekter:havneeffekt oppmerksomhet:oppmerksom",
    "ru": "вагона:вагон важнейшие:важн пьесу:пьес павлович:павлович паденье:паден валерьянка:валерьянк красивый:красив читающий:чита",
    "en": "dying:die lying:lie consign:consign consigned:consign consistency:consist knackeries:knackeri knightly:knight",
}


@pytest.mark.parametrize("language", VOCABULARIES)
def test_stemmers_of_languages(language):
    for pair in VOCABULARIES[language].split():
        word, stem = pair.split(":")
        assert stem_word(word, language) == stem


def test_languages_by_name_and_unknown_ones():
    assert stem_word("häuser", "German") == "haus"
    assert stem_word("running", "klingon") == "run"
    for language in VOCABULARIES:
        for odd in ("", "a", "ab", "aaa", "zzz", "é", "ß", "12"):
            stem_word(odd, language)


def test_stemmed_query_by_brute_force(spark):
    """stemmed_bm25_top10 over the whole table, against BM25 by hand over stems of every token."""
    import os

    from loomquery.queries import QUERIES

    data = "/root/testdata/sf0.001"
    if not os.path.exists(data):
        pytest.skip("the tables aren't here")
    t = Tokenizer(stem=True)
    docs = {r.doc_id: t.query(r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    terms, n, avg = t.query("tions thered onesen"), len(docs), sum(map(len, docs.values())) / len(docs)
    score = {}
    for d, own in docs.items():
        for term in terms:
            f, df = own.count(term), sum(term in x for x in docs.values())
            if f:
                score[d] = score.get(d, 0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(own) / avg))
    want = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]
    got = [(r.id, r.score) for r in QUERIES["stemmed_bm25_top10"](spark, data).orderBy("rank").collect()]
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-6)


DOCS = [(1, "apple banana apple"), (2, "banana cherry"), (3, None)]


def frame(spark):
    return spark.createDataFrame(DOCS, "id long, text string")


def by_hand(terms):
    n, avg, dl = 3, 5 / 3, {1: 3, 2: 2}
    tf = {1: {"apple": 2, "banana": 1}, 2: {"banana": 1, "cherry": 1}}
    out = {}
    for d in tf:
        for t in terms:
            df = sum(t in x for x in tf.values())
            if t in tf[d]:
                f = tf[d][t]
                out[d] = out.get(d, 0) + math.log((n - df + 0.5) / (df + 0.5) + 1) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl[d] / avg))
    return out


@pytest.mark.parametrize("terms", [["apple"], ["banana"], ["apple", "banana"], ["banana", "banana", "cherry"], ["absent"], []])
def test_bm25_by_hand(spark, terms, tmp_path):
    got = {r.id: r.score for r in bm25.score(frame(spark), terms).collect()}
    assert got == pytest.approx(by_hand(terms))
    if terms:
        bm25.build_index(frame(spark), str(tmp_path))
        assert {r.id: r.score for r in bm25.search_index(spark, str(tmp_path), terms).collect()} == pytest.approx(got)


def test_filter_leaves_statistics(spark):
    got = {r.id: r.score for r in bm25.score(frame(spark), ["banana"], where=F.col("id") == 2).collect()}
    assert got == pytest.approx({2: by_hand(["banana"])[2]})


def test_stemmed_search(spark):
    docs = spark.createDataFrame([(1, "the runner was running"), (2, "walks")], "id long, text string")
    t = Tokenizer(stem=True)
    assert [r.id for r in bm25.score(docs, t.query("runs"), t).collect()] == [1]


def lists(spark):
    v = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", 0.3)], "id string, score double")
    t = spark.createDataFrame([("c", 4.0), ("d", 2.0)], "id string, score double")
    return v, t


def test_blend(spark):
    got = [(r.id, round(r.score, 6)) for r in fusion.fuse(*lists(spark), 10, alpha=0.7).collect()]
    assert got == [("a", 0.7), ("b", 0.7), ("c", round(0.7 / 3 + 0.3, 6)), ("d", 0.15)]


def test_rrf(spark):
    got = [(r.id, r.score) for r in fusion.fuse(*lists(spark), 10, "rrf").collect()]
    assert [i for i, _ in got] == ["c", "a", "b", "d"]
    assert got[0][1] == pytest.approx(1 / 63 + 1 / 61)


def test_normalise_of_zeros(spark):
    zeros = spark.createDataFrame([("a", 0.0)], "id string, score double")
    assert fusion.normalise(zeros).first().score == 0
    assert knn.top(fusion.normalise(zeros.limit(0)), 3).collect() == []


def test_postings_move_no_words(spark):
    """Words are counted where their text is: the plan has no exchange."""
    table = spark.createDataFrame([(1, "tion thre tion"), (2, None), (3, ""), (4, "one " * 5000 + "two")], "id long, text string")
    made = bm25.postings(table)
    assert sorted(map(tuple, made.collect())) == [(1, 3, "thre", 1), (1, 3, "tion", 2), (4, 5001, "one", 5000), (4, 5001, "two", 1)]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
