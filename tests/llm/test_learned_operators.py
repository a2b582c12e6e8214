"""Toxicity and language identification: held-out accuracy and odd inputs."""

import random
import zlib

from pyspark.sql import functions as F

from docweft.llm import language, stages, toxicity

CLEAN = "the quick report says that many people like to walk in a green park near rivers every week".split()
BAD = ["blarg", "snorf", "grunk"]


def corpus(n, rng):
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = corpus(800, random.Random(5))
    rows += [(9000, None), (9001, ""), (None, "blarg snorf"), (9002, "the park\n" * 20000 + "Snorf, grunk! BLARG")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, toxic int")
    table = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, table).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
        if r.doc_id in truth:
            assert r.predicted == truth[r.doc_id]
    by = {r.doc_id: r for r in got}
    assert by[9000].predicted == 0 and by[9001].score == by[9000].score and by[9002].predicted == 1 and by[None].predicted == 1


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, none).first().score < 0.001
    assert toxicity.score_toxicity(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, one).first().predicted == 0


def test_swaps_lower_the_weight_of_identity_terms(spark):
    rng = random.Random(7)
    rows, labels = corpus(600, rng)
    biased = []
    for (i, text), (_, toxic) in zip(rows, labels):
        if toxic and rng.random() < 0.9 or rng.random() < 0.02:
            text += " muslim"
        biased.append((i, text))
    docs, table = spark.createDataFrame(biased, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    neutral = "people like a muslim in the park"

    def score(penalty):
        model = toxicity.fit(docs, table, penalty=penalty)
        return toxicity._score(toxicity.pa.array([neutral]), model.table(), model.bias)[0]

    assert score(30.0) < score(0.0) and score(30.0) < 0.3
    terms = toxicity.Terms.of(toxicity.IDENTITY_GROUPS)
    assert terms.swapped("A Muslim and a woman") == ["A christian and a man", "A person and a person"]
    assert terms.swapped("Elle et lui, er und sie") == ["il et lui, sie und er", "person et lui, person und person"] and terms.swapped("nobody there") == []


def test_the_penalty_closes_the_gap_on_held_out_rows(spark):
    rng = random.Random(17)
    rows, labels = corpus(800, rng)
    rows = [(i, t + (" he " if rng.random() < (0.7 if toxic else 0.1) else " she ")) for (i, t), (_, toxic) in zip(rows, labels)]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    gaps = []
    for penalty in (0.0, toxicity.PENALTY):
        model = toxicity.fit(docs, table, penalty=penalty)
        changes = {r.doc_id: r.change for r in toxicity.swap_changes(docs, model).collect()}
        assert len(changes) == len(rows)
        gaps.append(sum(changes[i] for i in held) / len(held))
    assert gaps[1] < 0.3 * gaps[0]


def test_samples_are_bounded_by_rows(spark):
    docs = spark.range(3000).selectExpr("1L AS doc_id", "concat('word number ', id) AS text", "'en' AS lang").unionByName(spark.createDataFrame([(2, "der die das", "de"), (3, "same", "en")] * 50, "doc_id long, text string, lang string"))
    table = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert sorted(r.doc_id for r in toxicity.training_rows(docs, table)[0].collect()) == [1, 2, 3]
    rows = language.training_rows(docs, 40).collect()
    assert len(rows) == len({r.text for r in rows}) <= 40 and {r.lang for r in rows} == {"en", "de"}


SAMPLES = {
    "en": "the and of to in is that it was for with as his on be at by this had not are but from or have an they which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat".split(),
    "fr": "le la les de des et un une en que qui dans pour pas sur au avec ce il sont plus par est été mais ou elle nous".split(),
    "es": "el la los las de que y en un una por con no se para es como más pero sus le ya o este sí porque esta entre cuando".split(),
}


def test_language_held_out(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(SAMPLES[lang]) for _ in range(rng.randint(15, 60))), lang) for i, lang in enumerate(rng.choices(list(SAMPLES), k=600))]
    odd = [(1000, None, "en"), (1001, "", None), (1002, "123 --- 456", "en"), (None, "der die und das nicht eine", None), (1003, "日本語のテキスト", None), (1004, "le la les des " * 20000, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows + odd], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 100 and sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.97 * len(held)
    assert all(got[i].held_out for i, _, _ in held) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert got[None].lang_pred == "de" and got[1003].lang_pred in SAMPLES and got[1004].lang_pred == "fr"


def test_language_without_examples(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.identify(docs).first().lang_pred == "und"
    assert language.identify(docs.limit(0)).count() == 0
    single = spark.createDataFrame([(i, "some text here", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(single).collect()} == {"en"}


def test_families_come_first():
    assert language.family("pt-BR") == "romance" and language.family("xx") == "xx"


def test_texts_of_no_learned_language_go(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(SAMPLES[lang]) for _ in range(rng.randint(15, 60))), lang) for i, lang in enumerate(rng.choices(list(SAMPLES), k=600))]
    unlike = ["hyvää huomenta kaikille tänään on kaunis päivä ja aurinko paistaa kirkkaasti metsän yllä kun linnut laulavat", "dzień dobry wszystkim dzisiaj jest piękny dzień i słońce świeci jasno nad lasem kiedy ptaki śpiewają"]
    unlike += [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(3, 9))) for _ in range(30)) for _ in range(20)]
    docs = spark.createDataFrame(rows + [(1000 + i, t, None) for i, t in enumerate(unlike)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in stages.identify_language(spark, docs, "").collect()) == list(range(600))
    clash = stages.identify_language(spark, docs.withColumns({"_found": F.lit("own"), "__FOUND": F.lit("too")}), "")
    assert {tuple(r) for r in clash.select("_found", "__FOUND").collect()} == {("own", "too")}


def test_letters_stay_where_no_language_can_be_learned(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "123", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in stages.identify_language(spark, docs, "").collect()] == [1]
