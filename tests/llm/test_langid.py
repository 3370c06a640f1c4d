import itertools
import os
import random
import zlib

import numpy as np
import pytest

from catalograin.llm import langid

DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model(spark):
    texts = {"en": "the quick brown fox jumps over the lazy dog and then this thing goes there with them", "de": "der schnelle braune fuchs springt über den faulen hund und dann geht es dort nicht weiter", "ru": "быстрая коричневая лиса прыгает через ленивую собаку"}
    rows = [(i, text, lang) for i, (lang, text) in enumerate((lang, t) for lang, t in texts.items() for _ in range(12))]
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def brute(scores, penalty):
    """The best labels by trying all, ties aside."""
    n, k = scores.shape
    value = lambda path: sum(scores[i, p] for i, p in enumerate(path)) - penalty * sum(a != b for a, b in itertools.pairwise(path))
    return max(value(p) for p in itertools.product(range(k), repeat=n)), value


def test_viterbi_is_optimal(model):
    labeller = langid.Labeller(model, 2.0)
    texts = ["the fox und der hund", "лиса dog", "then there nicht weiter es", "", "fox", "geht über the dog there"]
    ids, labels, before = labeller.label(texts)
    for i in range(len(texts)):
        part = slice(before[i], before[i + 1])
        if before[i + 1] > before[i]:
            best, value = brute(labeller.scores[ids[part]].astype(float), 2.0)
            assert value(labels[part]) == pytest.approx(best, abs=1e-3)


def test_spans_of_mixed_text(spark, model):
    text = "the quick brown fox jumps over the lazy dog und dann springt der schnelle fuchs über den faulen hund быстрая лиса прыгает"
    row = langid.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [s["lang"] for s in row["spans"]] == ["en", "de", "ru"]
    assert sum(s["n_words"] for s in row["spans"]) == len(text.split())


def test_scripts_narrow_candidates(model):
    assert model.allowed["Cyrillic"].tolist() == [False, False, True]
    labeller = langid.Labeller(model, 2.0)
    labeller.label(["собака"])
    assert labeller.scores[0].argmax() == 2 and (labeller.scores[0][:2] <= -29).all()


def test_edges(spark, model, edge_docs, no_docs):
    rows = langid.identify(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1, 2, 3, 7))
    assert by_id[5]["lang_pred"] in ("en", "de") and 0 < by_id[5]["score"] <= 1
    assert langid.identify(no_docs, model).count() == 0
    kept = langid.keep_known(edge_docs, model)
    assert kept.columns == edge_docs.columns and {r["doc_id"] for r in kept.collect()} == {4, None, 5, 6}
    nothing = langid.fit(no_docs)
    assert {r["lang_pred"] for r in langid.identify(edge_docs, nothing).collect()} == {"und"}


def test_held_out_rows_are_never_learned(spark):
    rows = [(i, "gemeinsam" if zlib.crc32(str(i).encode()) % 4 != 2 else "heldout", "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert "<heldout>" not in langid.fit(docs).gram and "<gemeinsam>" in langid.fit(docs).gram
    assert docs.where(langid.held_out()).count() == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in range(40))


def test_scripts_and_languages_never_learned(spark):
    """Letters of unknown scripts lower the score; texts far from all that was learned are not kept."""
    rng = random.Random(3)
    words = {"en": "the of and that with from this have which their would there other about into than them some time".split(), "de": "der die und das mit von nicht eine sich auch werden nach einer oder wenn noch nur mehr aber".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(40)), lang) for i in range(400) for lang in ("en", "de")]
    rows += [(2000 + i, f"one{i} row", f"x{i}") for i in range(300)]  # many rare languages, all learned
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) > 200 and model.floor > -20
    texts = [(1, "语言识别文本" * 10), (2, "the of and 语言识别文本"), (3, " ".join("qxzv jwkq zzxw vvqj kkxz"[j % 5 * 5 :][:4] for j in range(40))), (4, rows[0][1]), (5, rows[1][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(docs, model, spans=False).collect()}
    assert got[1]["score"] == 0 and got[1]["lang_pred"] in model.languages and got[2]["score"] == pytest.approx(8 / 14)
    assert {r["doc_id"] for r in langid.keep_known(docs, model).collect()} == {2, 4, 5}


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    got = langid.identify(docs, langid.fit(docs), spans=False).toPandas()
    want = docs.where(langid.held_out()).where("lang IS NOT NULL").select("doc_id", "lang").toPandas()
    both = want.merge(got, on="doc_id")
    assert len(both) > 100 and np.mean(both.lang == both.lang_pred) > 0.98
