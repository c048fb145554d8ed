import zlib

import numpy as np

from twinraster.llm import language_id as L
from twinraster.llm.common import table
from twinraster.llm.language_id_query import predicted


def test_presence_follows_the_definition():
    for text in ("abc", "Hello, WORLD 42!", "a b  c\nd"):
        places = L.present(text.encode())
        short = {p for p in places.tolist() if p < L._OFFSET[3]}
        blank = " ".join(text.lower().replace(",", " ").replace("!", " ").replace("4", " ").replace("2", " ").split())
        expected = {(" " + blank + " ")[i: i + n] for n in (1, 2) for i in range(len(blank) + 3 - n)}
        found = {bytes([p]).decode() if p < 256 else bytes(divmod(p - 256, 256)).decode() for p in short}
        assert expected <= found <= expected | {"  "}


def test_folded_weights_equal_kernel_rows():
    rng = np.random.default_rng(3)
    words = {"aa": ["alpha", "beta", "gamma"], "bb": ["uno", "dos", "tres", "cuatro"]}
    sample = [(lang, " ".join(rng.choice(words[lang], 30))) for lang in words for _ in range(20)]
    places = [L.present(t.encode()) for _, t in sample]
    model = L.fit(places, [lang for lang, _ in sample])
    outputs = model.scores(places)
    assert [model.languages[i] for i in outputs.argmax(axis=1)] == [lang for lang, _ in sample]
    assert np.allclose(outputs[5], model.scores([places[5]])[0])


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    found = predicted(docs).collect()
    assert len(found) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog " * 3 if i % 2 else "le chat et le chien " * 3, "en" if i % 2 else "fr", 1.0) for i in range(40)]
    rows += [(100, None, "en", 0.0), (101, "", None, 0.0), (102, "123 !?", "fr", 0.0), (None, "the dog and the cat", "en", 0.0), (7, rows[7][1], "en", 0.0), (103, "le chat " * 50_000, None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    found = {r.doc_id: r for r in predicted(docs).collect()}
    for i in (100, 101, 102):
        assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
    assert found[None].lang_pred == "en" and found[None].held_out is False and found[103].lang_pred == "fr" and found[7].lang_pred == "en"
    assert predicted(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in predicted(docs.drop("lang").selectExpr("*", "cast(null as string) lang")).collect()} == {"und"}


def test_more_languages_than_are_folded(spark):
    rng = np.random.default_rng(8)
    rows = []
    for lang in range(130):
        letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8)
        words = ["".join(rng.choice(letters, 5)) for _ in range(12)]
        rows += [(len(rows) + i, " ".join(rng.choice(words, 40)), f"l{lang:03d}") for i in range(8)]
    found = {r.doc_id: r.lang_pred for r in predicted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {*found.values()} == {r[2] for r in rows}
    assert np.mean([found[i] == lang for i, _, lang in rows]) > 0.97


def test_scores_through_landmarks_equal_folded_ones(monkeypatch):
    rng = np.random.default_rng(3)
    sample = [(lang, " ".join(rng.choice(words, 30))) for lang, words in {"a": ["alpha", "beta", "x"], "b": ["uno", "dos", "y"]}.items() for _ in range(20)]
    places, labels = [L.present(t.encode()) for _, t in sample], [lang for lang, _ in sample]
    folded = L.fit(places, labels).scores(places)
    monkeypatch.setattr(L, "MAX_FOLDED", 1)
    assert L.fit(places, labels).weights is None and np.allclose(L.fit(places, labels).scores(places), folded, atol=1e-4)
