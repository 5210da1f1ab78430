"""Language mixtures: held-out accuracy, known proportions, a brute-force maximum of the likelihood, edge cases."""

import random
import zlib

import numpy as np
import pytest

from ragscope.llm.languages import Languages, _counts, _proportions, fit_languages, held_out, language_mixtures

SCHEMA = "doc_id long, text string, lang string, score string, row int, languages string"
SOUNDS = {"aa": ("b d g l r".split(), "a e".split()), "bb": ("p t k s z".split(), "i o u".split()), "cc": ("m n v w x".split(), "y é ä".split())}


def words(rng, lang, n):
    onset, vowel = SOUNDS[lang]
    return " ".join("".join(rng.choice(onset) + rng.choice(vowel) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, lang, rng.randrange(8, 60)), lang) for i in range(300) for lang in [rng.choice(sorted(SOUNDS))]]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !!", "cc"), (1003, "Ω", None), (None, words(rng, "bb", 20), "bb"),
             (1004, words(rng, "aa", 60_000) + words(rng, "cc", 200_000), None), (1005, words(rng, "aa", 300) + " " + words(rng, "bb", 100), None)]
    return spark.createDataFrame([(i, t, g, "x", 1, "y") for i, t, g in rows + rows[:4]], SCHEMA).repartition(4)


def test_held_out_accuracy_and_proportions(docs):
    rows = docs.withColumn("held_out", held_out())
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 1) for r in rows.collect())
    out = language_mixtures(rows, fit_languages(rows.where("NOT held_out"))).collect()
    assert len(out) == 311
    assert all(0 <= r["score"] <= 1 and r["row"] == 1 for r in out)
    right = [r["lang"] == r["lang_pred"] for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert len(right) > 60 and np.mean(right) > 0.99
    by = {r["doc_id"]: r for r in out}
    for i in (1000, 1001, 1002):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["languages"]) == ("und", 0.0, [])
    assert by[1003]["lang_pred"] in SOUNDS
    # Letters, not words, are drawn: the expected proportions follow the letters of each part.
    long, mixed = by[1004], by[1005]
    assert long["languages"] == ["cc", "aa"] and abs(long["proportions"][1] - 60 / 260) < 0.02
    assert mixed["languages"] == ["aa", "bb"] and abs(mixed["score"] - 0.75) < 0.05
    single = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 1000]
    assert np.mean([len(r["languages"]) == 1 for r in single]) > 0.98


def test_long_text_counts_as_in_pieces(monkeypatch):
    text = words(random.Random(1), "aa", 900)
    whole = dict(zip(*_counts(text)))
    monkeypatch.setattr("ragscope.llm.languages.PIECE", 97)
    assert dict(zip(*_counts(text))) == whole


def test_proportions_maximise_the_likelihood():
    rng = np.random.default_rng(2)
    ratio, count = rng.random((30, 2)) + 0.05, rng.integers(1, 9, 30)
    share, best = _proportions(ratio, count, np.array([0.5, 0.5]))
    grid = np.linspace(0, 1, 2001)
    values = [count @ np.log(ratio @ np.array([g, 1 - g])) for g in grid]
    assert abs(grid[int(np.argmax(values))] - share[0]) < 0.03 and best > max(values) - 0.01


def test_single_language_and_no_language(spark, docs):
    one = fit_languages(docs.where("lang = 'aa'"))
    assert {r["lang_pred"] for r in language_mixtures(docs, one).collect()} == {"aa", "und"}
    none = fit_languages(docs.where("lang IS NULL"))
    assert isinstance(none, Languages) and none.names == []
    assert {r["lang_pred"] for r in language_mixtures(docs, none).collect()} == {"und"}
    empty = spark.createDataFrame([], SCHEMA)
    assert language_mixtures(empty, fit_languages(empty)).collect() == []
