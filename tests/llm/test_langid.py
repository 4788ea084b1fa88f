import numpy as np
import pyarrow as pa
import pytest

from lingmill.llm import langid

SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and then the other things that were there with them ",
    "de": "der schnelle braune fuchs springt über den faulen hund und dann die anderen dinge nicht auch ",
    "fr": "le renard brun saute par dessus le chien paresseux et puis les autres choses qui étaient là ",
}


@pytest.fixture(scope="module")
def labelled(spark):
    r = np.random.default_rng(0)
    rows = []
    for i in range(300):
        lang = list(SAMPLES)[i % 3]
        words = SAMPLES[lang].split()
        rows.append((i, " ".join(r.choice(words, 20)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def brute_force(model, text):
    """Log likelihoods by a loop over the n-grams of one text."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = (" " + " ".join(letters.split()) + " ") if letters.strip() else ""
    total, count = np.zeros(len(model.labels)), 0
    for n in langid.ORDERS:
        for i in range(len(padded) - n + 1):
            key = 0
            for c in padded[i : i + n][::-1]:
                key = (key << 21) | ord(c)
            bucket = int(langid.mix(np.array([key + n], np.uint64))[0] >> np.uint64(48)) % langid.BUCKETS
            total += model.logp[bucket].astype(float)
            count += 1
    return total, count


def test_scores_against_brute_force(labelled):
    model = langid.fit(labelled, train_docs=50)
    table = np.vstack([model.logp, np.zeros((1, len(model.labels)), np.float32)])
    texts = ["The dog", "", "über, den Hund!", "x", "1 2 3", "l'été  là\n\nqui", "a" * 5000 + " b", "ÀÉ_é7z"]
    sums, counts = langid.score(pa.array(texts, pa.large_string()), model, table)
    for text, s, c in zip(texts, sums, counts):
        expected, count = brute_force(model, text.replace("_", " "))
        assert c == count
        assert s == pytest.approx(expected, rel=1e-5)


def test_held_out_accuracy(labelled):
    model = langid.fit(labelled, train_docs=50)
    got = {r["doc_id"]: r for r in langid.identify(labelled, model).collect()}
    right = [got[r["doc_id"]]["label"] == r["lang"] for r in labelled.collect()]
    assert np.mean(right) > 0.98
    assert all(r["accepted"] for r in got.values())


def test_sample_data_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1")
    rows = langid.identify(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["label"] == r["lang"] for r in rows]) > 0.97
    assert np.mean([r["accepted"] for r in rows]) > 0.99


def test_nulls_empty_long_repeated_and_clashing_columns(spark, labelled):
    model = langid.fit(labelled)
    rows = [(1, None, "en", "x"), (2, "", None, "x"), (3, "123 !!!", "en", None), (None, SAMPLES["de"], None, "y"), (5, SAMPLES["fr"] * 3000, "en", "y"), (6, SAMPLES["en"], None, None), (6, SAMPLES["en"], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, label string")
    got = sorted(langid.identify(docs, model).collect(), key=lambda r: r["doc_id"] or 0)
    assert [(r["doc_id"], r["label"], r["accepted"]) for r in got] == [
        (None, "de", True), (1, "und", False), (2, "und", False), (3, "und", False), (5, "fr", True), (6, "en", True), (6, "en", True)
    ]
    kept = langid.keep_identified(docs, model)
    assert kept.schema == docs.schema
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 5, 6, 6]


def test_gibberish_is_rejected(spark, labelled):
    docs = spark.createDataFrame([(1, "zxqj qqzx vvkq xjzq " * 30)], "doc_id long, text string")
    assert not langid.identify(docs, langid.fit(labelled)).first()["accepted"]


def test_empty_and_unlabelled(spark, labelled):
    empty = labelled.limit(0)
    assert langid.identify(empty, langid.fit(labelled)).collect() == []
    model = langid.fit(empty)
    assert {(r["label"], r["accepted"]) for r in langid.identify(labelled, model).collect()} == {("und", False)}
