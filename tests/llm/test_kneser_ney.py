import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lingmill.llm import kneser_ney as K

WORDS = re.compile(r"\w+")


def brute_force(texts):
    """[(words, log probability)] by dictionaries of strings."""
    docs = [["<s>", "<s>", *w, "</s>"] if (w := WORDS.findall((t or "").lower())) else [] for t in texts]
    tri = Counter(tuple(d[i - 2 : i + 1]) for d in docs for i in range(2, len(d)))
    bi, uni = Counter(), Counter()
    for _, v, w in tri:
        bi[v, w] += 1
    for _, w in bi:
        uni[w] += 1

    def discounts(c):
        n = [sum(x == i for x in c.values()) for i in (1, 2, 3, 4)]
        if not all(n):
            return [0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        d = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
        return d if all(0 <= x <= i for i, x in enumerate(d, 1)) else [0.5, 1.0, 1.5]

    def order(counts):
        d = discounts(counts)
        total, gamma = defaultdict(int), defaultdict(float)
        for gram, c in counts.items():
            context = gram[:-1] if isinstance(gram, tuple) else ()
            total[context] += c
            gamma[context] += d[min(c, 3) - 1]
        return lambda gram, context, lower: (max(counts.get(gram, 0) - (d[min(counts[gram], 3) - 1] if gram in counts else 0), 0) + gamma[context] * lower) / total[context] if context in total else lower

    o1, o2, o3 = order(uni), order(bi), order(tri)
    types = len(uni) + 1
    out = []
    for d in docs:
        logs = [math.log(o3((u, v, w), (u, v), o2((v, w), (v,), o1(w, (), 1 / types)))) for u, v, w in zip(d, d[1:], d[2:])]
        out.append((max(len(d) - 3, 0), sum(logs) if d else None))
    return out


def texts(n, seed=0, vocabulary=40):
    r = np.random.default_rng(seed)
    p = 1 / np.arange(1, vocabulary + 1)
    return [" ".join(f"w{i}" for i in r.choice(vocabulary, r.integers(1, 60), p=p / p.sum())) for _ in range(n)]


@pytest.mark.parametrize("shard_words,flush_words", [(1 << 20, 1 << 20), (400, 900)])
def test_against_brute_force(spark, monkeypatch, shard_words, flush_words):
    rows = [*texts(200), "Die Äpfel, die ÄPFEL!", "w1", "w1 w2 w1 w2 w1 w2", "w1"]
    monkeypatch.setattr(K, "UNIGRAM_WORDS", 400)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    model = K.fit(docs, shard_words=shard_words, flush_words=flush_words)
    if shard_words < 1000:
        assert len(model.shards) > 5 and len(model.hot) > 0 and len(model.unigrams) > 1
    got = {r["doc_id"]: r for r in K.perplexity(docs, model).collect()}
    for i, (n, log) in enumerate(brute_force(rows)):
        assert got[i]["words"] == n
        assert got[i]["log_probability"] == pytest.approx(log, rel=1e-9)
        assert got[i]["perplexity"] == pytest.approx(math.exp(-log / (n + 1)), rel=1e-9)


def test_probabilities_sum_to_one(spark):
    rows = texts(50, 1, 12)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    model = K.fit(docs)
    import pyarrow as pa

    names = [f"w{i}" for i in range(12)]
    _, stream, _ = next(K.documents(pa.array(names, pa.large_string())))
    hashes = np.array([*stream[2::4], K.EOS, np.uint64(0x123456789ABCDEF1)], np.uint64)  # all words, the end, one unknown word
    scorer = K.Scorer(model)
    known = [h for h in hashes]
    for u, v in [(K.BOS, K.BOS), (hashes[0], hashes[1]), (hashes[3], hashes[0]), (np.uint64(0xF00D56789ABCDEF1), np.uint64(0xBEEF56789ABCDEF1))]:
        p = np.exp(scorer.log_probabilities(np.stack([np.full(len(known), u), np.full(len(known), v), hashes], axis=1).ravel(), 3 * np.arange(len(known)) + 2))
        assert p.sum() == pytest.approx(1, abs=1e-9)


def test_nulls_empty_long_repeated_and_clashing_columns(spark):
    long = " ".join(texts(1500, 2, 200))
    rows = [(1, None, "a"), (2, "", "b"), (None, "w1 w2", None), (3, "... !", None), (4, "w1 w2", "c"), (4, "w1 w2", "c"), (5, long, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string").withColumnRenamed("words", "perplexity")
    got = K.perplexity(docs, K.fit(docs, flush_words=1000)).collect()
    expected = brute_force([r[1] for r in rows])
    assert len(got) == len(rows)
    by = sorted([(r["doc_id"] or 0, r["words"], r["log_probability"] or 0) for r in got])
    for a, b in zip(by, sorted((r[0] or 0, n, log or 0) for r, (n, log) in zip(rows, expected))):
        assert a == pytest.approx(b, rel=1e-9)
    assert {r["doc_id"] for r in got if r["perplexity"] is None} == {1, 2, 3}


def test_more_words_than_a_key_holds(spark, monkeypatch):
    rows = texts(40, 3, 300)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").coalesce(1)
    plain = sorted(map(tuple, K.perplexity(docs, K.fit(docs)).collect()))
    from pyarrow import array, large_string

    _, stream, begin = next(K.documents(array(rows, large_string())))
    layout, place = K.Layout(3, np.zeros(0, np.uint64), np.zeros(0, np.uint64)), K.targets(begin)

    def total():
        c = Counter()
        for _, _, blob in K.counted(layout, stream, place):
            vocabulary, (v, u, w, n) = K.unpacked(blob)
            for key in zip(vocabulary[u], vocabulary[v], vocabulary[w], n):
                c[key[:3]] += int(key[3])
        return c

    whole = total()
    monkeypatch.setattr(K, "_BITS", 6)
    monkeypatch.setattr(K, "_MASK", np.uint64(63))
    assert total() == whole and len(plain) == 40


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    model = K.fit(docs)
    assert model is None and K.perplexity(docs, model).collect() == []
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in K.perplexity(docs, K.fit(docs)).collect()] == [(1, 0, None, None)]
