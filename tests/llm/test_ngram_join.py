import random
import re

import pytest

from lingmill.llm import ngram_join as J

WORDS = re.compile(r"\w+")


def sets(text, n):
    w = WORDS.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_force(rows, n=J.N, threshold=J.THRESHOLD):
    found = {}
    s = [(i, sets(t, n)) for i, t in rows if i is not None]
    for x in range(len(s)):
        for y in range(x + 1, len(s)):
            (a, p), (b, q) = s[x], s[y]
            if a != b and p and q:
                jaccard = len(p & q) / len(p | q)
                if jaccard >= threshold:
                    key = (min(a, b), max(a, b))
                    found[key] = max(found.get(key, 0), jaccard)
    return found


def corpus(seed=0, n=120):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.45:
            w = r.choice(texts).split()
            for _ in range(r.randrange(0, max(1, len(w) // 12) + 1)):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(word() for _ in range(r.choice([1, 2, 3, 4, 5, 8, 20, 60, 200, 400]))))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(150)) for _ in range(15)]
    return list(enumerate(texts))


@pytest.mark.parametrize("at_most", [None, 0, 3, 8])
def test_against_brute_force(spark, at_most):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute_force(rows)
    got = {(r["a"], r["b"]): r["jaccard"] for r in J.jaccard_pairs(docs, at_most=at_most).collect()}
    assert len(expected) >= 50
    assert got == pytest.approx(expected)


@pytest.mark.parametrize("threshold,subset", [(0.3, 1), (0.7, 2), (0.6, 3), (1.0, 2)])
def test_other_parameters(spark, threshold, subset):
    rows = corpus(1, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["a"], r["b"]): r["jaccard"] for r in J.jaccard_pairs(docs, threshold=threshold, subset=subset).collect()}
    assert got == pytest.approx(brute_force(rows, threshold=threshold))


def classes(rows):
    """doc_id -> (class, links), by brute force; for ids with one text each."""
    ids = sorted({i for i, _ in rows if i is not None})
    pairs, links, label = brute_force(rows), dict.fromkeys(ids, 0), {i: i for i in ids}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in ids:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (label[i], links[i]) for i in ids}


@pytest.mark.parametrize("at_most", [None, 0, 5])
def test_classes_and_links(spark, at_most):
    rows = corpus(2) + [(500, None), (501, ""), (502, "?!")]
    rows += [(1000 + i, rows[0][1]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in J.linked(docs, at_most=at_most).collect()}
    assert got == classes(rows)


def at_the_threshold(sizes, seed=3):
    """Pairs of long texts with a Jaccard of exactly one half: 2k of 4k 3-grams are shared, in runs of random places."""
    r, rows = random.Random(seed), []
    for number, k in enumerate(sizes):
        word = lambda kind: f"{kind}{number}x{r.randrange(1 << 40)}"
        common = [word("c") for _ in range(2 * k + 2)]  # 2k 3-grams
        own = lambda kind: [word(kind) for _ in range(k)]  # noqa: E731, B023
        rows += [(2 * number, " ".join(common + own("a"))), (2 * number + 1, " ".join(own("b") + common))]
    return rows


def test_exact_at_the_threshold_itself(spark):
    rows = at_the_threshold([13, 25, 60, 100, 150, 250, 400, 700, 1000] * 8)
    expected = brute_force(rows)
    assert len(expected) == 72 and set(expected.values()) == {0.5}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["a"], r["b"]): r["jaccard"] for r in J.jaccard_pairs(docs).collect()} == expected


def test_blocks_of_a_large_tile(spark, monkeypatch):
    r = random.Random(8)
    base = [f"w{r.randrange(400)}" for _ in range(80)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(12)):
            w[r.randrange(80)] = f"n{r.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(J.tiles, "__defaults__", (4096,))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(x["a"], x["b"]): x["jaccard"] for x in J.jaccard_pairs(docs).collect()} == pytest.approx(brute_force(rows))
    assert {x["doc_id"]: (x["class_id"], x["links"]) for x in J.linked(docs).collect()} == classes(rows)


def test_fingerprints_come_back():
    r = random.Random(1)
    for grams in (1000, 1 << 26, 1 << 40):
        ranges = J.Ranges(grams)
        prints = J.np.sort(ranges.of(J.np.array([r.randrange(1 << 64) for _ in range(2000)], J.np.uint64)))
        back = []
        for shard, lo, hi in ranges.parts(prints):
            assert 0 <= shard < ranges.shards
            places, counts = J._of_blob(J._blob(ranges.places(prints[lo:hi], shard), J.np.ones(hi - lo)))
            assert (counts == 1).all()
            back.append(places.astype(J.np.uint64) + J.np.uint64(shard * ranges.span))
        assert (J.np.concatenate(back) == prints).all()


def test_nulls_short_repeated_and_clashing_columns(spark):
    rows = [(1, None), (2, ""), (3, "?!"), (None, "a b c d"), (4, "a b c d"), (5, "A, b: c d."), (6, "a b"), (7, "b a"), (8, "a b"), (9, "x"), (9, "a b"), (10, "a b c d"), (10, "a b c d")]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, sid string, gone int")
    got = {(r["a"], r["b"]): r["jaccard"] for r in J.jaccard_pairs(docs).collect()}
    assert got == pytest.approx(brute_force(rows))
    assert set(got) == {(4, 5), (4, 10), (5, 10), (6, 8), (6, 9), (8, 9)}
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in J.linked(docs).collect()}
    assert got == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 2), 5: (4, 2), 10: (4, 2), 6: (6, 2), 8: (6, 2), 9: (6, 2), 7: (7, 0)}
    kept = J.one_of_each_group(docs)
    assert kept.schema == docs.schema
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7]


def test_repeated_rows_of_a_kept_document(spark):
    docs = spark.createDataFrame([(1, "a b c", None), (1, "a b c", 2), (1, "a b c", 2), (2, "q r s", 1)], "doc_id long, text string, extra long")
    assert sorted(r["doc_id"] for r in J.one_of_each_group(docs).collect()) == [1, 2]


def test_groups_are_connected_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 30), (5, 6), (6, 30)]
    got = {r["v"]: r["label"] for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{v: 1 for v in (1, 2, 3, 4, 5, 6, 20, 30)}, 7: 7, 8: 7, 9: 7}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_pairs(docs).collect() == [] and J.linked(docs).collect() == [] and J.one_of_each_group(docs).collect() == []


def test_long_text(spark):
    r = random.Random(5)
    w = [f"w{r.randrange(5000)}" for _ in range(60_000)]
    v = list(w)
    for _ in range(2000):
        v[r.randrange(len(v))] = "changed"
    rows = [(1, " ".join(w)), (2, " ".join(v)), (3, " ".join(w[:50]))]
    got = {(x["a"], x["b"]): x["jaccard"] for x in J.jaccard_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == pytest.approx(brute_force(rows)) and (1, 2) in got


def test_boundary_of_least_cost():
    assert J.least_cost({2: (100, 100_000), 14: (10, 150)}, 2, 1) == 2
    assert J.least_cost({14: (10, 150)}, 2, 1) == 0
    assert J.least_cost({14: (10, 10_000)}, 2, 1) == 14
    assert J.least_cost({14: (10, 10_000)}, 2, 1000) == 0
