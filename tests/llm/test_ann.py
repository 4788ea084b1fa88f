import numpy as np
import pytest
from pyspark.sql import functions as F

from lingmill.llm import ann


def brute_force(rows, k):
    out = {}
    for i, v in rows:
        d = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in rows if j != i)
        out[i] = d[:k]
    return out


def vectors(n, dims, seed, clusters=5):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((clusters, dims)) * 3
    return [(i, [float(x) for x in centres[i % clusters] + r.standard_normal(dims)]) for i in range(n)]


@pytest.mark.parametrize("cell_rows", [1 << 14, 60])
def test_recall(spark, cell_rows):
    rows = vectors(600, 24, 0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann.neighbours(df, cell_rows=cell_rows).collect()
    expected = brute_force(rows, 10)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["rank"]] = (r["distance"], r["neighbour"])
    assert set(by) == set(expected) and all(sorted(x) == list(range(1, 11)) for x in by.values())
    hits = [len({j for _, j in by[i].values()} & {j for _, j in expected[i]}) / 10 for i in expected]
    assert np.mean(hits) >= 0.95
    true = {(i, j): d for i in expected for d, j in expected[i]}
    assert all(d == pytest.approx(true[i, j], rel=1e-6) for i, x in by.items() for d, j in x.values() if (i, j) in true)


def test_stopping_saves_work():
    r = np.random.default_rng(1)
    x = np.concatenate([r.standard_normal((500, 16)) * 0.1 + c for c in r.standard_normal((20, 16)) * 5])
    p = x @ ann.directions(16)
    order, tree = ann.tree_of(np.arange(len(x)), x, p)
    row_of = np.argsort(order)
    quantile = ann.chi2_quantile(ann.CONFIDENCE, ann.M)
    verified, hits = 0, 0
    for q in range(0, 10_000, 200):
        who, d, n = ann.search(tree, x[q], p[q], int(row_of[q]), 10, np.inf, quantile)
        true = np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11]
        hits += len({*order[who]} & {*true})
        verified += n
    assert hits >= 0.95 * 500 and verified < 0.1 * 50 * len(x)


def test_neighbours_come_in_the_order_of_projected_distance():
    r = np.random.default_rng(4)
    x = r.standard_normal((3000, 12))
    p = x @ ann.directions(12)
    _, tree = ann.tree_of(np.arange(len(x)), x, p)
    # with a bound that nothing exceeds, exactly what lies within the tested radius is verified
    for q in range(20):
        for bound in (0.01, 0.3, 1.0):
            n = ann.search(tree, x[q], p[q], -1, 5000, bound, 5.0)[2]
            assert n == (((p - p[q]) ** 2).sum(axis=1) < 5.0 * bound).sum()


def test_queries_are_a_stated_set(spark):
    rows = vectors(500, 16, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = ann.neighbours(df, F.col("vec_id") % 50 == 0, cell_rows=40, sample=320).collect()
    expected = brute_force([(i, np.float32(v).astype(float)) for i, v in rows], 10)
    assert {r["vec_id"] for r in got} == set(range(0, 500, 50)) and len(got) == 100
    assert np.mean([r["neighbour"] in {j for _, j in expected[r["vec_id"]]} for r in got]) >= 0.9


def test_a_third_of_all_vectors_are_equal(spark):
    rows = vectors(400, 8, 6) + [(1000 + i, [0.5] * 8) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    by = {}
    for r in ann.neighbours(df, F.col("vec_id") >= 1000, k=3, cell_rows=30, sample=480).collect():
        by.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour"], r["distance"]))
    least = lambda i: [j for j in range(1000, 1004) if j != i][:3]
    assert {i: sorted(x) for i, x in by.items()} == {i: [(n + 1, j, 0.0) for n, j in enumerate(least(i))] for i in range(1000, 1200)}


def test_chi_square():
    assert ann.chi2_cdf(7.344, 8) == pytest.approx(0.5, abs=1e-3) and ann.chi2_quantile(0.95, 8) == pytest.approx(15.507, abs=1e-3)


def test_nulls_ties_repeated_and_clashing_columns(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, []), (7, [1.0]), (8, [float("nan"), 1.0]), (None, [0.0, 0.0]), (9, [1.0, None]), (3, [1.0, 0.0]), (4, [9.0, 9.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cell int")
    got = {}
    for r in ann.neighbours(df, k=2).collect():
        got.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour"], round(r["distance"], 6)))
    assert {i: sorted(x) for i, x in got.items()} == {1: [(1, 2, 0.0), (2, 3, 1.0)], 2: [(1, 1, 0.0), (2, 3, 1.0)], 3: [(1, 1, 1.0), (2, 2, 1.0)], 4: [(1, 1, 1.0), (2, 2, 1.0)]}


def test_fewer_than_k_and_empty(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [3.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, ann.neighbours(df).collect())) == [(1, 1, 2, 3.0), (2, 1, 1, 3.0)]
    assert ann.neighbours(df.limit(0)).collect() == []
    assert ann.neighbours(df.where("vec_id = 1")).collect() == []


def test_very_long_vectors(spark):
    rows = vectors(30, 3000, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.neighbours(df, k=3).collect()
    assert {(r["vec_id"], r["neighbour"]) for r in got} == {(i, j) for i, x in brute_force(rows, 3).items() for _, j in x}
