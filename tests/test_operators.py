"""Hand-worked cases: known numbers, invariants and edges."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingmill.functions import special as S
from lingmill.operators import association as A
from lingmill.operators import extract as E
from lingmill.operators import features as G
from lingmill.operators import lexicon as L
from lingmill.operators import messages as M
from lingmill.operators import outcomes as O
from lingmill.operators import predict as P
from lingmill.operators import reduce as D
from lingmill.operators import refine as R
from lingmill.queries import QUERIES
from lingmill.sources import tables as T

FT = "group_id string, feat string, value long, group_norm double"


def by(df, *keys, value):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r[value] for r in df.collect()}


def table(spark, rows):
    return spark.createDataFrame([(g, f, v, float(n)) for g, f, v, n in rows], FT)


def test_messages_count_once_in_a_group_and_null_groups_go(spark):
    m = spark.createDataFrame([("a", 1, "x y"), ("a", 1, "x y"), ("b", 1, "x"), ("a", 2, None), ("a", 3, ""), (None, 4, "x")], "user_id string, message_id long, message string")
    ft = E.add_ngrams(m)
    assert by(ft, "group_id", "feat", value="value") == {("a", "x"): 1, ("a", "y"): 1, ("b", "x"): 1}
    assert all(abs(v - 1) < 1e-12 for v in by(ft.groupBy("group_id").agg(F.sum("group_norm").alias("s")), "group_id", value="s").values())


def test_short_messages_have_no_ngrams_but_count(spark):
    m = spark.createDataFrame([("a", 1, "one"), ("a", 2, "one two three")], "user_id string, message_id long, message string")
    assert by(E.add_ngrams(m, 2), "feat", value="value") == {"one two": 1, "two three": 1}
    assert by(E.meta_features(m, 2), "feat", value="value")["_totalMsgs"] == 2


def test_sentence_ids_go_past_99(spark):
    m = spark.createDataFrame([(7, "A b. " * 120)], "message_id long, message string")
    ids = {r["message_id"] for r in M.sentence_tokenized(m, per_row=True).collect()}
    assert len(ids) == 120 and {"7_00", "7_99", "7_119"} <= ids


def test_occurrence_filter_rounds_half_to_even(spark):
    # 9 groups, p = .5: 4.5 is 4
    ft = table(spark, [(str(g), "four", 1, 1) for g in range(4)] + [(str(g), "all", 1, 1) for g in range(9)] + [("0", "one", 1, 1)])
    assert set(by(R.occurrence_filter(ft, 0.5), "feat", value="value")) == {"four", "all"}


def test_unknown_words_are_left_out_of_pmi(spark):
    ft = table(spark, [("g", "known gone", 2, 1)])
    words = table(spark, [("g", "known", 4, 0.5), ("g", "x", 4, 0.5)])
    assert by(R.collocation_pmi(ft, words), "feat", value="pmi")["known gone"] == pytest.approx(np.log2((2 / 8) / (4 / 8)))


def test_lexicon_wildcards_intercepts_and_linearity(spark):
    words = table(spark, [("g", "running", 2, 0.5), ("g", "runs", 2, 0.5), ("h", "other", 1, 1)])
    lex = spark.createDataFrame([("runn*", "MOVE", 2.0), ("run*", "MOVE", 3.0), ("running", "MOVE", 1.0), ("runs", "FAST", 4.0)], "term string, category string, weight double")
    got = by(L.lexicon_features(words, lex), "group_id", "feat", value="group_norm")
    assert got == {("g", "MOVE"): 3.0, ("g", "FAST"): 2.0, ("g", "_intercept"): 1.0, ("h", "_intercept"): 1.0}
    with_constant = lex.unionByName(spark.createDataFrame([("_intercept", "FAST", 10.0)], lex.schema))
    got = by(L.lexicon_features(words, with_constant), "group_id", "feat", value="group_norm")
    assert got == {("g", "MOVE"): 3.0, ("g", "FAST"): 12.0, ("h", "FAST"): 10.0}


def test_lexicon_sets(spark):
    a = spark.createDataFrame([("x", "A"), ("y", "A"), ("y", "B")], "term string, category string")
    b = spark.createDataFrame([("y", "A"), ("z", "C")], "term string, category string")
    assert L.union(a, b).count() == 4 and by(L.intersect(a, b), "term", value="category") == {"y": "A"}
    dealt = L.randomised(a)
    assert dealt.groupBy("category").count().count() == 2
    assert by(L.compared(a, b), "category_a", "category_b", value="jaccard") == {("A", "A"): 0.5, ("B", "A"): 1.0}


def test_known_p_value_and_interval(spark):
    r, n = 0.013089769277, 1000
    out = A._with_p(A.with_interval(spark.createDataFrame([(r, n)], "r double, n long"))).first()
    assert out["p"] == pytest.approx(0.679288, abs=1e-6)
    assert (out["ci_l"], out["ci_u"]) == (pytest.approx(-0.048943, abs=1e-6), pytest.approx(0.075022, abs=1e-6))


def test_tails():
    assert S.t_two_tailed(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert S.f_upper(4.0, 2, 10) == pytest.approx(1.8**-5)
    assert S.normal_two_tailed(1.959963985) == pytest.approx(0.05, abs=1e-8)


def effects(spark, seed=0, groups=40, negative=False):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((groups, 3)) < 0.5, 0, rng.integers(1, 5, (groups, 3))) / 4
    if negative:
        x = np.where(x > 0.5, -x, x)
    y = (rng.random(groups) < 0.5).astype(float)
    c = rng.normal(size=(groups, 2))
    ft = table(spark, [(str(g), f"f{j}", 1, x[g, j]) for g in range(groups) for j in range(3) if x[g, j]])
    analysis = spark.createDataFrame([("o", str(g), float(y[g])) for g in range(groups)], "outcome string, group_id string, y double")
    controls = spark.createDataFrame([(str(g), float(c[g, 0]), float(c[g, 1])) for g in range(groups)], "group_id string, c0 double, c1 double")
    return x, y, c, ft, analysis, controls


def ranks(v):
    order = np.argsort(v)
    out = np.empty(len(v))
    for u in np.unique(v):
        where = np.flatnonzero(v == u)
        out[where] = np.mean([i + 1 for i, k in enumerate(order) if v[k] == u])
    return out


@pytest.mark.parametrize("negative", [False, True])
def test_zeros_count_without_being_written(spark, negative):
    x, y, _, ft, analysis, _ = effects(spark, negative=negative)
    r = by(A.pearson(ft, analysis), "feat", value="r")
    rho = by(A.spearman(ft, analysis), "feat", value="r")
    auc = by(A.auc(ft, analysis), "feat", value="auc")
    d = by(A.cohens_d(ft, analysis), "feat", value="d")
    for j in range(3):
        v, k = x[:, j], f"f{j}"
        assert r[k] == pytest.approx(np.corrcoef(v, y)[0, 1])
        assert rho[k] == pytest.approx(np.corrcoef(ranks(v), ranks(y))[0, 1])
        a = np.mean([(p > q) + 0.5 * (p == q) for p in v[y == 1] for q in v[y == 0]])
        assert auc[k] == pytest.approx(a if a >= 0.5 else a - 1)
        assert d[k] == pytest.approx((v[y == 1].mean() - v[y == 0].mean()) / np.sqrt((v[y == 1].var(ddof=1) + v[y == 0].var(ddof=1)) / 2))


def test_regression_with_an_interaction_equals_least_squares(spark):
    x, y, c, ft, analysis, controls = effects(spark)
    z = lambda v: (v - v.mean(0)) / v.std(0)
    got = {(r["feat"], r["term"]): r["r"] for r in A.regression(ft, analysis, controls, ["c0", "c1"], ["c1"]).collect()}
    for j in range(3):
        m = np.column_stack([z(c[:, 0]), z(c[:, 1]), z(c[:, 1]) * z(x[:, j]), z(x[:, j])])
        b = np.linalg.lstsq(m, z(y), rcond=None)[0]
        assert got[f"f{j}", "group_norm"] == pytest.approx(b[3])
        assert got[f"f{j}", "group_norm * c1 from o"] == pytest.approx(b[2])
        assert got[f"f{j}", "c1 with o"] == pytest.approx(b[1])


def test_logistic_has_a_zero_gradient(spark):
    x, y, _, ft, analysis, _ = effects(spark)
    for r in A.logistic(ft, analysis).collect():
        v = x[:, int(r["feat"][1])]
        z = (v - v.mean()) / v.std()
        assert ((y - 1 / (1 + np.exp(-r["beta"] * z))) * z).sum() == pytest.approx(0, abs=1e-6)


def test_constant_features_have_no_effect(spark):
    ft = table(spark, [(str(g), "same", 1, 0.3) for g in range(10)])
    analysis = spark.createDataFrame([("o", str(g), float(g % 2)) for g in range(10)], "outcome string, group_id string, y double")
    assert A.pearson(ft, analysis).first()["r"] is None
    assert A.cohens_d(ft, analysis).first()["d"] is None
    assert A.auc(ft, analysis).first()["auc"] == 0.5
    assert R.with_feature_norms(ft).first()["feat_norm"] is None


@pytest.mark.parametrize("method,want", [("bh", [0.04] * 4), ("bonferroni", [0.04, 0.08, 0.12, 0.16]), ("holm", [0.04, 0.06, 0.06, 0.06]), ("hochberg", [0.04] * 4), ("hommel", [0.04] * 4)])
def test_corrections(spark, method, want):
    rows = spark.createDataFrame([("o", f"f{i}", p) for i, p in enumerate([0.01, 0.02, 0.03, 0.04])], "outcome string, feat string, p double")
    got = by(A.corrected(rows, method), "feat", value="p_corrected")
    assert [got[f"f{i}"] for i in range(4)] == pytest.approx(want)


def test_standard_scores_have_mean_0_and_spread_1(spark):
    x, _, _, ft, _, _ = effects(spark)
    s = R.standardised(ft).groupBy("feat").agg(F.avg("group_norm").alias("m"), F.stddev_pop("group_norm").alias("s")).collect()
    assert len(s) == 3 and all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in s)


def test_bins_close_at_their_share(spark):
    sizes = spark.createDataFrame([(i, 10) for i in range(1, 7)], "group_id long, n long")
    ft = spark.createDataFrame([(i, "f", 1, 0.1 * i, 0.0) for i in range(1, 7)], "group_id long, feat string, value long, group_norm double, std_dev double")
    got = R.binned(ft, sizes, 1).collect()  # 60 / 3: two groups a bin
    assert sorted(r["group_id"] for r in got) == ["1_2", "3_4", "5_6"]
    assert sorted(round(r["group_norm"], 6) for r in got) == [0.15, 0.35, 0.55]


def test_folds_deal_the_sorted_outcomes(spark):
    a = spark.createDataFrame([("o", str(g), float(g)) for g in range(10)], "outcome string, group_id string, y double")
    sizes = by(O.folds(a, 3).groupBy("fold").count(), "fold", value="count")
    assert sizes == {0: 4, 1: 3, 2: 3}


def test_dummies_and_multiclass(spark):
    t = spark.createDataFrame([(1, "B"), (2, "a"), (3, None), (4, "b")], "id long, c string")
    assert by(O.dummies(t, "id", "c"), "outcome", "group_id", value="y") == {("c__a", 1): 0.0, ("c__a", 2): 1.0, ("c__a", 4): 0.0}
    assert by(O.multiclass(t, "id", "c"), "group_id", value="y") == {1: 1.0, 2: 0.0, 4: 1.0}


def test_ridge_by_moments_equals_direct_ridge(spark):
    x, y, c, ft, analysis, controls = effects(spark)
    rows = P.aligned(ft, O.folds(analysis, 2), ["f0", "f1", "f2"], controls, ["c0", "c1"])
    m = P.fold_moments(rows)["o"]
    got = P.ridge_of(P._plus(list(m.values())), [0, 1, 2, 3, 4], 2.0)
    f = np.column_stack([x, c])
    z = (f - f.mean(0)) / f.std(0)
    w = np.linalg.solve(z.T @ z + 2.0 * np.eye(5), z.T @ (y - y.mean())) / f.std(0)
    assert got.weights == pytest.approx(w) and got.intercept == pytest.approx(y.mean() - w @ f.mean(0))


def test_principal_components_explain_the_variance(spark):
    x, _, _, ft, _, _ = effects(spark)
    r = D.pca(ft, ["f0", "f1", "f2"], groups=spark.createDataFrame([(str(g),) for g in range(40)], "group_id string"))
    assert r.explained.sum() == pytest.approx(x.var(0).sum())
    assert r.components @ r.components.T == pytest.approx(np.eye(3), abs=1e-9)
    assert D.varimax(r.components[:2]) @ D.varimax(r.components[:2]).T == pytest.approx(np.eye(2), abs=1e-8)


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "a.dic").write_text("%\n1\tPOS\n2\tNEG\n%\ngood\t1\nbad\t2\t(3)\n")
    assert by(T.lexicon_dic(spark, str(tmp_path / "a.dic")), "term", value="category") == {"good": "POS", "bad": "NEG"}
    (tmp_path / "b.csv").write_text("good,fine,POS,0.5\nbad,NEG,2\n")
    assert by(T.lexicon_lines(spark, str(tmp_path / "b.csv"), weighted=True), "term", value="weight") == {"good": 0.5, "fine": 0.5, "bad": 2.0}
    (tmp_path / "c.csv").write_text("topic_id,word1,score1\n1,big_dog,4,cat,3,ant,1\n")
    assert by(T.topic_csv(spark, str(tmp_path / "c.csv"), 0.5), "term", value="weight") == {"big dog": 4.0, "cat": 3.0}
    (tmp_path / "d.csv").write_text("POS,NEG\ngood,bad\nfine,\n")
    assert by(T.lexicon_columns(spark, str(tmp_path / "d.csv")), "term", value="category") == {"good": "POS", "fine": "POS", "bad": "NEG"}
    (tmp_path / "e.csv").write_text("good,POS,1\nbad,NEG,0\n")
    assert by(T.lexicon_kept(spark, str(tmp_path / "e.csv")), "term", value="category") == {"good": "POS"}
    (tmp_path / "f.csv").write_text("t1,food\nt2,food\n")
    assert by(T.lexicon_map(spark, str(tmp_path / "f.csv")), "term", value="category") == {"t1": "food", "t2": "food_2"}


def test_empty_tables_stay_empty(spark):
    ft = table(spark, [])
    analysis = spark.createDataFrame([], "outcome string, group_id string, y double")
    for df in (G.dense(ft), R.occurrence_filter(ft, 0.5), R.tf_idf(ft), R.standardised(ft), A.pearson(ft, analysis), A.spearman(ft, analysis), A.auc(ft, analysis), A.log_odds(ft, analysis)):
        assert df.count() == 0


def test_every_document_shapes_the_topics(spark):
    docs = spark.createDataFrame([(i, [f"w{i}"] * 20 + ["all"]) for i in range(60)], "id long, words array<string>")
    _, terms = D.lda_topics(docs, "id", "words", k=2)
    weights = terms.where("term <> 'all'").groupBy("term").agg(F.sum("weight").alias("w")).toPandas()["w"]
    assert len(weights) == 60 and weights.max() < 5 * weights.min()


def test_topics_query_has_the_iterations_of_the_operator(spark, monkeypatch):
    asked, signature = [], inspect.signature(D.lda_topics)
    monkeypatch.setattr(D, "lda_topics", lambda *a, **kw: (asked.append(signature.bind(*a, **kw)), (None, None))[1])
    QUERIES["l1_lda_topics"](spark, "/root/testdata/sf0.001")
    assert asked[0].arguments.get("iterations", 50) == signature.parameters["iterations"].default


def test_topics_keep_more_terms_than_any_constant(spark):
    n = (1 << 18) + 1000
    docs = spark.range(8, numPartitions=4).select("id", F.expr(f"transform(sequence(id div 2, {n} - 1, 4), i -> 'w' || i)").alias("words"))
    _, terms = D.lda_topics(docs, "id", "words", k=2, iterations=1, min_df=2)
    assert terms.select("term").distinct().count() == n


def test_mediation_query_covers_all_features_with_all_samples(spark, monkeypatch):
    asked, run, signature = [], A.mediation_bootstrap, inspect.signature(A.mediation_bootstrap)
    monkeypatch.setattr(A, "mediation_bootstrap", lambda *a, **kw: (asked.append(signature.bind(*a, **kw)), run(*a, **kw))[1])
    got = QUERIES["a24_mediation_bootstrap"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len({(r["outcome"], r["feat"]) for r in got}) == 10
    assert asked[0].arguments.get("samples", 1000) == signature.parameters["samples"].default


def test_csv_gives_back_every_text(spark, tmp_path):
    texts = ["plain", " lead", "trail ", "\ttab\t", "a\rb", "a\r\nb", "\n", "", None, '"', 'say "x"', "\\", "a,b", "  ", "end\r", "end\n", "\x00", "null"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    T.write_csv(df, str(tmp_path / "t"))
    assert by(T.read_csv(spark, str(tmp_path / "t"), "k int, text string"), "k", value="text") == dict(enumerate(texts))
    (tmp_path / "u.csv").write_text('k,text\n1,\n2,""\n')
    assert by(T.read_csv(spark, str(tmp_path / "u.csv"), "k int, text string"), "k", value="text") == {1: None, 2: ""}


def test_names_of_tokens_that_are_cut_or_have_spaces(spark):
    from lingmill.operators import extract as E

    m = spark.createDataFrame([("g", 1, "anna b smith"), ("g", 2, "anna " + "x" * 80 + " smith"), ("g", 3, "anna smith anna")], "user_id string, message_id long, message string")
    terms = lambda *t: spark.createDataFrame([(x,) for x in t], "term string")
    ft = E.add_names(m, terms("Anna"), terms("Smith", "x" * 65), terms("the"))
    assert by(ft, "feat", value="value") == {"anna b smith": 1, "anna smith": 1, "anna " + "x" * 65: 1, "anna " + "x" * 80 + " smith": 1}  # two words keep 70 characters, three 102
    plan = ft._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_pmi_cuts_each_feature_once(spark):
    ft = table(spark, [("g", "a b", 2, 0.5), ("h", "a b", 1, 0.5), ("g", "c", 1, 0.5)])
    words = table(spark, [("g", "a", 3, 0.5), ("g", "b", 3, 0.5), ("g", "c", 100, 0.5)])
    out = R.pmi_filter(ft, words, 3.0)
    assert sorted(by(out, "group_id", "feat", value="value")) == [("g", "a b"), ("g", "c"), ("h", "a b")]
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
