"""Queries of reduction, topics and prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingmill.functions.tokenize import tokenize
from lingmill.operators import multitable as MT
from lingmill.operators import outcomes as O
from lingmill.operators import predict as P
from lingmill.operators import reduce as D
from lingmill.queries.base import query, stored, table, tokens_sql, words

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
FEATS = ["the", "of", "and", "to", "in", "de", "la", "der"]


def _vectors(spark, sf):
    """The dimensions of the embeddings as features."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("d", "x"))
    return e.select(F.col("vec_id").alias("group_id"), F.col("d").cast("string").alias("feat"), F.col("x").cast("double").alias("value"), F.col("x").cast("double").alias("group_norm"))


def _rows(spark, sf, folds: int = 5):
    """Numbers of orders by priority, to predict a customer's balance; the controls are two columns."""
    by = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("group_id"), F.col("o_orderpriority").alias("feat")).agg(F.count("*").alias("value"))
    ft = by.withColumn("group_norm", F.col("value").cast("double"))
    c = table(spark, sf, "customer")
    y = O.folds(O.long_outcomes(c.select("c_custkey", (F.col("c_acctbal") + 500 * F.col("c_nationkey")).alias("balance")), "c_custkey", ["balance"]), folds)
    controls = c.select(F.col("c_custkey").alias("group_id"), F.col("c_nationkey").cast("double").alias("nation"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("building"))
    return P.aligned(ft, y, PRIORITIES, controls, ["nation", "building"])


def _toxic(spark, sf):
    """Stored, as every pass of every fold reads the rows again."""
    y = O.folds(O.long_outcomes(table(spark, sf, "labels"), "doc_id", ["toxic"]), 3)
    return stored(P.aligned(words(spark, sf, "doc_id", groups=y), y, FEATS + ["idiot", "pathetic", "worthless", "stupid"]))


# ---- reduction -------------------------------------------------------------------------------------------------------


@query("l1_lda_topics")
def l1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", tokenize(F.col("text")).alias("tokens"))
    return D.lda_topics(docs, "doc_id", "tokens", k=5, min_df=2)[1]


TOPIC_SQL = f"t AS (SELECT w AS term, length(w) % 5 AS topic FROM (SELECT unnest({tokens_sql('text', False)}) AS w FROM documents)), b AS (SELECT term, topic, count(*) AS n FROM (SELECT term, topic FROM t UNION ALL SELECT term, 0 FROM t WHERE starts_with(term, 'a')) GROUP BY 1, 2)"


@query(
    "l2_topic_distributions",
    f"""WITH {TOPIC_SQL}, s AS (SELECT term, topic, n, n / sum(n) OVER (PARTITION BY term) AS topic_given_word, log2(1 + n * sum(n) OVER () / (sum(n) OVER (PARTITION BY term) * sum(n) OVER (PARTITION BY topic))) AS log_lift, n / sum(n) OVER (PARTITION BY topic) AS word_given_topic FROM b)
    SELECT term, topic, n, topic_given_word, round(log_lift, 7) AS log_lift, word_given_topic, round(log_lift, 7) > CASE WHEN count(*) OVER w > 1 THEN 0.5 * max(round(log_lift, 7)) OVER w ELSE 0 END AS kept FROM s WINDOW w AS (PARTITION BY topic)""",
)
def l2(spark, sf):
    t = table(spark, sf, "documents").select(F.explode(tokenize(F.col("text"))).alias("term"))
    own = F.array((F.length("term") % 5))
    t = t.select("term", F.explode(F.when(F.col("term").startswith("a"), F.concat(own, F.array(F.lit(0)))).otherwise(own)).alias("topic"))
    return D.topic_distributions(t).withColumn("log_lift", F.round("log_lift", 7))


@query("l3_pca")
def l3(spark, sf):
    ft = _vectors(spark, sf)
    return D.transformed(ft, D.pca(ft, [str(i) for i in range(64)], 5))


@query("l3_factors")
def l3b(spark, sf):
    ft = _vectors(spark, sf)
    return D.to_lexicon(ft, D.factor_analysis(ft, [str(i) for i in range(64)], 3))


@query("l3_nmf")
def l3c(spark, sf):
    ft = D.shifted_nonnegative(_vectors(spark, sf))
    return D.to_lexicon(ft, D.nmf(ft, [str(i) for i in range(64)], 2))


@query("l3_clusters")
def l3d(spark, sf):
    return D.clusters(_vectors(spark, sf), [str(i) for i in range(64)], 10)


@query("l7_without_main_components")
def l7(spark, sf):
    ft, feats = _vectors(spark, sf), [str(i) for i in range(64)]
    return D.without_main_components(ft, D.pca(ft, feats, 3), 2)


@query("l8_shifted", "WITH x AS (SELECT vec_id AS group_id, CAST(unnest(range(len(embedding))) AS VARCHAR) AS feat, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT group_id, feat, v AS value, greatest(v - least((SELECT min(v) FROM x), 0), 0) AS group_norm FROM x")
def l8(spark, sf):
    return D.shifted_nonnegative(_vectors(spark, sf))


@query("l9_varimax")
def l9(spark, sf):
    ft = _vectors(spark, sf)
    r = D.pca(ft, [str(i) for i in range(64)], 3)
    r.components = D.varimax(r.components)
    return D.to_lexicon(ft, r)


# ---- prediction ------------------------------------------------------------------------------------------------------


@query("p1_aligned", "SELECT doc_id AS group_id, CAST(quality AS DOUBLE) AS y, CAST(coalesce(n, 0) AS DOUBLE) AS the FROM labels LEFT JOIN (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(" + tokens_sql("text") + ") AS w FROM documents) WHERE w = 'the' GROUP BY 1) USING (doc_id) WHERE quality IS NOT NULL")
def p1(spark, sf):
    y = O.long_outcomes(table(spark, sf, "labels"), "doc_id", ["quality"])
    ft = words(spark, sf, "doc_id").withColumn("group_norm", F.col("value").cast("double"))
    return P.aligned(ft, y, ["the"]).select("group_id", "y", F.element_at("x", 1).alias("the"))


@query("p2_trained")
def p2(spark, sf):
    rows = _toxic(spark, sf)
    return P.predicted(rows, P.trained(rows, "lr", "top5", classes=True))


@query("p2_several_tables")
def p2b(spark, sf):
    """1-grams and 2-grams side by side, each chosen, scaled and rotated on the training folds."""
    y = stored(O.folds(O.long_outcomes(table(spark, sf, "labels"), "doc_id", ["quality"]), 3))
    tables = [stored(words(spark, sf, "doc_id", n=n, groups=y), f"{n}grams") for n in (1, 2)]  # stored, as every fold reads them again
    return MT.n_fold(tables, y, "magic_sauce", "ridgecv")


@query("p5_chosen_features")
def p5(spark, sf):
    y = O.long_outcomes(table(spark, sf, "labels"), "doc_id", ["quality"])
    feats = MT.chosen_features(stored(words(spark, sf, "doc_id", groups=y)), y, MT.PRESETS["magic_sauce"])
    return spark.createDataFrame([(f,) for f in feats], "feat string")


@query("p3_ridge_cross_validated")
def p3(spark, sf):
    return P.cross_validated(_rows(spark, sf), 3, 2)


@query("p4_n_fold_classification")
def p4(spark, sf):
    return P.n_fold(_toxic(spark, sf), "lr", 3, classes=True)


@query("p7_control_combinations")
def p7(spark, sf):
    return P.regression_metrics(P.control_combinations(_rows(spark, sf), 3, 2), ["outcome", "controls", "with_language"])


@query("p8_regression_metrics", """WITH p AS (SELECT c_mktsegment AS outcome, CAST(c_acctbal AS DOUBLE) AS y, c_nationkey * 200.0::DOUBLE + 2000 AS p FROM customer), r AS (SELECT *, rank() OVER (PARTITION BY outcome ORDER BY y) + (count(*) OVER (PARTITION BY outcome, y) - 1) / 2 AS ry, rank() OVER (PARTITION BY outcome ORDER BY p) + (count(*) OVER (PARTITION BY outcome, p) - 1) / 2 AS rp, avg(y) OVER (PARTITION BY outcome) AS m FROM p)
    SELECT outcome, round(1 - sum((y - p) ** 2) / sum((y - m) ** 2), 6) AS r2, round(corr(y, p), 6) AS pearson, round(corr(ry, rp), 6) AS spearman, round(avg((y - p) ** 2), 2) AS mse, round(avg(abs(y - p)), 4) AS mae, round(avg(abs(y - m)), 4) AS mean_mae, count(*) AS n FROM r GROUP BY 1""")
def p8(spark, sf):
    p = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("outcome"), F.col("c_acctbal").cast("double").alias("y"), (F.col("c_nationkey") * 200.0 + 2000).alias("prediction"))
    m = P.regression_metrics(p)
    digits = {"r2": 6, "pearson": 6, "spearman": 6, "mse": 2, "mae": 4, "mean_mae": 4}
    return m.select("outcome", *[F.round(c, d).alias(c) for c, d in digits.items()], "n")


PREDICTED = "SELECT 'size' AS outcome, p_partkey AS group_id, CAST(p_size % 3 AS DOUBLE) AS y, CAST((p_size + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END) % 3 AS DOUBLE) AS p FROM part"


@query("p9_classification_metrics", f"""WITH p AS ({PREDICTED}), k AS (SELECT c, (SELECT count(*) FROM p WHERE y = c) AS t, (SELECT count(*) FROM p WHERE p = c) AS s, (SELECT count(*) FROM p WHERE y = c AND p = c) AS h FROM (SELECT unnest([0, 1, 2]) AS c)), n AS (SELECT count(*) AS n, count(*) FILTER (y = p) AS hits FROM p)
    SELECT 'size' AS outcome, round(any_value(hits / n), 6) AS acc, round(avg(h / s), 6) AS precision, round(avg(h / t), 6) AS recall, round(avg(2 * h / (s + t)), 6) AS f1, round(sum(2 * h / (s + t) * t) / sum(t), 6) AS f1_weighted,
    round((any_value(hits * n) - sum(t * s)) / sqrt((any_value(n * n) - sum(s * s))::DOUBLE * (any_value(n * n) - sum(t * t))), 6) AS mcc, round(max(t) / any_value(n), 6) AS mfclass_acc, any_value(n) AS n FROM k, n""")
def p9(spark, sf):
    p = table(spark, sf, "part").select(F.lit("size").alias("outcome"), (F.col("p_size") % 3).cast("double").alias("y"), ((F.col("p_size") + F.when(F.col("p_partkey") % 4 == 0, 1).otherwise(0)) % 3).cast("double").alias("prediction"))
    m = P.classification_metrics(p)
    return m.select("outcome", *[F.round(c, 6).alias(c) for c in m.columns if c not in ("outcome", "n")], "n")


SCORES = "SELECT c_mktsegment AS outcome, CAST(c_nationkey % 2 AS DOUBLE) AS y, floor(CAST(c_acctbal AS DOUBLE) / 100) + c_nationkey % 2 * 10 AS score FROM customer"


def _scores(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_mktsegment").alias("outcome"), F.col("c_custkey").alias("group_id"), (F.col("c_nationkey") % 2).cast("double").alias("y"), (F.floor(F.col("c_acctbal").cast("double") / 100) + F.col("c_nationkey") % 2 * 10).cast("double").alias("score"))


@query("p9_auc", f"WITH r AS (SELECT outcome, y, rank() OVER (PARTITION BY outcome ORDER BY score) + (count(*) OVER (PARTITION BY outcome, score) - 1) / 2 AS r FROM ({SCORES})) SELECT outcome, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 7) AS auc, count(*) AS n FROM r GROUP BY 1")
def p9b(spark, sf):
    return P.auc(_scores(spark, sf)).withColumn("auc", F.round("auc", 7))


@query("p10_compared_models")
def p10(spark, sf):
    s = _scores(spark, sf).withColumn("other", F.xxhash64("group_id").cast("double"))
    return P.compared_models(s, "other", "score", samples=200)


@query(
    "p11_weighted_ensemble",
    f"""WITH s AS (SELECT row_number() OVER () AS i, * FROM (SELECT c_custkey AS group_id, c_mktsegment AS outcome, CAST(c_nationkey % 2 AS DOUBLE) AS y, floor(CAST(c_acctbal AS DOUBLE) / 100) + c_nationkey % 2 * 10 AS a, -CAST(c_nationkey AS DOUBLE) AS b FROM customer)),
    l AS (SELECT outcome, group_id, y, 'a' AS model, a AS score FROM s UNION ALL SELECT outcome, group_id, y, 'b', b FROM s), r AS (SELECT *, rank() OVER (PARTITION BY outcome, model ORDER BY score) + (count(*) OVER (PARTITION BY outcome, model, score) - 1) / 2 AS r FROM l),
    w AS (SELECT outcome, model, ((greatest((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 0.5) - 0.5) / 0.5) ** 2 AS w FROM r GROUP BY 1, 2)
    SELECT outcome, group_id, y, round(CASE WHEN sum(w) > 0 THEN sum(w * score) / sum(w) ELSE avg(score) END, 5) AS score FROM l JOIN w USING (outcome, model) GROUP BY 1, 2, 3""",
)
def p11(spark, sf):
    s = _scores(spark, sf)
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("group_id"), (-F.col("c_nationkey").cast("double")).alias("score"))
    two = s.withColumn("model", F.lit("a")).unionByName(s.drop("score").join(b, "group_id").withColumn("model", F.lit("b")))
    return P.weighted_ensemble(two).withColumn("score", F.round("score", 5))


@query("p12_residualised")
def p12(spark, sf):
    return P.residualised(_rows(spark, sf), 3, 2)


@query("p13_adjusted_outcomes")
def p13(spark, sf):
    return P.adjusted_outcomes(_rows(spark, sf))


@query("p14_factors", """WITH ft AS (SELECT o_custkey AS group_id, o_orderpriority AS feat, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1, 2), f AS (SELECT c_custkey AS group_id, (c_nationkey - min(c_nationkey) OVER ()) / (max(c_nationkey) OVER () - min(c_nationkey) OVER ()) AS f FROM customer)
    SELECT group_id, feat, v AS value, v AS group_norm FROM ft UNION ALL SELECT group_id, feat || '*nation', v * f, v * f FROM ft JOIN f USING (group_id) WHERE f <> 0""")
def p14(spark, sf):
    ft = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("group_id"), F.col("o_orderpriority").alias("feat")).agg(F.count("*").cast("double").alias("value")).withColumn("group_norm", F.col("value"))
    return P.with_factors(ft, table(spark, sf, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_nationkey").cast("double").alias("nation")), ["nation"])


@query("p15_split_and_predict")
def p15(spark, sf):
    train, test = P.split(_rows(spark, sf))
    return P.predicted(test.drop("y"), P.trained(train, "ridge"))


@query("p16_predictions_as_features", "SELECT p_partkey AS group_id, outcome AS feat, p AS value, p AS group_norm FROM (SELECT group_id AS p_partkey, outcome, p FROM (" + PREDICTED + "))")
def p16(spark, sf):
    p = table(spark, sf, "part").select(F.lit("size").alias("outcome"), F.col("p_partkey").alias("group_id"), ((F.col("p_size") + F.when(F.col("p_partkey") % 4 == 0, 1).otherwise(0)) % 3).cast("double").alias("prediction"))
    return P.as_features(p)


@query("p17_unpacked_topics", "WITH w AS (SELECT p_size AS topic, avg(CAST(p_retailprice AS DOUBLE)) AS w1 FROM part GROUP BY 1), t AS (SELECT p_brand AS term, p_size AS topic, CAST(count(*) AS DOUBLE) AS w2 FROM part GROUP BY 1, 2) SELECT term, 'price' AS category, round(sum(w1 * w2), 4) AS weight FROM w JOIN t USING (topic) GROUP BY 1 UNION ALL SELECT '_intercept', 'price', 1.5")
def p17(spark, sf):
    part = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    w = part.groupBy(size.alias("term")).agg(F.avg(F.col("p_retailprice").cast("double")).alias("weight")).withColumn("category", F.lit("price"))
    w = w.unionByName(spark.createDataFrame([("_intercept", "price", 1.5)], "term string, category string, weight double"))
    t = part.groupBy(F.col("p_brand").alias("term"), size.alias("category")).agg(F.count("*").cast("double").alias("weight"))
    return P.unpacked_topics(w, t).withColumn("weight", F.round("weight", 4))


@query("p17_ridge_lexicon")
def p17b(spark, sf):
    m = P.fold_moments(_rows(spark, sf))["balance"]
    return P.ridge_lexicon(spark, P.best_ridge(m, [0, 1, 2, 3, 4]), PRIORITIES, "balance")


@query("p18_stacked")
def p18(spark, sf):
    p = P.cross_validated(_rows(spark, sf), 3, 2)
    return P.stacked(p.withColumn("source", F.concat_ws("/", "controls", F.col("with_language").cast("string"))))


@query("p18_classify_then_regress")
def p18b(spark, sf):
    labels = table(spark, sf, "customer").select(F.col("c_custkey").alias("group_id"), (F.col("c_nationkey") > 12).cast("int").alias("label"))
    return P.classify_then_regress(_rows(spark, sf), labels, [1.0])


@query("p19_training_bootstraps")
def p19(spark, sf):
    train, test = P.split(_rows(spark, sf))
    return P.training_bootstraps(train, test, [50, 100], 2)


@query("p20_roc", f"WITH s AS (SELECT outcome, score AS threshold, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS f FROM ({SCORES}) GROUP BY 1, 2) SELECT outcome, threshold, sum(f) OVER w / sum(f) OVER (PARTITION BY outcome) AS fpr, sum(p) OVER w / sum(p) OVER (PARTITION BY outcome) AS tpr FROM s WINDOW w AS (PARTITION BY outcome ORDER BY threshold DESC)")
def p20(spark, sf):
    return P.roc_curve(_scores(spark, sf))


