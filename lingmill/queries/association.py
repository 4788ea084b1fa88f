"""Queries of outcomes and of association.

p-values need distribution functions that DuckDB lacks: the SQL compares effects, numbers and intervals, and ranks them
for corrections; tests compare the p-values with known ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lingmill.operators import association as A
from lingmill.operators import outcomes as O
from lingmill.operators import refine as R
from lingmill.queries.base import features_sql, query, stored, table, words

FT = f"ft AS (SELECT * FROM {features_sql(1, 'doc_id')})"
#: quality and toxic, and the length of the text
Y = """y AS (SELECT 'quality' AS outcome, doc_id AS group_id, CAST(quality AS DOUBLE) AS y FROM labels WHERE quality IS NOT NULL UNION ALL SELECT 'toxic', doc_id, toxic FROM labels WHERE toxic IS NOT NULL
    UNION ALL SELECT 'n_chars', doc_id, n_chars FROM documents WHERE n_chars IS NOT NULL)"""
#: every group of an outcome and every feature one of them has
DENSE = """x AS (SELECT y.outcome, f.feat, y.group_id, y.y, coalesce(ft.group_norm, 0) AS x, coalesce(ft.value, 0) AS value FROM y JOIN (SELECT DISTINCT outcome, feat FROM ft JOIN y USING (group_id)) f USING (outcome) LEFT JOIN ft ON ft.group_id = y.group_id AND ft.feat = f.feat)"""
BINARY = "WITH " + FT + ", " + Y.split("\n")[0] + f"), {DENSE}"
#: numbers of a customer's orders by priority
CFT = "ft AS (SELECT group_id, feat, value, value / sum(value) OVER (PARTITION BY group_id) AS group_norm FROM (SELECT o_custkey AS group_id, o_orderpriority AS feat, count(*) AS value FROM orders GROUP BY 1, 2))"
CY = "y AS (SELECT 'balance' AS outcome, c_custkey AS group_id, CAST(c_acctbal AS DOUBLE) AS y FROM customer UNION ALL SELECT 'nation', c_custkey, CAST(c_nationkey AS DOUBLE) FROM customer)"


def analysis(spark, sf, binary: bool = False):
    y = O.long_outcomes(table(spark, sf, "labels"), "doc_id", ["quality", "toxic"])
    return y if binary else y.unionByName(O.long_outcomes(table(spark, sf, "documents"), "doc_id", ["n_chars"]))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def customers(spark, sf):
    """Features of customers, two outcomes, and two controls."""
    by = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("group_id"), F.col("o_orderpriority").alias("feat")).agg(F.count("*").alias("value"))
    totals = by.groupBy("group_id").agg(F.sum("value").alias("t"))
    ft = by.join(totals, "group_id").select("group_id", "feat", "value", (F.col("value") / F.col("t")).alias("group_norm"))
    c = table(spark, sf, "customer")
    y = O.long_outcomes(c.select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")), "c_custkey", ["balance", "nation"])
    controls = c.select(F.col("c_custkey").alias("group_id"), (F.col("c_custkey") % 13).cast("double").alias("cycle"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("building"))
    return ft, y, controls


def _rounded(df, *columns, digits=5):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("o1_group_outcomes", "SELECT doc_id AS group_id, quality AS y FROM labels WHERE quality IS NOT NULL AND toxic = 0")
def o1(spark, sf):
    return O.group_outcomes(table(spark, sf, "labels"), "doc_id", "quality", "toxic = 0")


@query("o2_value_counts", "SELECT quality, toxic, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2")
def o2(spark, sf):
    return O.value_counts(table(spark, sf, "labels"), "quality", "toxic")


@query(
    "o3_analysis_set",
    f"""WITH {FT}, ok AS (SELECT group_id FROM ft GROUP BY 1 HAVING sum(value) >= 50), l AS (SELECT doc_id AS group_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT group_id FROM ok)),
    a AS (SELECT 'n_chars' AS outcome, group_id, CAST(n_chars AS DOUBLE) AS y FROM l WHERE n_chars IS NOT NULL UNION ALL SELECT 'lang__' || k, group_id, CAST(lang = k AS INTEGER)::DOUBLE FROM l, (SELECT DISTINCT lang AS k FROM documents WHERE lang IS NOT NULL) WHERE lang IS NOT NULL
      UNION ALL SELECT 'lang__multiclass', group_id, c FROM l JOIN (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS c FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)) USING (lang))
    SELECT * FROM a WHERE outcome IN (SELECT outcome FROM a GROUP BY 1 HAVING var_pop(y) > 0)""",
)
def o3(spark, sf):
    return O.analysis_set(table(spark, sf, "documents"), "doc_id", ["n_chars"], ["lang"], ["lang"], words=words(spark, sf, "doc_id"), threshold=50)


@query("o5_groups_per_outcome", f"WITH {Y} SELECT outcome, count(*) AS n FROM y GROUP BY 1")
def o5(spark, sf):
    return O.groups_per_outcome(analysis(spark, sf))


@query("p6_folds", "SELECT 'balance' AS outcome, c_custkey AS group_id, CAST(c_acctbal AS DOUBLE) AS y, CAST((row_number() OVER (ORDER BY CAST(c_acctbal AS DOUBLE), CAST(c_custkey AS VARCHAR)) - 1) % 10 AS INTEGER) AS fold FROM customer")
def p6(spark, sf):
    return O.folds(customers(spark, sf)[1].where("outcome = 'balance'"), 10)


R_SQL = "CASE WHEN stddev_pop(x) > 1e-9 AND stddev_pop(y) > 1e-9 THEN corr(x, y) END"


@query(
    "a2_pearson",
    f"""WITH {FT}, {Y}, {DENSE}, s AS (SELECT outcome, feat, {R_SQL} AS r, count(*) AS n, CAST(sum(value) AS BIGINT) AS freq FROM x GROUP BY 1, 2)
    SELECT outcome, feat, round(r, 5) AS r, n, round(CASE WHEN abs(r) < 1 THEN tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)) END, 5) AS ci_l, round(CASE WHEN abs(r) < 1 THEN tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)) END, 5) AS ci_u, freq FROM s""",
)
def a2(spark, sf):
    return _rounded(A.pearson(words(spark, sf, "doc_id"), analysis(spark, sf), with_p=False), "r", "ci_l", "ci_u")


@query("a2_pearson_with_p")
def a2b(spark, sf):
    return A.corrected(A.pearson(words(spark, sf, "doc_id"), analysis(spark, sf)))


@query("a1_outcome_correlations", f"WITH {Y} SELECT a.outcome, b.outcome AS feat, round(corr(a.y, b.y), 6) AS r, count(*) AS n FROM y a JOIN y b USING (group_id) GROUP BY 1, 2")
def a1(spark, sf):
    return _rounded(A.outcome_correlations(analysis(spark, sf), with_p=False).select("outcome", "feat", "r", "n"), "r", digits=6)


RANK = "rank() OVER (PARTITION BY {0} ORDER BY {1}) + (count(*) OVER (PARTITION BY {0}, {1}) - 1) / 2"


@query(
    "a3_spearman",
    f"WITH {FT}, {Y}, {DENSE}, r AS (SELECT outcome, feat, {RANK.format('outcome, feat', 'x')} AS x, {RANK.format('outcome, feat', 'y')} AS y, value FROM x) SELECT outcome, feat, round({R_SQL}, 5) AS r, count(*) AS n, CAST(sum(value) AS BIGINT) AS freq FROM r GROUP BY 1, 2",
)
def a3(spark, sf):
    return _rounded(A.spearman(stored(words(spark, sf, "doc_id")), analysis(spark, sf), with_p=False).drop("ci_l", "ci_u"), "r")


CX = "x AS (SELECT y.outcome, f.feat, y.group_id, y.y, coalesce(ft.group_norm, 0) AS x FROM y CROSS JOIN (SELECT DISTINCT feat FROM ft) f LEFT JOIN ft ON ft.group_id = y.group_id AND ft.feat = f.feat)"


@query(
    "a4_regression",
    f"""WITH {CFT}, {CY}, {CX}, r AS (SELECT outcome, feat, corr(x, y) AS xy, corr(x, CAST(c_custkey % 13 AS DOUBLE)) AS xc, corr(y, CAST(c_custkey % 13 AS DOUBLE)) AS yc, count(*) AS n FROM x JOIN customer ON c_custkey = group_id GROUP BY 1, 2)
    SELECT outcome, feat, 'group_norm' AS term, round((xy - xc * yc) / (1 - xc * xc), 6) AS r, n FROM r""",
)
def a4(spark, sf):
    ft, y, c = customers(spark, sf)
    return _rounded(A.regression(ft, y, c, ["cycle"]).select("outcome", "feat", "term", "r", "n"), "r", digits=6)


@query("a5_rank_regression", f"""WITH {CFT}, {CY}, {CX}, k AS (SELECT outcome, feat, {RANK.format('outcome, feat', 'x')} AS x, {RANK.format('outcome, feat', 'y')} AS y, rank() OVER (PARTITION BY outcome, feat ORDER BY c_custkey % 13) + (count(*) OVER (PARTITION BY outcome, feat, c_custkey % 13) - 1) / 2 AS c FROM x JOIN customer ON c_custkey = group_id),
    r AS (SELECT outcome, feat, corr(x, y) AS xy, corr(x, c) AS xc, corr(y, c) AS yc, count(*) AS n FROM k GROUP BY 1, 2) SELECT outcome, feat, round((xy - xc * yc) / (1 - xc * xc), 6) AS r, n FROM r""")
def a5(spark, sf):
    ft, y, c = customers(spark, sf)
    return _rounded(A.regression(ft, y, c, ["cycle"], ranks=True).select("outcome", "feat", "r", "n"), "r", digits=6)


@query("a6_logistic")
def a6(spark, sf):
    return A.logistic(words(spark, sf, "doc_id"), analysis(spark, sf, True))


@query(
    "a7_cohens_d",
    f"{BINARY} SELECT outcome, feat, round((avg(x) FILTER (y = 1) - avg(x) FILTER (y = 0)) / nullif(sqrt((var_samp(x) FILTER (y = 1) + var_samp(x) FILTER (y = 0)) / 2), 0), 5) AS d, count(*) AS n, CAST(sum(value) AS BIGINT) AS freq FROM x GROUP BY 1, 2",
)
def a7(spark, sf):
    return _rounded(A.cohens_d(words(spark, sf, "doc_id"), analysis(spark, sf, True)), "d")


@query("a8_interactions")
def a8(spark, sf):
    ft, y, c = customers(spark, sf)
    return A.regression(ft, y, c, ["cycle", "building"], ["building"])


@query(
    "a9_auc",
    f"""{BINARY}, k AS (SELECT outcome, feat, y, value, {RANK.format('outcome, feat', 'x')} AS r FROM x), s AS (SELECT outcome, feat, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc, count(*) AS n, CAST(sum(value) AS BIGINT) AS freq FROM k GROUP BY 1, 2)
    SELECT outcome, feat, round(CASE WHEN auc < 0.5 THEN auc - 1 ELSE auc END, 6) AS auc, n, freq FROM s""",
)
def a9(spark, sf):
    return _rounded(A.auc(words(spark, sf, "doc_id"), analysis(spark, sf, True)), "auc", digits=6)


@query("a9_auc_permutations")
def a9b(spark, sf):
    y = analysis(spark, sf, True)
    return A.auc_permutation_p(words(spark, sf, "doc_id", groups=y), y)


IDP = """s AS (SELECT outcome, sum(c1) AS s1, sum(c2) AS s2, sum(f) AS a FROM k GROUP BY 1), t AS (SELECT outcome, feat, f, c1 + s1 / a * f AS t1, c2 + s2 / a * f AS t2, s1 / a * a + s1 AS b1, s2 / a * a + s2 AS b2 FROM k JOIN s USING (outcome)),
    o AS (SELECT *, t1 / (b1 - t1) AS o1, t2 / (b2 - t2) AS o2 FROM t) SELECT outcome, feat, round(CASE WHEN o1 > 0 AND o2 > 0 THEN (ln(o2) - ln(o1)) / sqrt(1 / t1 + 1 / t2) END, 6) AS delta, CAST(f AS BIGINT) AS freq FROM o"""


@query("a10_log_odds", "WITH " + FT + ", " + Y.split("\n")[0] + f"), k AS (SELECT outcome, feat, coalesce(sum(value) FILTER (y = 0), 0) AS c1, coalesce(sum(value) FILTER (y = 1), 0) AS c2, sum(value) AS f FROM ft JOIN y USING (group_id) GROUP BY 1, 2), {IDP}")
def a10(spark, sf):
    return _rounded(A.log_odds(words(spark, sf, "doc_id"), analysis(spark, sf, True)).drop("n"), "delta", digits=6)


@query(
    "a11_log_odds_of_samples",
    f"WITH ft AS (SELECT * FROM {features_sql(1)}), g AS (SELECT DISTINCT group_id FROM ft), y AS (SELECT 'samples' AS outcome, group_id, CASE WHEN ends_with(group_id, '1') THEN 0 ELSE 1 END AS y FROM g), k AS (SELECT outcome, feat, coalesce(sum(value) FILTER (y = 0), 0) AS c1, coalesce(sum(value) FILTER (y = 1), 0) AS c2, sum(value) AS f FROM ft JOIN y USING (group_id) GROUP BY 1, 2), {IDP}",
)
def a11(spark, sf):
    ft = words(spark, sf)
    ones = ft.where(F.col("group_id").endswith("1")).select(F.col("group_id").alias("pattern")).distinct()
    rest = ft.select(F.concat(F.substring("group_id", 1, 3), F.lit("*")).alias("pattern")).distinct()
    return _rounded(A.log_odds_of_samples(ft, ones, rest).drop("n"), "delta", digits=6)


@query("a12_group_z", f"{BINARY} SELECT outcome, feat, round(avg(x) FILTER (y = 1), 8) AS raw, round((avg(x) FILTER (y = 1) - avg(x)) / nullif(stddev_pop(x), 0), 5) AS z, count(*) AS n FROM x GROUP BY 1, 2")
def a12(spark, sf):
    out = A.group_z_effects(words(spark, sf, "doc_id"), analysis(spark, sf, True))
    return out.withColumns({"raw": F.round("raw", 8), "z": F.round("z", 5)})


@query(
    "a13_control_combinations",
    f"""WITH {CFT}, {CY}, {CX}, r AS (SELECT outcome, feat, corr(x, y) AS xy, corr(x, c) AS xc, corr(y, c) AS yc, corr(x, b) AS xb, corr(y, b) AS yb, corr(c, b) AS cb, count(*) AS n FROM (SELECT x.*, CAST(c_custkey % 13 AS DOUBLE) AS c, CAST(c_mktsegment = 'BUILDING' AS INTEGER)::DOUBLE AS b FROM x JOIN customer ON c_custkey = group_id) GROUP BY 1, 2)
    SELECT '' AS controls, outcome, feat, round(xy, 6) AS r, n FROM r UNION ALL SELECT 'cycle', outcome, feat, round((xy - xc * yc) / (1 - xc * xc), 6), n FROM r UNION ALL SELECT 'building', outcome, feat, round((xy - xb * yb) / (1 - xb * xb), 6), n FROM r
    UNION ALL SELECT 'building cycle', outcome, feat, round((xy * (1 - cb * cb) - xc * (yc - yb * cb) - xb * (yb - yc * cb)) / (1 - cb * cb - xc * xc - xb * xb + 2 * xc * xb * cb), 6), n FROM r""",
)
def a13(spark, sf):
    ft, y, c = customers(spark, sf)
    return _rounded(A.control_combinations(ft, y, c, ["cycle", "building"]).select("controls", "outcome", "feat", "r", "n"), "r", digits=6)


@query(
    "a14_multiple_regression",
    f"""WITH {CFT}, {CY}, {CX}, p AS (SELECT feat, group_id, any_value(x) AS x, max(y) FILTER (outcome = 'balance') AS a, max(y) FILTER (outcome = 'nation') AS b FROM x GROUP BY 1, 2), r AS (SELECT feat, corr(x, a) AS xa, corr(x, b) AS xb, corr(a, b) AS ab, count(*) AS n FROM p GROUP BY 1)
    SELECT feat, 'balance' AS term, round((xa - xb * ab) / (1 - ab * ab), 6) AS beta, n FROM r UNION ALL SELECT feat, 'nation', round((xb - xa * ab) / (1 - ab * ab), 6), n FROM r""",
)
def a14(spark, sf):
    ft, _, _ = customers(spark, sf)
    o = table(spark, sf, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_acctbal").cast("double").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return _rounded(A.multiple_regression(ft, o, ["balance", "nation"]).drop("p"), "beta", digits=6)


# ---- corrections: of p-values that both engines can make -------------------------------------------------------------

P_SQL = "WITH p AS (SELECT c_mktsegment AS outcome, CAST(c_custkey AS VARCHAR) AS feat, CAST(c_acctbal + 1000 AS DOUBLE) / 1e6 * (c_custkey % 7 + 1) / 7 AS p FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY p, feat) AS i, count(*) OVER (PARTITION BY outcome) AS m FROM p)"
CORRECTIONS = {
    "bonferroni": "least(1, p * m)",
    "sidak": "1 - (1 - p) ** m",
    "holm": "least(1, max(p * (m - i + 1)) OVER (PARTITION BY outcome ORDER BY i))",
    "holm-sidak": "max(1 - (1 - p) ** (m - i + 1)) OVER (PARTITION BY outcome ORDER BY i)",
    "hochberg": "least(1, min(p * (m - i + 1)) OVER (PARTITION BY outcome ORDER BY i DESC))",
    "bh": "least(1, min(p * m / i) OVER (PARTITION BY outcome ORDER BY i DESC))",
    "by": "least(1, min(p * m / i) OVER (PARTITION BY outcome ORDER BY i DESC) * (sum(1 / i) OVER (PARTITION BY outcome)))",
    "simes": "least(1, p * m / i)",
    "hommel": None,
}


def _two_stages(factor: float) -> str:
    """The second stage counts the hypotheses that the first left."""
    return f"""{P_SQL}, b AS (SELECT *, {CORRECTIONS['bh']} AS bh FROM k), c AS (SELECT *, sum(CAST(bh <= 0.05 / {factor} AS INTEGER)) OVER (PARTITION BY outcome) AS r FROM b)
    SELECT outcome, feat, round(least(1, bh * CASE WHEN r = m THEN m ELSE m - r END / m * {factor}), 9) AS p_corrected FROM c"""


def _correction(method: str, sql: str | None) -> None:
    @query(f"a15_{method.replace('-', '_')}", sql)
    def a15(spark, sf):
        p = (F.col("c_acctbal").cast("double") + 1000) / 1e6 * (F.col("c_custkey") % 7 + 1) / 7
        rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("outcome"), F.col("c_custkey").cast("string").alias("feat"), p.alias("p"))
        return A.corrected(rows, method).select("outcome", "feat", F.round("p_corrected", 9).alias("p_corrected"))


for _m, _s in CORRECTIONS.items():
    _correction(_m, f"{P_SQL} SELECT outcome, feat, round({_s}, 9) AS p_corrected FROM k" if _s else None)
_correction("tsbh", _two_stages(1.0))
_correction("tsbky", _two_stages(1.05))


@query("r14_correlation_filter")
def r14(spark, sf):
    ft = stored(words(spark, sf, "doc_id"))
    return R.correlation_filter(ft, A.pearson(ft, analysis(spark, sf)), 0.01)


@query("a16_topics_without_duplicates")
def a16(spark, sf):
    y = analysis(spark, sf, True)
    r = stored(A.pearson(words(spark, sf, "doc_id", n=2, groups=y), y, with_p=False))
    return A.topics_without_duplicates(r, r.select("feat", F.explode(F.split("feat", " ")).alias("term")).distinct())


@query("a17_phrases_without_repeats")
def a17(spark, sf):
    y = analysis(spark, sf, True)
    r = A.pearson(words(spark, sf, "doc_id", n=2, groups=y), y, with_p=False)
    return A.phrases_without_repeats(r, words(spark, sf, "doc_id").groupBy("feat").agg(F.sum("value").alias("freq")))


@query(
    "a18_tag_cloud",
    f"""WITH {FT}, {Y}, {DENSE}, s AS (SELECT outcome, feat, round({R_SQL}, 9) AS r, CAST(sum(value) AS BIGINT) AS freq FROM x GROUP BY 1, 2), k AS (SELECT *, CAST(sign(r) AS INTEGER) AS sign, abs(r) AS a FROM s WHERE r IS NOT NULL AND r <> 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY outcome, sign ORDER BY a DESC, feat) AS rank FROM k QUALIFY rank <= 50), b AS (SELECT *, min(a) OVER w AS lo, max(a) OVER w AS hi, count(*) OVER w AS n, row_number() OVER (PARTITION BY outcome, sign ORDER BY freq, feat) AS f FROM t WINDOW w AS (PARTITION BY outcome, sign))
    SELECT outcome, sign, rank, feat, CAST(floor((a - lo) / (hi - lo) * 50) + greatest(50 - n, 10) AS INTEGER) AS size, CAST(floor((f - 1) / (n - 1) * 64) AS INTEGER) AS colour_step FROM b""",
)
def a18(spark, sf):
    r = _rounded(A.pearson(words(spark, sf, "doc_id"), analysis(spark, sf), with_p=False), "r", digits=9)
    return A.tag_cloud(r, 50, max_p=None).drop("r").withColumn("rank", F.col("rank").cast("long"))


@query("a19_mean_x_by_y", "SELECT c_nationkey, round(avg(c_acctbal), 6) AS mean, count(c_acctbal) AS n FROM customer GROUP BY 1")
def a19(spark, sf):
    return _rounded(A.mean_x_by_y(table(spark, sf, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("double")), "c_acctbal", "c_nationkey"), "mean", digits=6)


@query("a19_stratified_z", "WITH m AS (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1) SELECT c_custkey, round((c_acctbal - (SELECT avg(m) FROM m)) / (SELECT stddev_pop(m) FROM m), 6) AS z FROM customer")
def a19b(spark, sf):
    c = table(spark, sf, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("double"))
    return _rounded(A.stratified_z(c, "c_custkey", "c_acctbal", "c_nationkey"), "z", digits=6)


@query("a20_loess")
def a20(spark, sf):
    ft, y, _ = customers(spark, sf)
    return A.loess(ft, y, PRIORITIES)


POLY = "(1 + 0.049867347 * z + 0.0211410061 * z ** 2 + 0.0032776263 * z ** 3 + 0.0000380036 * z ** 4 + 0.0000488906 * z ** 5 + 0.000005383 * z ** 6) ** -16"


@query(
    "a21_differential",
    f"""WITH {CFT}, {CY}, {CX}, s AS (SELECT outcome, feat, corr(x, y) FILTER (group_id % 2 = 0) AS r_0, corr(x, y) FILTER (group_id % 2 = 1) AS r_1, count(*) FILTER (group_id % 2 = 0) AS n_0, count(*) FILTER (group_id % 2 = 1) AS n_1 FROM x GROUP BY 1, 2),
    z AS (SELECT *, abs(atanh(r_0) - atanh(r_1)) / sqrt(1 / (n_0 - 3) + 1 / (n_1 - 3)) AS z FROM s) SELECT outcome, feat, round(r_0 - r_1, 6) AS dr, round({POLY}, 6) AS p, n_0, n_1 FROM z""",
)
def a21(spark, sf):
    ft, y, _ = customers(spark, sf)
    half = lambda k: A.pearson(ft, y.where(F.col("group_id") % 2 == k), with_p=False)
    return _rounded(A.differential(half(0), half(1)).drop("r_0", "r_1"), "dr", "p", digits=6)


@query(
    "a21_agreement",
    f"""WITH {CFT}, {CY}, {CX}, s AS (SELECT outcome, feat, round(corr(x, y) FILTER (group_id % 2 = 0), 9) AS r_0, round(corr(x, y) FILTER (group_id % 2 = 1), 9) AS r_1 FROM x GROUP BY 1, 2),
    k AS (SELECT *, {RANK.format('outcome', 'r_0')} AS k0, {RANK.format('outcome', 'r_1')} AS k1 FROM s) SELECT outcome, round(corr(r_0, r_1), 5) AS pearson, round(corr(k0, k1), 5) AS spearman, count(*) AS n FROM k GROUP BY 1""",
)
def a21b(spark, sf):
    ft, y, _ = customers(spark, sf)
    half = lambda k: _rounded(A.pearson(ft, y.where(F.col("group_id") % 2 == k), with_p=False), "r", digits=9)
    return _rounded(A.agreement(half(0), half(1)), "pearson", "spearman")


@query("a22_interaction_by_strata")
def a22(spark, sf):
    ft, y, c = customers(spark, sf)
    return A.interaction_by_strata(ft, y, c, "building", 0.5)


@query(
    "a23_mediation",
    f"""WITH {CFT}, {CY}, {CX}, r AS (SELECT outcome, feat, corr(x, y) AS c, corr(x, m) AS alpha, corr(m, y) AS my, count(*) AS n FROM (SELECT x.*, CAST(c_custkey % 13 AS DOUBLE) AS m FROM x JOIN customer ON c_custkey = group_id) GROUP BY 1, 2),
    b AS (SELECT *, (my - alpha * c) / (1 - alpha * alpha) AS beta, (c - alpha * my) / (1 - alpha * alpha) AS c_prime FROM r), e AS (SELECT *, sqrt((1 - alpha * alpha) / (n - 1)) AS ea, sqrt((1 - beta * my - c_prime * c) / (n - 2) / (1 - alpha * alpha)) AS eb FROM b)
    SELECT outcome, feat, round(c, 6) AS c, round(c_prime, 6) AS c_prime, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(alpha * beta / sqrt(beta * beta * ea * ea + alpha * alpha * eb * eb), 5) AS sobel, n FROM e""",
)
def a23(spark, sf):
    ft, y, c = customers(spark, sf)
    out = A.mediation(ft, y, c, "cycle").drop("p", "share")
    return _rounded(out, "c", "c_prime", "alpha", "beta", digits=6).withColumn("sobel", F.round("sobel", 5))


@query("a24_mediation_bootstrap")
def a24(spark, sf):
    ft, y, c = customers(spark, sf)
    return A.mediation_bootstrap(ft, y, c, "cycle")


@query("a25_canonical_correlation")
def a25(spark, sf):
    ft, _, _ = customers(spark, sf)
    o = table(spark, sf, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_acctbal").cast("double").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    _, loadings, _ = A.canonical_correlation(ft, o, ["balance", "nation"], PRIORITIES)
    return spark.createDataFrame(loadings, "side string, name string, component int, weight double")


@query(
    "a26_column_statistics",
    "SELECT 'o_totalprice' AS \"column\", count(x) AS n, count(*) - count(x) AS nulls, round(avg(x), 4) AS mean, round(stddev(x), 4) AS std, min(x) AS min, max(x) AS max, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.75), 4) AS q3 FROM (SELECT CAST(o_totalprice AS DOUBLE) AS x FROM orders)",
)
def a26(spark, sf):
    return _rounded(A.column_statistics(table(spark, sf, "orders"), ["o_totalprice"]), "mean", "std", "q1", "median", "q3", digits=4)


@query("a26_category_statistics", "SELECT 'c_mktsegment' AS \"column\", c_mktsegment AS label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM customer GROUP BY 2")
def a26b(spark, sf):
    return A.category_statistics(table(spark, sf, "customer"), ["c_mktsegment"])


@query("a26_histogram", "WITH e AS (SELECT min(CAST(c_acctbal AS DOUBLE)) AS lo, max(CAST(c_acctbal AS DOUBLE)) AS hi FROM customer), b AS (SELECT CAST(least(9, floor((c_acctbal - lo) / ((hi - lo) / 10))) AS INTEGER) AS bin FROM customer, e) SELECT bin, round(any_value(lo + bin * (hi - lo) / 10), 4) AS low, round(any_value(lo + (bin + 1) * (hi - lo) / 10), 4) AS high, count(*) AS n FROM b, e GROUP BY 1")
def a26c(spark, sf):
    return _rounded(A.histogram(table(spark, sf, "customer"), "c_acctbal"), "low", "high", digits=4)


@query("a26_histogram_2d", "WITH e AS (SELECT min(p_size) AS la, max(p_size) AS ha, min(CAST(p_retailprice AS DOUBLE)) AS lb, max(CAST(p_retailprice AS DOUBLE)) AS hb FROM part) SELECT CAST(least(4, floor((p_size - la) / ((ha - la) / 5))) AS INTEGER) AS bin_a, CAST(least(4, floor((p_retailprice - lb) / ((hb - lb) / 5))) AS INTEGER) AS bin_b, count(*) AS n FROM part, e GROUP BY 1, 2")
def a26d(spark, sf):
    return A.histogram_2d(table(spark, sf, "part"), "p_size", "p_retailprice", 5)


@query("s13_correlation_matrix", f"WITH {FT}, {Y}, {DENSE}, s AS (SELECT outcome, feat, {R_SQL} AS r, count(*) AS n FROM x GROUP BY 1, 2) SELECT feat AS feature, round(coalesce(max(r) FILTER (outcome = 'quality'), 0), 5) AS quality, coalesce(max(n) FILTER (outcome = 'quality'), 0) AS quality_n, round(coalesce(max(r) FILTER (outcome = 'n_chars'), 0), 5) AS n_chars, coalesce(max(n) FILTER (outcome = 'n_chars'), 0) AS n_chars_n, round(coalesce(max(r) FILTER (outcome = 'toxic'), 0), 5) AS toxic, coalesce(max(n) FILTER (outcome = 'toxic'), 0) AS toxic_n FROM s GROUP BY 1")
def s13(spark, sf):
    r = A.pearson(words(spark, sf, "doc_id"), analysis(spark, sf), with_p=False).select("outcome", "feat", "r", "n")
    return _rounded(A.correlation_matrix(r, ["quality", "n_chars", "toxic"]), "quality", "n_chars", "toxic")


@query("s13_sorted_correlations", f"WITH {FT}, {Y}, {DENSE}, s AS (SELECT outcome, feat, round({R_SQL}, 5) AS r FROM x GROUP BY 1, 2) SELECT outcome, feat, r, row_number() OVER (PARTITION BY outcome ORDER BY r DESC NULLS LAST, feat) AS rank FROM s")
def s13b(spark, sf):
    r = _rounded(A.pearson(words(spark, sf, "doc_id"), analysis(spark, sf), with_p=False).select("outcome", "feat", "r"), "r")
    return A.sorted_correlations(r).withColumn("rank", F.col("rank").cast("long"))
