"""Queries of feature getters and of refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingmill.operators import features as G
from lingmill.operators import refine as R
from lingmill.queries.base import features_sql, query, scratch, stored, table, words  # noqa: F401

FT = f"WITH ft AS (SELECT * FROM {features_sql(1)})"
FT2 = f"WITH ft AS (SELECT * FROM {features_sql(2)}), w AS (SELECT * FROM {features_sql(1)})"
CONV = f"WITH ft AS (SELECT * FROM {features_sql(1, 'conv_id', source='conversations')})"


def _rounded(df, *columns, digits=7):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- getters ---------------------------------------------------------------------------------------------------------


@query("g1_feature_counts", f"{FT}, ok AS (SELECT group_id FROM ft GROUP BY 1 HAVING sum(value) >= 500) SELECT feat, count(*) AS n_groups FROM ft WHERE group_id IN (SELECT group_id FROM ok) GROUP BY 1")
def g1(spark, sf):
    ft = words(spark, sf)
    return G.feature_counts(ft, G.eligible_groups(ft, 500))


for _by in ("feat", "group_id", None):
    _key = f"{_by}, " if _by else ""

    @query(f"g2_sums_by_{_by or 'none'}", f"{FT} SELECT {_key}CAST(sum(value) AS BIGINT) AS value FROM ft" + (f" GROUP BY {_by}" if _by else ""))
    def g2(spark, sf, by=_by):
        return G.value_sums(words(spark, sf), by)


@query("g3_distinct_features", f"{FT} SELECT DISTINCT feat FROM ft")
def g3(spark, sf):
    return G.distinct_features(words(spark, sf))


@query("g3_count_groups", f"{FT} SELECT count(*) AS n FROM (SELECT group_id FROM ft GROUP BY 1 HAVING sum(value) >= 1000)")
def g3b(spark, sf):
    return G.count_groups(words(spark, sf), 1000)


@query("g4_top_features", f"{FT} SELECT feat, CAST(sum(value) AS BIGINT) AS value FROM ft GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def g4(spark, sf):
    return G.top_features(words(spark, sf), 20)


@query("g5_scan", f"{FT} SELECT group_id, feat, group_norm FROM ft WHERE feat IN ('the', 'of', 'de') AND value > 2")
def g5(spark, sf):
    return G.scan(words(spark, sf), ["group_id", "feat", "group_norm"], ["the", "of", "de"], "value > 2")


@query("g6_dense", f"{FT} SELECT g.group_id, f.feat, coalesce(group_norm, 0) AS group_norm FROM (SELECT DISTINCT group_id FROM ft) g CROSS JOIN (SELECT DISTINCT feat FROM ft WHERE feat <> 'the') f LEFT JOIN ft USING (group_id, feat)")
def g6(spark, sf):
    return G.dense(words(spark, sf), blacklist=spark.createDataFrame([("the",)], "feat string"))


@query("g7_sparse_rows", f"{FT} SELECT group_id, count(*) AS n, string_agg(feat || '=' || CAST(value AS VARCHAR), ' ' ORDER BY feat) AS features FROM ft GROUP BY 1")
def g7(spark, sf):
    m = G.sparse_rows(words(spark, sf), "value")
    text = F.array_join(F.transform(F.map_entries("features"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long"))), " ")
    return m.select("group_id", F.size("features").cast("long").alias("n"), text.alias("features"))


@query("g7_sparse_columns", f"{FT} SELECT feat, count(*) AS n, string_agg(group_id || '=' || CAST(value AS VARCHAR), ' ' ORDER BY group_id) AS groups FROM ft GROUP BY 1")
def g7b(spark, sf):
    m = G.sparse_columns(words(spark, sf), "value")
    text = F.array_join(F.transform(F.map_entries("groups"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long"))), " ")
    return m.select("feat", F.size("groups").cast("long").alias("n"), text.alias("groups"))


MOMENTS = "n AS (SELECT count(DISTINCT group_id) AS n FROM ft), m AS (SELECT feat, sum(group_norm) / n AS mean, sqrt(greatest(sum(group_norm * group_norm) / n - (sum(group_norm) / n) ** 2, 0)) AS std FROM ft, n GROUP BY feat, n)"


@query("g9_feature_norms_with_zeros", f"{FT}, {MOMENTS} SELECT g.group_id, m.feat, round((coalesce(group_norm, 0) - mean) / std, 5) AS feat_norm FROM (SELECT DISTINCT group_id FROM ft) g CROSS JOIN m LEFT JOIN ft USING (group_id, feat) WHERE std > 1e-12")
def g9(spark, sf):
    ft = words(spark, sf)
    return _rounded(G.with_feature_norms(R.with_feature_norms(ft), R.feature_means(ft)), "feat_norm", digits=5).where("feat_norm IS NOT NULL")


@query(
    "g10_paired_t_test",
    f"""WITH a AS (SELECT * FROM {features_sql(1, 'role', source='conversations')}), b AS (SELECT * FROM {features_sql(1, "'user'", source='conversations')} UNION ALL SELECT 'assistant', feat, value, group_norm FROM {features_sql(1, "'x'", source='conversations')}),
    g AS (SELECT DISTINCT group_id FROM a WHERE group_id IN (SELECT group_id FROM b)), f AS (SELECT DISTINCT feat FROM a WHERE feat IN (SELECT feat FROM b)),
    p AS (SELECT feat, coalesce(a.group_norm, 0) AS x, coalesce(b.group_norm, 0) AS y FROM g CROSS JOIN f LEFT JOIN a USING (group_id, feat) LEFT JOIN b USING (group_id, feat)),
    s AS (SELECT feat, avg(x - y) AS md, stddev_pop(x - y) AS sd, stddev_pop(x) AS sx, sqrt(avg((x - y) ** 2)) AS qd, sqrt(avg(x * x)) AS qx, avg(y) - avg(x) AS up, count(*) AS "N" FROM p GROUP BY 1)
    SELECT feat, round(CASE WHEN sd > 1e-5 * qd THEN md / (sd / sqrt("N")) END, 4) AS t, round(CASE WHEN sx > 1e-5 * qx THEN up / sx END, 4) AS d, "N" FROM s""",
)
def g10(spark, sf):
    a = words(spark, sf, "role", "conversations")
    t = table(spark, sf, "conversations")
    one = lambda g: R.combined(words_of(spark, t, g))
    b = R.combined(one("user"), one("assistant"))
    out = G.paired_t_test(a, b)
    return out.select("feat", F.round("t", 4).alias("t"), F.round("d", 4).alias("d"), "N")


def words_of(spark, t, name):
    from lingmill.operators.extract import add_ngrams

    rows = t.select(F.lit(name).alias("g"), F.concat_ws("_", "conv_id", "turn").alias("mid"), "text")
    return add_ngrams(rows, 1, "g", "mid", "text")


@query(
    "g11_top_messages",
    f"WITH ft AS (SELECT * FROM {features_sql(1, 'doc_id')}) SELECT feat, r AS rank, ft2.group_id, group_norm, text AS message FROM (SELECT *, row_number() OVER (PARTITION BY feat ORDER BY group_norm DESC, group_id) AS r FROM ft) ft2 JOIN documents ON ft2.group_id = doc_id WHERE r <= 2",
)
def g11(spark, sf):
    return G.top_messages(words(spark, sf, "doc_id"), table(spark, sf, "documents"), "doc_id", "text", 2)


@query("g12_word_counts", f"{FT} SELECT group_id, CAST(sum(value) AS BIGINT) AS words FROM ft GROUP BY 1")
def g12(spark, sf):
    return G.word_counts(words(spark, sf))


@query("s18_wide_export", f"{FT} SELECT group_id, " + ", ".join(f"coalesce(max(CASE WHEN feat = '{w}' THEN group_norm END), 0) AS \"{w}\"" for w in ("the", "of", "de")) + " FROM ft GROUP BY 1")
def s18(spark, sf):
    return G.wide(words(spark, sf), ["the", "of", "de"])


@query(
    "s11_groups_and_outcomes",
    f"""WITH ft AS (SELECT * FROM {features_sql(1, 'doc_id')}) SELECT group_id, max(CASE WHEN feat = 'the' THEN value ELSE 0 END)::DOUBLE AS the, max(CASE WHEN feat = 'of' THEN value ELSE 0 END)::DOUBLE AS of, any_value(quality) AS outcome_quality, any_value(n_chars) AS cntrl_n_chars
    FROM ft JOIN labels l ON l.doc_id = group_id JOIN documents d ON d.doc_id = group_id GROUP BY 1""",
)
def s11(spark, sf):
    o = table(spark, sf, "labels").select(F.col("doc_id").alias("group_id"), F.col("quality").alias("outcome_quality"))
    c = table(spark, sf, "documents").select(F.col("doc_id").alias("group_id"), F.col("n_chars").alias("cntrl_n_chars"))
    return G.wide(words(spark, sf, "doc_id"), ["the", "of"], "value").join(o, "group_id").join(c, "group_id")


@query("o4_contingency", f"{FT}, ok AS (SELECT group_id FROM ft GROUP BY 1 HAVING sum(value) > 500) SELECT group_id, coalesce(max(CASE WHEN feat = 'the' THEN group_norm END), 1e-7) AS the, coalesce(max(CASE WHEN feat = 'idiot' THEN group_norm END), 1e-7) AS idiot FROM ft WHERE group_id IN (SELECT group_id FROM ok) GROUP BY 1")
def o4(spark, sf):
    return G.contingency(words(spark, sf), ["the", "idiot"], min_sum=500)


@query("a27_z_scores", f"{FT}, {MOMENTS} SELECT group_id, feat, group_norm, round((group_norm - mean) / std, 5) AS z FROM ft JOIN m USING (feat) WHERE std > 1e-12")
def a27(spark, sf):
    return _rounded(G.group_z_scores(words(spark, sf)).where("z IS NOT NULL").drop("mean", "std"), "z", digits=5)


# ---- refinement ------------------------------------------------------------------------------------------------------


@query("r1_occurrence_filter", f"{FT} SELECT * FROM ft WHERE lower(feat) IN (SELECT lower(feat) FROM ft GROUP BY 1 HAVING count(*) >= round_even((SELECT count(DISTINCT group_id) FROM ft) * 0.3, 0))")
def r1(spark, sf):
    return R.occurrence_filter(words(spark, sf), 0.3)


@query("r1_occurrence_filter_by_document", f"WITH ft AS (SELECT * FROM {features_sql(1, 'doc_id')}) SELECT * FROM ft WHERE lower(feat) IN (SELECT lower(feat) FROM ft GROUP BY 1 HAVING count(*) >= round_even((SELECT count(DISTINCT group_id) FROM ft) * 0.05, 0) AND sum(value) >= 100)")
def r1b(spark, sf):
    return R.occurrence_filter(stored(words(spark, sf, "doc_id")), 0.05, min_sum=100)


@query("r2_combine", f"SELECT * FROM {features_sql(1)} UNION ALL SELECT * FROM {features_sql(2)}")
def r2(spark, sf):
    return R.combined(words(spark, sf), words(spark, sf, n=2))


PMI = """t AS (SELECT sum(value) AS total FROM w), k AS (SELECT feat AS word, sum(value) AS wf FROM w GROUP BY 1), j AS (SELECT feat, sum(value) AS freq, list_transform(TOKENS, lambda x: substring(x, 1, 36)) AS ws FROM ft GROUP BY 1),
    e AS (SELECT feat, freq, len(ws) AS length, unnest(ws) AS word FROM j WHERE len(ws) > 1), p AS (SELECT feat, freq, length, log2(freq / total) - coalesce(sum(log2(wf / total)), 0) AS pmi FROM e LEFT JOIN k USING (word), t GROUP BY feat, freq, length, total)"""


def _pmi_sql() -> str:
    from lingmill.queries.base import tokens_sql

    return PMI.replace("TOKENS", tokens_sql("feat", False))


@query("r3_pmi_filter", f"{FT2}, {_pmi_sql()} SELECT ft.* FROM ft LEFT JOIN p USING (feat) WHERE p.feat IS NULL OR pmi > (length - 1) * 3.0")
def r3(spark, sf):
    return R.pmi_filter(words(spark, sf, n=2), words(spark, sf), 3.0)


@query("r4_pmi", f"{FT2}, {_pmi_sql()} SELECT feat, CAST(freq AS BIGINT) AS freq, round(pmi, 6) AS pmi, length, round(pmi / (length - 1), 6) AS pmi_by_length FROM p")
def r4(spark, sf):
    return _rounded(R.collocation_pmi(words(spark, sf, n=2), words(spark, sf)), "pmi", "pmi_by_length", digits=6).withColumn("length", F.col("length").cast("long"))


@query(
    "r5_collocation_scores",
    f"""{FT2}, t AS (SELECT sum(value) AS total FROM w), k AS (SELECT feat AS word, sum(value) AS wf FROM w GROUP BY 1), u AS (SELECT feat, sum(value) AS c, count(*) AS g FROM ft GROUP BY 1),
    e AS (SELECT feat, c, string_split(feat, ' ') AS ws FROM u WHERE c > 1 AND contains(feat, ' ')), x AS (SELECT feat, c, len(ws) AS k, unnest(ws) AS word FROM e),
    s AS (SELECT feat, k, ln(c / total) AS joint, ln(c / total) - sum(ln(wf / total)) AS pmi FROM x LEFT JOIN k USING (word), t GROUP BY feat, k, c, total HAVING count(wf) = k)
    SELECT feat, CAST(c AS BIGINT) AS count, round(pmi, 6) AS pmi, round(pmi / (k - 1), 6) AS pmi_filter_val, round(pmi / -joint, 6) AS npmi, round(pmi / -joint / (k - 1), 6) AS npmi_filter_val, CASE WHEN c > 1 THEN round(g / (SELECT count(DISTINCT group_id) FROM ft), 6) END AS pocc FROM u LEFT JOIN s USING (feat)""",
)
def r5(spark, sf):
    return _rounded(R.collocation_scores(words(spark, sf, n=2), words(spark, sf)), "pmi", "pmi_filter_val", "npmi", "npmi_filter_val", "pocc", digits=6)


@query("r6_tf_idf", f"{FT}, d AS (SELECT feat, count(DISTINCT group_id) AS df FROM ft GROUP BY 1) SELECT group_id, feat, value, round(group_norm * ln((SELECT count(DISTINCT group_id) FROM ft) / df), 9) AS group_norm FROM ft JOIN d USING (feat)")
def r6(spark, sf):
    return _rounded(R.tf_idf(words(spark, sf)), "group_norm", digits=9)


@query("r7_standardise", f"{FT}, {MOMENTS} SELECT g.group_id, m.feat, round((coalesce(group_norm, 0) - mean) / CASE WHEN std > 1e-12 THEN std ELSE 1 END, 5) AS value, round((coalesce(group_norm, 0) - mean) / CASE WHEN std > 1e-12 THEN std ELSE 1 END, 5) AS group_norm FROM (SELECT DISTINCT group_id FROM ft) g CROSS JOIN m LEFT JOIN ft USING (group_id, feat)")
def r7(spark, sf):
    return _rounded(R.standardised(words(spark, sf)), "value", "group_norm", digits=5)


@query("r8_feature_norms", f"{FT}, {MOMENTS} SELECT group_id, feat, value, group_norm, round(CASE WHEN std > 1e-12 THEN (group_norm - mean) / std END, 5) AS feat_norm FROM ft JOIN m USING (feat)")
def r8(spark, sf):
    return _rounded(R.with_feature_norms(words(spark, sf)), "feat_norm", digits=5)


@query("r8_means", f"{FT}, {MOMENTS} SELECT feat, round(mean, 9) AS mean, round(std, 8) AS std, round(CASE WHEN std > 1e-12 THEN -mean / std END, 5) AS zero_feat_norm FROM m")
def r8b(spark, sf):
    m = R.feature_means(words(spark, sf))
    return m.select("feat", F.round("mean", 9).alias("mean"), F.round("std", 8).alias("std"), F.round("zero_feat_norm", 5).alias("zero_feat_norm"))


@query(
    "r9_by_outcome",
    f"""WITH ft AS (SELECT * FROM {features_sql(1, 'doc_id')}), o AS (SELECT doc_id AS group_id, quality AS o FROM labels WHERE doc_id IN (SELECT group_id FROM ft)), n AS (SELECT o, count(*) AS n FROM o GROUP BY 1),
    s AS (SELECT o, feat, sum(value) AS value, sum(group_norm) AS s, sum(group_norm * group_norm) AS ss FROM ft JOIN o USING (group_id) GROUP BY 1, 2)
    SELECT o AS group_id, feat, CAST(value AS BIGINT) AS value, value / sum(value) OVER (PARTITION BY o) AS group_norm, round(sqrt(greatest(ss / n - (s / n) ** 2, 0)), 7) AS std_dev, n FROM s JOIN n USING (o)""",
)
def r9(spark, sf):
    return _rounded(R.by_outcome(stored(words(spark, sf, "doc_id", groups=_labels(spark, sf))), _labels(spark, sf), "quality"), "std_dev")


def _labels(spark, sf):
    return table(spark, sf, "labels").withColumnRenamed("doc_id", "group_id")


@query(
    "r10_by_outcome_with_control",
    f"""WITH ft AS (SELECT * FROM {features_sql(1, 'doc_id')}), o AS (SELECT doc_id AS group_id, quality AS o, toxic AS c FROM labels WHERE doc_id IN (SELECT group_id FROM ft)), n AS (SELECT o, c, count(*) AS n FROM o GROUP BY 1, 2),
    s AS (SELECT o, c, feat, sum(value) AS value, sum(group_norm) AS s, sum(group_norm * group_norm) AS ss FROM ft JOIN o USING (group_id) GROUP BY 1, 2, 3), p AS (SELECT o, feat, value, s / n AS m, ss / n - (s / n) ** 2 AS v, n FROM s JOIN n USING (o, c))
    SELECT o AS group_id, feat, avg(value) AS value, round(avg(m), 9) AS group_norm, round(sqrt(greatest(avg(v) + avg(m * m) - avg(m) ** 2, 0)), 6) AS std_dev, CAST(sum(n) AS BIGINT) AS n FROM p GROUP BY 1, 2 HAVING count(*) = (SELECT count(DISTINCT c) FROM n)""",
)
def r10(spark, sf):
    out = R.by_outcome_with_control(stored(words(spark, sf, "doc_id", groups=_labels(spark, sf))), _labels(spark, sf), "quality", "toxic")
    return out.withColumns({"group_norm": F.round("group_norm", 9), "std_dev": F.round("std_dev", 6)})


@query("r11_regroup", f"WITH ft AS (SELECT * FROM {features_sql(1, 'doc_id')}) SELECT group_id, feat, value, value / sum(value) OVER (PARTITION BY group_id) AS group_norm FROM (SELECT lang AS group_id, feat, CAST(sum(value) AS BIGINT) AS value FROM ft JOIN documents ON doc_id = group_id WHERE lang IS NOT NULL GROUP BY 1, 2)")
def r11(spark, sf):
    members = table(spark, sf, "documents").select(F.col("doc_id").alias("group_id"), F.col("lang").alias("new_group"))
    return R.regrouped(words(spark, sf, "doc_id"), members)


@query("r12_bins")
def r12(spark, sf):
    nation = table(spark, sf, "customer")
    sizes = nation.groupBy(F.col("c_nationkey").alias("group_id")).agg(F.count("*").alias("n"))
    by = nation.groupBy(F.col("c_nationkey").alias("group_id"), F.col("c_mktsegment").alias("feat")).agg(F.count("*").alias("value"))
    ft = by.join(sizes, "group_id").select("group_id", "feat", "value", (F.col("value") / F.col("n")).alias("group_norm"), F.lit(0.1).alias("std_dev"))
    return R.binned(ft, sizes, 5)


@query(
    "r13_interpolation",
    """WITH p AS (SELECT user_id AS group_id, event_type AS feat, CAST(floor(date_diff('day', CAST((SELECT min(ts) FROM events) AS DATE), CAST(ts AS DATE)) / 2) AS INTEGER) AS t, avg(value) AS y FROM events GROUP BY 1, 2, 3),
    k AS (SELECT *, lead(t) OVER w AS t2, lead(y) OVER w AS y2, count(*) OVER (PARTITION BY group_id, feat) AS k FROM p WINDOW w AS (PARTITION BY group_id, feat ORDER BY t)),
    g AS (SELECT group_id, feat, t, y, t2, y2, unnest(range(t, coalesce(t2, t + 1))) AS time FROM k WHERE k >= 3),
    r AS (SELECT group_id, CAST(time AS INTEGER) AS time, feat, CASE WHEN t2 IS NULL THEN y ELSE y + (y2 - y) * (time - t) / (t2 - t) END AS group_norm FROM g)
    SELECT group_id, time, feat, round(group_norm, 6) AS group_norm FROM r WHERE group_norm <> 0 UNION ALL SELECT DISTINCT group_id, time, '_2dInter', 1.0 FROM r WHERE group_norm <> 0""",
)
def r13(spark, sf):
    series = table(spark, sf, "events").select(F.col("user_id").alias("group_id"), "ts", F.col("event_type").alias("feat"), F.col("value").cast("double").alias("group_norm"))
    return _rounded(R.interpolated(series, 2, 3), "group_norm", digits=6)


@query(
    "r15_archetypes",
    """WITH x AS (SELECT vec_id, label, unnest(range(len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT d, avg(x) AS m FROM x GROUP BY 1), a AS (SELECT 'A' || label AS arch, d, avg(x) AS a FROM x WHERE label < 3 GROUP BY 1, 2)
    SELECT vec_id AS group_id, arch AS feat, CAST(round_even(sum((x - m) * (a - m)) / sqrt(sum((x - m) ** 2) * sum((a - m) ** 2)), 0) AS INTEGER) AS value, round(sum((x - m) * (a - m)) / sqrt(sum((x - m) ** 2) * sum((a - m) ** 2)), 6) AS group_norm FROM x JOIN m USING (d) JOIN a USING (d) GROUP BY 1, 2""",
)
def r15(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    ft = e.select(F.col("vec_id").alias("group_id"), F.col("d").cast("string").alias("feat"), F.col("x").alias("value"), F.col("x").alias("group_norm"))
    arch = e.where("label < 3").groupBy(F.concat(F.lit("A"), "label").alias("group_id"), F.col("d").cast("string").alias("feat")).agg(F.avg("x").alias("group_norm"))
    return _rounded(R.archetype_similarity(ft, arch), "group_norm", digits=6)
