"""Queries of lexica: scoring and algebra.

The lexicon is made of the words of `benchmark`: category L<length>, weight 1 / length, one wildcard a category of the
first three letters of its first word of four or more, and an intercept.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lingmill.operators import features as G
from lingmill.operators import lexicon as L
from lingmill.queries.base import features_sql, query, table, words

BASE_SQL = r"SELECT DISTINCT w AS term, 'L' || length(w) AS category, 1.0::DOUBLE / length(w) AS weight FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark)"
LEX_SQL = f"""base AS ({BASE_SQL}), lex AS (SELECT * FROM base UNION ALL SELECT left(min(term), 3) || '*', category, 0.5 FROM base WHERE length(term) >= 4 GROUP BY category)"""
CATS_SQL = """ws AS (SELECT DISTINCT feat, lower(feat) AS term FROM ft), cats AS (SELECT feat, category, max(weight) AS weight FROM (
    SELECT feat, category, weight FROM ws JOIN lex USING (term) UNION ALL
    SELECT feat, category, weight FROM ws JOIN (SELECT rtrim(term, '*') AS prefix, category, weight FROM lex WHERE term LIKE '%*') p ON left(ws.term, 3) = p.prefix AND length(ws.term) >= 3) GROUP BY 1, 2)"""
FT_SQL = f"WITH ft AS (SELECT * FROM {features_sql(1)}), {LEX_SQL}, {CATS_SQL}"
INTERCEPTS = "UNION ALL SELECT DISTINCT group_id, '_intercept', 1, 1.0 FROM ft"


def lexicon(spark, sf, wild: bool = True):
    base = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("term")).distinct()
    base = base.select("term", F.concat(F.lit("L"), F.length("term")).alias("category"), (F.lit(1.0) / F.length("term")).alias("weight"))
    if not wild:
        return base
    more = base.where(F.length("term") >= 4).groupBy("category").agg(F.concat(F.substring(F.min("term"), 1, 3), F.lit("*")).alias("term"))
    return base.unionByName(more.select("term", "category", F.lit(0.5).alias("weight")))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 7) for c in columns})


@query("f6_weighted_lexicon", f"{FT_SQL} SELECT group_id, category AS feat, sum(value) AS value, round(sum(weight * group_norm), 7) AS group_norm FROM ft JOIN cats USING (feat) GROUP BY 1, 2 {INTERCEPTS}")
def f6(spark, sf):
    return _rounded(L.lexicon_features(words(spark, sf), lexicon(spark, sf)), "group_norm")


@query("f6_unweighted_lexicon_sqrt", f"{FT_SQL} SELECT group_id, category AS feat, sum(value) AS value, round(sqrt(sum(group_norm)), 7) AS group_norm FROM ft JOIN cats USING (feat) GROUP BY 1, 2 {INTERCEPTS}")
def f6b(spark, sf):
    return _rounded(L.lexicon_features(words(spark, sf), lexicon(spark, sf), weighted=False, transform="sqrt"), "group_norm")


@query(
    "f6_lexicon_with_intercept",
    f"""{FT_SQL}, s AS (SELECT group_id, category AS feat, sum(value) AS value, sum(weight * group_norm) AS x FROM ft JOIN cats USING (feat) GROUP BY 1, 2),
    i AS (SELECT DISTINCT group_id, 'L5' AS feat, 0.25 AS c FROM ft UNION ALL SELECT DISTINCT group_id, 'ONLY', -2.0 FROM ft)
    SELECT group_id, feat, coalesce(value, 0) AS value, round(coalesce(x, 0) + coalesce(c, 0), 7) AS group_norm FROM s FULL JOIN i USING (group_id, feat)""",
)
def f6c(spark, sf):
    more = spark.createDataFrame([("_intercept", "L5", 0.25), ("_intercept", "ONLY", -2.0)], "term string, category string, weight double")
    return _rounded(L.lexicon_features(words(spark, sf), lexicon(spark, sf).unionByName(more)), "group_norm")


@query("f6_lexicon_normalised", f"{FT_SQL} SELECT group_id, feat, sum(value) AS value, round(sum(weight * value / total), 7) AS group_norm FROM (SELECT group_id, category AS feat, value, weight, sum(value) OVER (PARTITION BY group_id, category) AS total FROM ft JOIN cats USING (feat)) GROUP BY 1, 2 {INTERCEPTS}")
def f6d(spark, sf):
    return _rounded(L.lexicon_features(words(spark, sf), lexicon(spark, sf), normalise="lexicon"), "group_norm")


@query("f6_multicategory_normalised", f"{FT_SQL}, tot AS (SELECT group_id, sum(value) AS total FROM ft WHERE feat IN (SELECT feat FROM cats) GROUP BY 1) SELECT group_id, category AS feat, sum(value) AS value, round(sum(weight * value / total), 7) AS group_norm FROM ft JOIN cats USING (feat) JOIN tot USING (group_id) GROUP BY 1, 2 {INTERCEPTS}")
def f6e(spark, sf):
    return _rounded(L.lexicon_features(words(spark, sf), lexicon(spark, sf), normalise="multicategory"), "group_norm")


@query("f7_corpus_weights", f"{FT_SQL} SELECT feat AS term, category, round(avg(group_norm) * min(weight), 7) AS weight FROM ft JOIN cats USING (feat) GROUP BY 1, 2")
def f7(spark, sf):
    return _rounded(L.corpus_weights(words(spark, sf), lexicon(spark, sf)), "weight")


@query("t19_word_list", f"{FT_SQL} SELECT DISTINCT feat FROM cats WHERE category IN ('L5', 'L7')")
def t19(spark, sf):
    return L.word_list(lexicon(spark, sf), words(spark, sf), ["L5", "L7"])


@query("x1_lexicon", f"WITH {LEX_SQL} SELECT term, category, max(weight) AS weight FROM lex GROUP BY 1, 2")
def x1(spark, sf):
    return L.prepared(lexicon(spark, sf))


OTHER_SQL = "SELECT term, CASE WHEN length(term) > 6 THEN 'L5' ELSE category END AS category, weight * 2 AS weight FROM base WHERE length(term) <> 4"


def _other(spark, sf):
    return lexicon(spark, sf, False).where("length(term) <> 4").select("term", F.when(F.length("term") > 6, "L5").otherwise(F.col("category")).alias("category"), (F.col("weight") * 2).alias("weight"))


@query("x2_union", f"WITH base AS ({BASE_SQL}) SELECT term, category, max(weight) AS weight FROM (SELECT * FROM base UNION ALL {OTHER_SQL}) GROUP BY 1, 2")
def x2(spark, sf):
    return L.union(lexicon(spark, sf, False), _other(spark, sf))


@query("x2_intersection", f"WITH base AS ({BASE_SQL}), o AS ({OTHER_SQL}) SELECT * FROM base SEMI JOIN o USING (term, category)")
def x2b(spark, sf):
    return L.intersect(lexicon(spark, sf, False), _other(spark, sf))


@query("x3_depolarised", f"WITH base AS ({BASE_SQL}) SELECT term, category FROM base")
def x3(spark, sf):
    sign = F.when(F.length("term") % 2 == 0, "+").otherwise("-")
    return L.depolarised(lexicon(spark, sf, False).select("term", F.concat("category", sign).alias("category")))


@query("x3_ungrouped", f"WITH base AS ({BASE_SQL}) SELECT term, term || '_' || upper(category) AS category, weight FROM base")
def x3b(spark, sf):
    return L.ungrouped(lexicon(spark, sf, False))


@query("x3_randomised")
def x3c(spark, sf):
    return L.randomised(lexicon(spark, sf, False))


@query("x4_from_corpus", r"SELECT w AS term, 'CORPUS' AS category, count(*) AS weight FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM documents) WHERE w <> '' GROUP BY 1 HAVING count(*) >= 100")
def x4(spark, sf):
    return L.from_corpus(table(spark, sf, "documents"), "doc_id", "text", 100)


@query(
    "x5_tagged",
    rf"""WITH {LEX_SQL}, d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_'']+') AS ws FROM documents), c AS (SELECT doc_id, len(ws) AS words, unnest(ws) AS w FROM d),
    n AS (SELECT doc_id, words, w, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT DISTINCT term FROM lex)
    SELECT doc_id AS message_id, term, words, sum(n) AS n FROM (SELECT doc_id, words, term, n FROM n JOIN t ON w = term UNION ALL SELECT doc_id, words, term, n FROM n JOIN (SELECT * FROM t WHERE term LIKE '%*') p ON left(w, 3) = rtrim(term, '*') AND length(w) >= 3) GROUP BY 1, 2, 3""",
)
def x5(spark, sf):
    return L.tagged(table(spark, sf, "documents"), lexicon(spark, sf), "doc_id", "text").withColumn("words", F.col("words").cast("long"))


@query("x6_examples", r"SELECT doc_id, text FROM documents WHERE regexp_matches(text, '(?i)\bidiot\w*\b')")
def x6(spark, sf):
    return L.examples(table(spark, sf, "documents"), r"(?i)\bidiot\w*\b", "doc_id", "text")


@query("x7_expanded", f"WITH base AS ({BASE_SQL}) SELECT * FROM base UNION SELECT term || 's', category, weight FROM base WHERE length(term) = 5")
def x7(spark, sf):
    lex = lexicon(spark, sf, False)
    return L.expanded(lex, lex.where("length(term) = 5").select("term", F.concat("term", F.lit("s")).alias("relative")))


@query(
    "x8_compared",
    f"""WITH base AS ({BASE_SQL}), o AS ({OTHER_SQL}), a AS (SELECT category, count(*) AS n, sum(weight) AS w FROM base GROUP BY 1), b AS (SELECT category, count(*) AS n, sum(weight) AS w FROM o GROUP BY 1),
    s AS (SELECT base.category AS category_a, o.category AS category_b, count(*) AS n, sum(least(base.weight, o.weight)) AS low FROM base JOIN o USING (term) GROUP BY 1, 2)
    SELECT category_a, category_b, round(s.n / (a.n + b.n - s.n), 7) AS jaccard, round(low / (a.w + b.w - low), 7) AS weighted_jaccard FROM s JOIN a ON category_a = a.category JOIN b ON category_b = b.category""",
)
def x8(spark, sf):
    return _rounded(L.compared(lexicon(spark, sf, False), _other(spark, sf)), "jaccard", "weighted_jaccard")


@query("x9_columns", f"WITH base AS ({BASE_SQL}) SELECT category, string_agg(term, ', ' ORDER BY term) AS terms FROM base GROUP BY 1")
def x9(spark, sf):
    return L.columns_by_category(lexicon(spark, sf, False))


@query("l6_super_topics", f"WITH base AS ({BASE_SQL}) SELECT term, 'S' || (CAST(category[2:] AS INTEGER) + k) % 3 AS category, round(sum(weight * (k + 1)), 7) AS weight FROM base, (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2")
def l6(spark, sf):
    lex = lexicon(spark, sf, False)
    n = F.substring("category", 2, 9).cast("int")
    reduced = lex.select("category", n.alias("n")).distinct().crossJoin(spark.range(2)).select(F.col("category").alias("term"), F.concat(F.lit("S"), (F.col("n") + F.col("id")) % 3).alias("category"), (F.col("id") + 1).cast("double").alias("weight"))
    return _rounded(L.super_topics(reduced, lex), "weight")


@query("r16_topic_labels", f"WITH base AS ({BASE_SQL}) SELECT category, string_agg(term, ' ' ORDER BY r) AS label FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY weight DESC, term) AS r FROM base) WHERE r <= 5 GROUP BY 1")
def r16(spark, sf):
    return G.topic_labels(lexicon(spark, sf, False), 5)


@query("o7_label_map", f"{FT_SQL} SELECT group_id, coalesce(l.label, ft.feat) AS feat, value FROM ft LEFT JOIN (SELECT term AS feat, category AS label FROM base) l USING (feat)")
def o7(spark, sf):
    labels = lexicon(spark, sf, False).select(F.col("term").alias("category"), F.col("category").alias("label"))
    return L.mapped_labels(words(spark, sf).select("group_id", "feat", "value"), labels)
