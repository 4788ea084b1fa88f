"""Queries of feature extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingmill.functions.tokenize import tokenize
from lingmill.operators import extract as E
from lingmill.queries.base import features_sql, grams_sql, query, stored, table, tokens_sql

DOCS = {"group": "source", "message_id": "doc_id", "message": "text"}


def _ngrams(n: int, group: str):
    @query(f"f1_ngrams_{n}" + ("" if group == "source" else "_by_document"), f"SELECT * FROM {features_sql(n, group)}")
    def f1(spark, sf):
        return E.add_ngrams(table(spark, sf, "documents"), n, group, "doc_id", "text")


for _n in (1, 2, 3):
    _ngrams(_n, "source")
_ngrams(1, "doc_id")


@query(
    "f1_ngrams_min_freq_sqrt",
    f"SELECT group_id, feat, value, round(sqrt(group_norm), 9) AS group_norm FROM {features_sql(2)} WHERE value >= 3",
)
def f1_min(spark, sf):
    return E.add_ngrams(table(spark, sf, "documents"), 2, **DOCS, min_freq=3, transform="sqrt").withColumn("group_norm", F.round("group_norm", 9))


@query(
    "f2_meta_features",
    f"""WITH m AS (SELECT source AS group_id, {tokens_sql('text')} AS toks FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
    g AS (SELECT group_id, list_transform(range(1, len(toks)), lambda i: substring(array_to_string(toks[i:i + 1], ' '), 1, 70)) AS g FROM m),
    b AS (SELECT group_id, sum(coalesce(list_sum(list_transform(g, lambda x: length(x))), 0) + coalesce(length(g[len(g)]), 0)) AS chars, sum(len(g)) AS grams, count(*) AS messages FROM g GROUP BY group_id)
    SELECT group_id, feat, value, value AS group_norm FROM (
      SELECT group_id, '_avg2gramLength' AS feat, chars / grams AS value FROM b WHERE grams > 0 UNION ALL SELECT group_id, '_avg2gramsPerMsg', grams / messages FROM b WHERE grams > 0
      UNION ALL SELECT group_id, '_total2grams', CAST(grams AS DOUBLE) FROM b WHERE grams > 0 UNION ALL SELECT group_id, '_totalMsgs', CAST(messages AS DOUBLE) FROM b WHERE grams > 0)""",
)
def f2(spark, sf):
    return E.meta_features(table(spark, sf, "documents"), 2, **DOCS)


@query("f3_ngrams_from_tokens", f"SELECT * FROM {features_sql(2, 'conv_id', source='conversations', tokens=tokens_sql('text', False))}")
def f3(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", F.concat_ws("_", "conv_id", "turn").alias("mid"), F.to_json(tokenize(F.col("text"))).alias("message"))
    return E.add_ngrams_from_tokens(t, 2, "conv_id", "mid", "message")


CHARS_SQL = r"list_transform(list_filter(string_split(lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\s*\n\s*', ' <NEWLINE> ', 'g'), '\s*\n\s*', ' <NEWLINE> ', 'g'), '\s\s+', ' ', 'g'), '\.{5,}', '....', 'g'))), ''), lambda c: c <> ''), lambda c: trim(c))"


@query("f4_char_ngrams_3", f"SELECT * FROM {features_sql(3, tokens=CHARS_SQL)}")
def f4(spark, sf):
    return E.add_char_ngrams(table(spark, sf, "documents"), 3, **DOCS)


@query("f5_collocations")
def f5(spark, sf):
    return E.add_collocations(table(spark, sf, "documents"), ["of the", "in the", "de la", "of the the", "idiot the"], **DOCS)


@query("f9_topic_features", f"""SELECT group_id, feat, value, value / sum(value) OVER (PARTITION BY group_id) AS group_norm FROM (
    SELECT source AS group_id, CAST(topic AS VARCHAR) AS feat, count(*) AS value FROM (SELECT source, length(unnest({tokens_sql('text', False)})) % 10 AS topic FROM documents WHERE source IS NOT NULL) GROUP BY 1, 2)""")
def f9(spark, sf):
    topics = F.transform(tokenize(F.col("text")), lambda t: F.struct((F.length(t) % 10).alias("topic_id"), t.alias("term")))
    return E.add_topic_features(table(spark, sf, "documents").withColumn("topics", topics), "source", "doc_id")


@query("f10_phrases")
def f10(spark, sf):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    parse = F.concat(F.lit("(S (NP "), F.array_join(F.slice(words, 1, 2), " "), F.lit(") (VP "), F.array_join(F.slice(words, 3, 1 << 20), " "), F.lit("))"))
    return E.add_phrases(table(spark, sf, "conversations").select("role", F.concat_ws("_", "conv_id", "turn").alias("mid"), parse.alias("parse")), "role", "mid", "parse")


NAMES_SQL = f"""WITH d AS (SELECT source, {tokens_sql('text')} AS toks FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
firsts AS (SELECT DISTINCT t FROM (SELECT unnest(toks) AS t FROM d) WHERE length(t) = 6), lasts AS (SELECT DISTINCT t FROM (SELECT unnest(toks) AS t FROM d) WHERE length(t) = 8),
common AS (SELECT DISTINCT t FROM (SELECT unnest(toks) AS t FROM d) WHERE starts_with(t, 't')),
g AS (SELECT source AS group_id, substring(array_to_string(toks[i:i + n - 1], ' '), 1, least((36 - (n - 1)) * n, 255)) AS feat FROM (SELECT source, toks, n, unnest(range(1, len(toks) - n + 2)) AS i FROM d, (SELECT unnest([2, 3, 4]) AS n))),
k AS (SELECT group_id, feat, count(*) AS value FROM g WHERE string_split(feat, ' ')[1] IN (SELECT t FROM firsts) AND string_split(feat, ' ')[-1] IN (SELECT t FROM lasts)
  AND NOT (string_split(feat, ' ')[1] IN (SELECT t FROM common) AND string_split(feat, ' ')[-1] IN (SELECT t FROM common)) GROUP BY 1, 2),
tot AS (SELECT source AS group_id, sum(greatest(len(toks) - 1, 0)) AS total FROM d GROUP BY 1)
SELECT group_id, feat, value, value / total AS group_norm FROM k JOIN tot USING (group_id)"""


@query("f11_names", NAMES_SQL)
def f11(spark, sf):
    docs = table(spark, sf, "documents")
    words = stored(E.token_rows(docs, "source", "doc_id", "text").select(F.explode("tokens").alias("term")).distinct())
    return E.add_names(docs, words.where(F.length("term") == 6), words.where(F.length("term") == 8), words.where(F.col("term").startswith("t")), **DOCS)


@query("f12_embedding_features", "SELECT label AS group_id, CAST(dim AS VARCHAR) || 'me' AS feat, round(avg(x), 6) AS value, round(avg(x), 6) AS group_norm FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS dim FROM embeddings WHERE label IS NOT NULL) GROUP BY label, dim")
def f12(spark, sf):
    return E.add_embeddings(table(spark, sf, "embeddings"), "label").withColumns({c: F.round(c, 6) for c in ("value", "group_norm")})


def _readability_sql() -> str:
    from lingmill.functions import text as X
    from lingmill.queries.texts import GRADE_SQL, URL_SQL

    plain = f"(SELECT doc_id, replace(replace(regexp_replace(regexp_replace(text, '{X.XML_TAG}', ' ', 'g'), {URL_SQL}, ' ', 'g'), '..', '.'), '..', '.') AS text FROM documents)"
    grades = GRADE_SQL.replace("FROM documents", f"FROM {plain}").replace(", 6) AS grade", ", 12) AS grade")
    return f"SELECT source AS group_id, 'm_fk_score' AS feat, round(avg(grade), 5) AS value, round(avg(grade), 5) AS group_norm FROM ({grades}) JOIN documents USING (doc_id) WHERE source IS NOT NULL GROUP BY 1"


@query("f13_readability", _readability_sql())
def f13(spark, sf):
    return E.add_readability(table(spark, sf, "documents"), **DOCS).withColumns({c: F.round(c, 5) for c in ("value", "group_norm")})


@query("f14_concepts")
def f14(spark, sf):
    graph = {"word": ["unit"], "article": ["word", "marker"], "marker": [], "unit": []}
    rows = E.concept_probabilities(graph, {"the": ["article"], "of": ["word"], "and": ["word", "marker"]})
    return E.add_concepts(E.add_ngrams(table(spark, sf, "documents"), 1, **DOCS), spark.createDataFrame(rows, "word string, concept string, share double"))


TAG_SQL = "CASE WHEN length(w) > 6 THEN 'NN' WHEN length(w) > 3 THEN 'VB' ELSE 'DT' END"


@query(
    "f15_pos",
    rf"""SELECT group_id, feat, value, value / sum(value) OVER (PARTITION BY group_id) AS group_norm FROM (SELECT source AS group_id, {TAG_SQL} AS feat, count(*) AS value
    FROM (SELECT source, unnest(regexp_extract_all(text, '[\p{{L}}]+')) AS w FROM documents WHERE source IS NOT NULL) GROUP BY 1, 2)""",
)
def f15(spark, sf):
    tag = lambda w: F.concat(w, F.when(F.length(w) > 6, F.lit("/NN")).when(F.length(w) > 3, F.lit("/VB")).otherwise(F.lit("/DT")))
    tagged = F.array_join(F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0)), tag), " ")
    return E.add_pos(table(spark, sf, "documents").withColumn("text", tagged), **DOCS)


@query(
    "f16_outcome_features",
    "SELECT c_custkey AS group_id, feat, value, value AS group_norm FROM (SELECT c_custkey, 'c_acctbal' AS feat, CAST(c_acctbal AS DOUBLE) AS value FROM customer UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer) WHERE value IS NOT NULL",
)
def f16(spark, sf):
    return E.add_outcomes_as_features(table(spark, sf, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"])


@query(
    "f17_timex",
    """WITH d AS (SELECT l_linestatus AS group_id, l_returnflag AS tag, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) - 60 AS DOUBLE) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    w AS (SELECT group_id, avg(x) AS "meanOffset", avg(abs(x)) AS "abs_meanOffset", avg(ln(abs(x) + 1)) AS "log_meanOffset", avg(CASE WHEN x > 0 THEN ln(x + 1) ELSE 0 END) AS "pos_log_meanOffset",
      avg(CASE WHEN x < 0 THEN ln(1 - x) ELSE 0 END) AS "neg_log_meanOffset", avg(CASE WHEN abs(x) < 0.000694 THEN 1.0 ELSE 0 END) AS offset_is_zero, stddev_pop(x) AS "stdOffset", CAST(count(*) AS DOUBLE) AS "numTimexes" FROM d GROUP BY 1),
    t AS (SELECT group_id, 'ttag:' || tag AS feat, count(*) AS n FROM d GROUP BY 1, 2)
    SELECT group_id, feat, round(value, 6) AS value, round(value, 6) AS group_norm FROM (UNPIVOT w ON COLUMNS(* EXCLUDE group_id) INTO NAME feat VALUE value)
    UNION ALL SELECT group_id, feat, CAST(n AS DOUBLE), round(n / sum(n) OVER (PARTITION BY group_id), 6) FROM t""",
)
def f17(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    rows = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("l_linestatus", (F.date_diff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")) - 60).cast("double").alias("days"), F.col("l_returnflag").alias("tag"))
    return E.add_timex(rows, "l_linestatus").withColumns({c: F.round(c, 6) for c in ("value", "group_norm")})


@query(
    "f19_ner",
    f"""WITH t AS (SELECT source AS group_id, w, CASE WHEN regexp_matches(w, '^[A-Z]') THEN CASE WHEN length(w) > 6 THEN 'PERSON' ELSE 'PLACE' END ELSE 'O' END AS ner FROM (SELECT source, unnest(regexp_extract_all(text, '[\\p{{L}}]+')) AS w FROM documents WHERE source IS NOT NULL)),
    tot AS (SELECT group_id, count(*) AS total FROM t GROUP BY 1)
    SELECT group_id, feat, value, value / total AS group_norm FROM (SELECT group_id, feat, count(*) AS value FROM (SELECT group_id, unnest([ner, lower(w), ner || ':' || lower(w)]) AS feat FROM t WHERE ner <> 'O') GROUP BY 1, 2) JOIN tot USING (group_id)""".replace("\\\\p", "\\p"),
)
def f19(spark, sf):
    w = table(spark, sf, "documents").where("source IS NOT NULL").select("source", F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("term"))
    kind = F.when(F.col("term").rlike("^[A-Z]"), F.when(F.length("term") > 6, F.lit("PERSON")).otherwise(F.lit("PLACE"))).otherwise(F.lit("O"))
    return E.add_ner(w.withColumn("ner", kind), "source")


__all__ = ["DOCS", "grams_sql"]
