"""Queries of the text functions and of message-level operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lingmill.functions import text as X
from lingmill.functions import transforms as V
from lingmill.functions.tokenize import TOKEN, tokenize
from lingmill.operators import messages as M
from lingmill.operators.lexicon import categories_of
from lingmill.queries.base import SHRUNK, SHRUNK_ONCE, query, stored, quoted, table, tokens_sql


@query("t1_newlines", rf"SELECT doc_id, {SHRUNK_ONCE.format('text')} AS text FROM documents")
def t1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.mark_newlines(F.col("text")).alias("text"))


@query("t2_shrink_space", f"SELECT doc_id, {SHRUNK.format('text')} AS text FROM documents")
def t2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.shrink_space(F.col("text")).alias("text"))


WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"


@query("t3_non_ascii", rf"SELECT doc_id, array_to_string(list_transform({WORDS.format('text')}, lambda w: CASE WHEN regexp_matches(w, '[^\x15-\x7e]') THEN '<UNICODE>' ELSE w END), ' ') AS text FROM documents")
def t3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.mask_non_ascii(F.col("text")).alias("text"))


@query("t4_normalise_space", f"SELECT doc_id, array_to_string({WORDS.format('text')}, ' ') AS text FROM documents")
def t4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalise_space(F.col("text")).alias("text"))


@query("t5_tokens", f"SELECT doc_id, array_to_string({tokens_sql('text', False)}, chr(10)) AS tokens FROM documents")
def t5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(tokenize(F.col("text")), "\n").alias("tokens"))


@query("t6_entities")
def t6(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.decode_entities(F.col("html")).alias("html"))


@query("t7_hex_escapes", r"SELECT conv_id, turn, regexp_replace(text || '\x41b', '\\x[0-9a-fA-F]{1,4}', ' ', 'g') AS text FROM conversations")
def t7(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.remove_hex_escapes(F.concat("text", F.lit(r"\x41b"))).alias("text"))


@query("t8_lower_case", f"SELECT token, count(*) AS n FROM (SELECT unnest({tokens_sql('text', False)}) AS token FROM conversations) GROUP BY token")
def t8(spark, sf):
    return table(spark, sf, "conversations").select(F.explode(tokenize(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("t9_retweets")
def t9(spark, sf):
    parts = X.retweet_parts(F.concat(F.lit("so true RT @some_one: "), "text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", parts["retweeted"].alias("retweeted"), parts["comment"].alias("comment"))


URL_SQL = quoted(X.URL)


@query("t10_markers", f"SELECT page_id, regexp_replace(regexp_replace(url || ' @some_one ' || html, '{X.USER}', '<USER>', 'g'), {URL_SQL}, '<URL>', 'g') AS text FROM pages")
def t10(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.replace_urls(F.concat("url", F.lit(" @some_one "), "html")).alias("text"))


@query(
    "t11_excluded_tokens",
    f"SELECT token, regexp_matches(token, {quoted(X.EXCLUDED)}) AS excluded, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {quoted(TOKEN)})) AS token FROM documents) GROUP BY token",
)
def t11(spark, sf):
    tokens = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n")).withColumn("excluded", X.is_excluded(F.col("token")))


@query("t12_sentence_normalisation")
def t12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalise_sentence(F.col("text")).alias("text"))


@query(
    "t13_plain_text",
    f"SELECT page_id, replace(replace(regexp_replace(regexp_replace(html, '{X.XML_TAG}', ' ', 'g'), {URL_SQL}, ' ', 'g'), '..', '.'), '..', '.') AS text FROM pages",
)
def t13(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.shorten_dots(X.remove_urls(X.remove_xml(F.col("html")))).alias("text"))


GRADE_SQL = r"""
SELECT doc_id, round(least(20.0, 0.39 * n / greatest(1, len(regexp_extract_all(text, '[.!?]+(?:\s|$)'))) + 11.8 * syl / n - 15.59), 6) AS grade
FROM (
  SELECT doc_id, text, len(ws) AS n,
    list_sum(list_transform(ws, lambda w: greatest(1, len(regexp_extract_all(regexp_replace(lower(w), '(?:[^l]e|es|ed)$', ''), '[aeiouyáéíóúàèùâêîôûäöü]+'))))) AS syl
  FROM (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}'']+') AS ws FROM documents)
) WHERE n > 0
"""


@query("t14_reading_grade", GRADE_SQL)
def t14(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(X.reading_grade(F.col("text")), 6).alias("grade")).where("grade IS NOT NULL")


@query("t15_json_tokens", f"SELECT conv_id, turn, array_to_string({tokens_sql('text', False)}, ' ') AS tokens, len({tokens_sql('text', False)}) AS n FROM conversations")
def t15(spark, sf):
    coded = table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(tokenize(F.col("text"))).alias("j"))
    back = F.from_json("j", "array<string>")
    return coded.select("conv_id", "turn", F.array_join(back, " ").alias("tokens"), F.size(back).cast("long").alias("n"))


@query(
    "t16_wildcard_match",
    f"""WITH w AS (SELECT DISTINCT unnest({tokens_sql('text', False)}) AS word FROM documents), p AS (SELECT DISTINCT lower(p_type[1:4]) AS prefix FROM part UNION SELECT DISTINCT lower(left(word, 4)) FROM w WHERE length(word) >= 9)
    SELECT word, count(*) AS patterns FROM w JOIN p ON starts_with(lower(word), prefix) WHERE length(prefix) >= 3 AND NOT contains(prefix, '*') GROUP BY word""",
)
def t16(spark, sf):
    words = stored(table(spark, sf, "documents").select(F.explode(tokenize(F.col("text"))).alias("feat")).distinct())
    parts = table(spark, sf, "part").select(F.lower(F.substring("p_type", 1, 4)).alias("prefix"))
    prefixes = parts.unionByName(words.where(F.length("feat") >= 9).select(F.lower(F.substring("feat", 1, 4)).alias("prefix"))).where(~F.col("prefix").contains("*")).distinct()
    lexicon = prefixes.select(F.concat("prefix", F.lit("*")).alias("term"), F.col("prefix").alias("category"), F.lit(1.0).alias("weight"))
    return categories_of(words, lexicon).groupBy(F.col("feat").alias("word")).agg(F.count("*").alias("patterns"))


@query(
    "t17_value_transforms",
    """SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS sqrt, round(ln(o_totalprice + 1), 6) AS log, round(log2(o_totalprice + 1), 6) AS log2, round(2 * sqrt(o_totalprice + 0.375), 6) AS anscombe, 1.0::DOUBLE AS boolean FROM orders""",
)
def t17(spark, sf):
    x = F.col("o_totalprice").cast("double")
    return table(spark, sf, "orders").select("o_orderkey", *[F.round(V.TRANSFORMS[n](x), 6).alias(n) for n in ("sqrt", "log", "log2", "anscombe")], V.TRANSFORMS["boolean"](x).alias("boolean"))


@query(
    "t18_censor",
    f"SELECT word, CASE word WHEN 'idiot' THEN 'i***t' WHEN 'pathetic' THEN 'p******c' WHEN 'worthless' THEN 'w*******s' ELSE word END AS shown, n FROM (SELECT unnest({tokens_sql('text', False)}) AS word, count(*) AS n FROM documents GROUP BY 1)",
)
def t18(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(tokenize(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.withColumn("shown", V.censored(F.col("word"), {"idiot": "i***t", "pathetic": "p******c", "worthless": "w*******s"}))


@query(
    "t20_colours",
    """WITH s AS (SELECT p_partkey, (p_retailprice - (SELECT min(p_retailprice) FROM part)) / ((SELECT max(p_retailprice) FROM part) - (SELECT min(p_retailprice) FROM part)) AS x, p_retailprice, (SELECT min(p_retailprice) FROM part) AS lo, (SELECT max(p_retailprice) FROM part) AS hi FROM part)
    SELECT p_partkey, CAST(floor((p_retailprice - lo) / (hi - lo) * 64) AS INTEGER) AS step, lower(lpad(hex(CAST(round(255 - floor((p_retailprice - lo) / (hi - lo) * 64) / 64 * 255) AS BIGINT)), 2, '0')) || '00' || lower(lpad(hex(CAST(round(floor((p_retailprice - lo) / (hi - lo) * 64) / 64 * 255) AS BIGINT)), 2, '0')) AS colour FROM s""",
)
def t20(spark, sf):
    part = table(spark, sf, "part").withColumn("price", F.col("p_retailprice").cast("double"))
    bounds = part.agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    step = V.rank_scale(F.col("price"), F.col("lo"), F.col("hi"), 64)
    return part.crossJoin(F.broadcast(bounds)).select("p_partkey", step.alias("step"), V.mix_colours("ff0000", "0000ff", step / F.lit(64.0)).alias("colour"))


# ---- messages --------------------------------------------------------------------------------------------------------


@query("m1_tokenise", f"SELECT conv_id, turn, role, array_to_string({tokens_sql('text', False)}, ' ') AS text FROM conversations")
def m1(spark, sf):
    return M.tokenized(table(spark, sf, "conversations"), "text").withColumn("text", F.array_join("text", " "))


@query(
    "m2_sentences",
    r"""SELECT doc_id || '_' || CASE WHEN i < 100 THEN lpad(CAST(i AS VARCHAR), 2, '0') ELSE CAST(i AS VARCHAR) END AS doc_id, s AS text FROM (
      SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\s*\n\s*', '. ', 'g'), '([.!?]+["'')\]]*)\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents))""",
)
def m2(spark, sf):
    rows = M.sentence_tokenized(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", per_row=True)
    n = F.element_at(F.split("doc_id", "_"), 2)
    return rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where(n.isNotNull())


@query("m4_not_yet_parsed", "SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def m4(spark, sf):
    return M.not_yet_parsed(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"), "doc_id")


@query(
    "m7_deduplicate",
    rf"""WITH t AS (SELECT source, doc_id, text, list_filter(regexp_extract_all(lower(text), {quoted(TOKEN)}), lambda x: NOT regexp_matches(x, '^[#@]') AND NOT regexp_matches(x, {quoted(X.EXCLUDED)})) AS ws
      FROM documents WHERE source IS NOT NULL AND trim(text) <> '' AND NOT regexp_matches(text, '(?i)\bRT\b[\s:]*@\w+|\bretweet(ed)?\b[\s:]*@\w+|\bvia\b\s*@\w+')),
    k AS (SELECT source, doc_id, text, array_to_string(CASE WHEN len(ws) >= 6 THEN ws[1:5] ELSE ws END, ' ') AS key FROM t)
    SELECT source, doc_id, text FROM k QUALIFY row_number() OVER (PARTITION BY source, key ORDER BY doc_id) = 1""",
)
def m7(spark, sf):
    return M.deduplicated(table(spark, sf, "documents").select("source", "doc_id", "text"), "source", "doc_id", "text")


@query("m8_anonymise", f"SELECT page_id, regexp_replace(regexp_replace(html, '{X.USER}', '<USER>', 'g'), {URL_SQL}, '<URL>', 'g') AS html FROM pages WHERE trim(html) <> ''")
def m8(spark, sf):
    return M.anonymized(table(spark, sf, "pages").select("page_id", "html"), "html")


SPAM = ["idiot", "pathetic", "worthless", "stupid"]
SPAM_SQL = " OR ".join(f"contains(text, '{w}')" for w in SPAM)


@query(
    "m9_spam_filter",
    f"WITH s AS (SELECT doc_id, source, CAST(({SPAM_SQL}) AS INTEGER) AS is_spam FROM documents) SELECT * FROM s WHERE source IN (SELECT source FROM s GROUP BY source HAVING avg(is_spam) < 0.05)",
)
def m9(spark, sf):
    return M.without_spam(table(spark, sf, "documents").select("doc_id", "source", "text"), "source", "text", SPAM, 0.05).drop("text")


COMMON = {"en": ("the", "of", "and"), "es": ("el", "que", "los"), "de": ("der", "die", "und"), "fr": ("le", "les", "des")}


def by_common_words(texts: list[str]) -> list[tuple[str, float]]:
    """The language of which a text has most common words (of equal ones the first by name), and their share."""
    found = []
    for words in (re.findall(r"[a-z]+", t.lower()) for t in texts):
        n = {k: sum(w in of for w in words) for k, of in sorted(COMMON.items())}
        best = max(n, key=lambda k: n[k])
        found.append((best, n[best] / max(sum(n.values()), 1)))
    return found


COMMON_SQL = ", ".join(f"len(list_filter(ws, lambda w: w IN ({', '.join(map(quoted, of))}))) AS {k}" for k, of in sorted(COMMON.items()))


@query(
    "m10_language_filter",
    f"""WITH n AS (SELECT doc_id, {COMMON_SQL} FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents)),
    k AS (SELECT doc_id, greatest(de, en, es, fr) / greatest(de + en + es + fr, 1) AS p, CASE greatest(de, en, es, fr) WHEN de THEN 'de' WHEN en THEN 'en' WHEN es THEN 'es' ELSE 'fr' END AS language FROM n)
    SELECT doc_id, CASE WHEN language = 'es' AND p < 0.95 OR language = 'en' AND p > 0.6 THEN 'en' ELSE language END AS language FROM k
    WHERE CASE WHEN language = 'es' AND p < 0.95 OR language = 'en' AND p > 0.6 THEN TRUE ELSE p > 0.8 AND language IN ('en', 'es') END""",
)
def m10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return M.in_languages(docs, by_common_words, ["en", "es"], "text", light_english=True).select("doc_id", "language")


@query("m11_words_by_group", "SELECT source AS group_id, sum(n) AS num_words FROM (SELECT source, doc_id, max(n_chars) AS n FROM documents WHERE source IS NOT NULL GROUP BY source, doc_id) GROUP BY source")
def m11(spark, sf):
    return M.words_by_group(table(spark, sf, "documents"), "source", "doc_id", "n_chars")


@query("m12_fetch", "SELECT doc_id, text, source FROM documents WHERE lang = 'en' AND n_chars > 100")
def m12(spark, sf):
    return M.fetch(table(spark, sf, "documents"), ["doc_id", "text", "source"], "lang = 'en' AND n_chars > 100")
