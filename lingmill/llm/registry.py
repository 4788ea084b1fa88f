"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingmill.llm import ann, chat, decontam, kneser_ney, langid, ngram_join, packing, tokens, urls, warc
from lingmill.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
  FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2
), e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE shared / (na.n + nb.n - shared) >= 0.5 - 1e-12
), r AS (
  SELECT a AS doc_id, a AS far FROM (SELECT DISTINCT a FROM e) UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.far
), c AS (SELECT doc_id, min(far) AS class_id FROM r GROUP BY doc_id),
l AS (SELECT a AS doc_id, count(*) AS links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(l.links, 0) AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
"""


@query("op3_ngram_jaccard_join", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH bw AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS win
  FROM (SELECT item_id, ws, least(len(ws), 8) AS size, unnest(range(1, greatest(len(ws) - 8, 0) + 2)) AS i FROM
    (SELECT item_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+') AS ws FROM benchmark) WHERE len(ws) > 0)
), pieces AS (
  SELECT doc_id, unnest(ps) AS piece, unnest(range(len(ps))) AS k
  FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+') AS ps FROM documents)
), placed AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) AS stop FROM pieces
), dw AS (
  SELECT doc_id, list(lower(strip_accents(piece)) ORDER BY k) AS ws, list(stop - length(piece) ORDER BY k) AS starts, list(stop ORDER BY k) AS stops
  FROM placed WHERE regexp_matches(piece, '^[\\p{L}\\p{N}]') GROUP BY doc_id
), win AS (
  SELECT doc_id, size, starts[i] AS start, stops[i + size - 1] AS stop, array_to_string(ws[i:i + size - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - size + 1, 0) + 1)) AS i FROM dw, (SELECT DISTINCT size FROM bw))
)
SELECT doc_id, item_id, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS "end", count(*) AS windows
FROM win JOIN bw USING (size, win) GROUP BY doc_id, item_id
"""


@query("op5_benchmark_decontamination", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


@query("op1_warc")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


OP4_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, turn, role, text,
    coalesce(string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '') OVER o, '') AS context,
    count(*) OVER o AS context_turns
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), e AS (
  SELECT conv_id, turn, context_turns, context || '<|assistant|>' || chr(10) AS prompt, text || '<|end|>' || chr(10) AS target
  FROM c WHERE role = 'assistant' AND text <> ''
)
SELECT *, length(prompt) AS train_start, length(prompt) + length(target) AS train_end FROM e
"""


@query("op4_chat_formatting", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.expand(table(spark, sf_dir, "conversations"))


@query("op8_nearest_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op9_url_filter")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.filtered(pages, urls.fit(pages))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


@query("op6_kneser_ney_perplexity")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return kneser_ney.perplexity(docs, kneser_ney.fit(docs))
