"""Registration, table access and SQL that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lingmill.functions.tokenize import EMOTICON, TOKEN
from lingmill.operators.kernel import scratch, stored  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Java's \s: DuckDB's has no vertical tab.
SHRUNK = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '\s*\n\s*', ' <NEWLINE> ', 'g'), '\s\s+', ' ', 'g'), '\.{{5,}}', '....', 'g'))"


def tokens_sql(text: str, shrink: bool = True) -> str:
    text = SHRUNK.format(SHRUNK_ONCE.format(text)) if shrink else text
    return f"list_transform(regexp_extract_all({text}, {quoted(TOKEN)}), lambda t: CASE WHEN regexp_matches(t, {quoted(EMOTICON)}) THEN t ELSE lower(t) END)"


SHRUNK_ONCE = r"regexp_replace({0}, '\s*\n\s*', ' <NEWLINE> ', 'g')"


def grams_sql(n: int, group: str = "source", text: str = "text", source: str = "documents", tokens: str | None = None, length: int | None = None) -> str:
    """SQL of rows (group_id, doc, feat): every n-gram of every message."""
    from lingmill.functions.tokenize import feature_length

    keep = feature_length(n) if length is None else length
    toks = tokens or tokens_sql(text)
    rows = f"(SELECT {group} AS group_id, {toks} AS toks FROM {source} WHERE {group} IS NOT NULL AND {text} IS NOT NULL)"
    if n == 1:
        return f"(SELECT group_id, substring(w, 1, {keep}) AS feat FROM (SELECT group_id, unnest(toks) AS w FROM {rows}))"
    gram = " || ' ' || ".join(["w", *[f"lead(w, {k}) OVER o" for k in range(1, n)]])
    return f"""(SELECT group_id, substring({gram}, 1, {keep}) AS feat
      FROM (SELECT d, group_id, unnest(toks) AS w, unnest(range(len(toks))) AS i FROM (SELECT *, row_number() OVER () AS d FROM {rows}))
      WINDOW o AS (PARTITION BY d ORDER BY i) QUALIFY lead(w, {n - 1}) OVER o IS NOT NULL)"""


def features_sql(n: int, group: str = "source", **kw) -> str:
    """SQL of an n-gram feature table."""
    return f"""(SELECT group_id, feat, value, value / sum(value) OVER (PARTITION BY group_id) AS group_norm
      FROM (SELECT group_id, feat, count(*) AS value FROM {grams_sql(n, group, **kw)} GROUP BY group_id, feat))"""


def words(spark: SparkSession, sf_dir: str, group: str = "source", name: str = "documents", n: int = 1, groups: DataFrame | None = None) -> DataFrame:
    """The n-gram table of documents or conversations by a group; of the documents with a group in `groups` alone, if given."""
    from pyspark.sql import functions as F

    from lingmill.operators.extract import add_ngrams

    t = table(spark, sf_dir, name)
    if groups is not None:
        t = t.join(groups.select(F.col("group_id").alias(group)).distinct(), group, "left_semi")
    if name == "conversations":
        return add_ngrams(t.withColumn("mid", F.concat_ws("_", "conv_id", "turn")), n, group, "mid", "text")
    return add_ngrams(t, n, group, "doc_id", "text")
