"""The corpus pipeline: language identification, near duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes what a stage returns as
Parquet in the shared folder and gives it to the next as its docs. All stages but the last return the columns of docs.

A document goes if language identification rejects it (it has no letters, or doesn't look like any language of the
corpus), if its n-gram set is connected by pairs of Jaccard 0.5 or more to a document with a lesser doc_id, or if it
has a passage of the benchmark. Null or empty texts have no language and go in the first stage; rows that repeat a
doc_id are one document; empty tables give an empty result; columns of any name stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lingmill.llm import decontam, langid, ngram_join, packing
from lingmill.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

#: Naive Bayes over hashed n-grams and shortest-pack-first aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
