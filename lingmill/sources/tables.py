"""Files and databases in and out."""

from __future__ import annotations

import configparser
from dataclasses import asdict, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: What stands for null in CSV, beside cells that are empty without quotes ("" is the empty text): no characters that texts may have.
NULL = "\ufdd0null\ufdd0"


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",") -> DataFrame:
    """With a header; types are inferred in one more pass unless a schema is given."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').option("nullValue", NULL)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    """All values quoted with the white space at their ends (nulls as NULL), one file a partition."""
    writer = df.write.mode("append" if append else "overwrite").option("header", True).option("quoteAll", True).option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").option("nullValue", NULL).csv(path)


def read_database(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, partitions: int = 1, **options: str) -> DataFrame:
    """A table over JDBC (the driver's jar is the caller's); with a numeric key it is read in ranges."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=partitions)
    return reader.load()


def write_database(df: DataFrame, url: str, table: str, mode: str = "overwrite", **options: str) -> None:
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, **options).save()


def conversation_corpus(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """utterances.jsonl, speakers.json and conversations.json of a conversation corpus as flat tables."""
    u = spark.read.json(f"{folder}/utterances.jsonl")
    name = lambda *options: next((c for c in options if c in u.columns), None)
    picked = {"message_id": name("id"), "speaker": name("speaker", "user"), "conversation_id": name("conversation_id", "root"), "reply_to": name("reply_to", "reply-to"), "timestamp": name("timestamp"), "message": name("text")}
    meta = [F.col(f"meta.`{f.name}`").alias(f"meta_{f.name}") for f in u.schema["meta"].dataType.fields] if "meta" in u.columns and hasattr(u.schema["meta"].dataType, "fields") else []
    out = {"utterances": u.select(*[F.col(f"`{c}`").alias(k) for k, c in picked.items() if c], *meta)}
    for table, key in (("speakers", "speaker"), ("conversations", "conversation_id")):
        path = f"{folder}/{table}.json"
        try:
            text = spark.read.text(path, wholetext=True)
        except Exception as e:  # the file is optional
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        entries = text.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, "properties"))
        out[table] = entries.select(key, "properties")
    return out


def gzip_csv_messages(spark: SparkSession, path: str, id_at: int, message_at: int, group_at: int = -1) -> DataFrame:
    """(message_id, message, group_id) of a gzipped CSV without header, columns by their place, groups in upper case. All messages are read."""
    rows = spark.read.option("escape", "\\").option("multiLine", True).csv(path)
    at = lambda i: F.col(rows.columns[i])
    return rows.select(at(id_at).alias("message_id"), at(message_at).alias("message"), F.upper(at(group_at)).alias("group_id"))


# ---- lexica ----------------------------------------------------------------------------------------------------------


def lexicon_columns(spark: SparkSession, path: str) -> DataFrame:
    """A header of categories, their terms below."""
    rows = spark.read.option("header", True).csv(path)
    return rows.unpivot([], rows.columns, "category", "term").where("term IS NOT NULL AND trim(term) <> ''").select(F.trim("term").alias("term"), F.trim("category").alias("category"))


def lexicon_kept(spark: SparkSession, path: str) -> DataFrame:
    """Lines term,category,keep: those to keep."""
    rows = spark.read.csv(path).toDF("term", "category", "keep")
    return rows.where(F.lower(F.trim("keep")).isin("1", "y", "yes", "true")).select(F.trim("term").alias("term"), F.trim("category").alias("category"))


def lexicon_lines(spark: SparkSession, path: str, weighted: bool = False, sep: str = ",") -> DataFrame:
    """Lines term,...,category or term,...,category,weight: all terms before the category."""
    parts = F.transform(F.split("value", sep), lambda x: F.trim(x))
    rows = spark.read.text(path).where("trim(value) <> ''").select(parts.alias("p"))
    last = 2 if weighted else 1
    out = rows.where(F.size("p") > last).select(F.explode(F.slice("p", F.lit(1), F.size("p") - last)).alias("term"), F.element_at("p", -last).alias("category"), F.element_at("p", -1).cast("double").alias("weight"))
    out = out.where("term <> ''")
    return out if weighted else out.drop("weight")


def lexicon_dic(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary file: categories with numbers between lines of %, then terms with their categories' numbers; numbers in parentheses are left out."""
    text = spark.read.text(path, wholetext=True).select(F.split("value", r"(?m)^%\s*$").alias("s"))
    line = lambda i: text.select(F.explode(F.split(F.element_at("s", i), r"\r?\n")).alias("l")).where("trim(l) <> ''").select(F.split(F.trim("l"), r"\s+").alias("f"))
    names = line(2).select(F.element_at("f", 1).alias("k"), F.element_at("f", 2).alias("category"))
    terms = line(3).where(F.size("f") > 1).select(F.element_at("f", 1).alias("term"), F.explode(F.slice("f", F.lit(2), F.size("f") - 1)).alias("k"))
    return terms.where(~F.col("k").contains("(")).join(names, "k").select("term", "category").distinct()


def lexicon_map(spark: SparkSession, path: str) -> DataFrame:
    """Lines feature,label: a category of one term a feature, labels that repeat are numbered."""
    from pyspark.sql import Window as W

    rows = spark.read.csv(path).toDF("term", "category").select(F.trim("term").alias("term"), F.trim("category").alias("category")).distinct()
    k = F.row_number().over(W.partitionBy("category").orderBy("term"))
    return rows.withColumn("k", k).select("term", F.when(F.col("k") > 1, F.concat_ws("_", "category", "k")).otherwise(F.col("category")).alias("category"))


def topic_lines(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """Tab-separated lines topic, words...; weighted: word and weight by turns."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.element_at(f, 1).alias("category"), F.slice(f, F.lit(2), F.size(f)).alias("w"))
    return _paired(rows) if weighted else rows.select(F.explode("w").alias("term"), "category").where("trim(term) <> ''")


def topic_csv(spark: SparkSession, path: str, threshold: float | None = None, header: bool = True) -> DataFrame:
    """topic,word,weight,word,weight,...: words above a share of the topic's first weight, _ as a space."""
    f = F.split("value", ",")
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.element_at(f, 1).alias("category"), F.slice(f, F.lit(2), F.size(f)).alias("w"))
    if header:
        rows = rows.where("category <> 'topic_id'")
    out = rows.withColumn("first", F.try_element_at("w", F.lit(2)).cast("double"))
    out = _paired(out, "first").withColumn("term", F.replace("term", F.lit("_"), F.lit(" ")))
    return (out if threshold is None else out.where(F.col("weight") > F.col("first") * threshold)).drop("first")


def _paired(rows: DataFrame, *more: str) -> DataFrame:
    at = F.sequence(F.lit(1), F.size("w") - 1, F.lit(2))
    pairs = F.when(F.size("w") >= 2, F.transform(at, lambda i: F.struct(F.trim(F.element_at("w", i)).alias("term"), F.element_at("w", i + 1).cast("double").alias("weight"))))
    return rows.select("category", *more, F.explode(pairs).alias("p")).select("p.term", "category", "p.weight", *more).where("term <> ''")


# ---- results ---------------------------------------------------------------------------------------------------------


def write_lines(lines: DataFrame, path: str, column: str = "line") -> None:
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def dense_table(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Rows by named columns, missing cells the text NULL."""
    cell = lambda c: F.coalesce(F.first(F.when(F.col(column) == c, F.col(value).cast("string")), ignorenulls=True), F.lit("NULL")).alias(c)
    return df.groupBy(row).agg(*[cell(c) for c in sorted(columns)])


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def save_settings(settings, path: str) -> None:
    """A dataclass as an INI file."""
    config = configparser.ConfigParser(interpolation=None)
    config.optionxform = str
    config["constants"] = {k: str(v) for k, v in asdict(settings).items() if v is not None}
    with Path(path).open("w") as f:
        config.write(f)


def load_settings(kind, path: str):
    config = configparser.ConfigParser(interpolation=None)
    config.optionxform = str
    config.read(path)
    have = config["constants"]
    read = {"int": int, "float": float, "bool": lambda x: x == "True"}
    return kind(**{f.name: read.get(str(f.type), str)(have[f.name]) for f in fields(kind) if f.name in have})
