"""The relational kernel: scans, filters, groupings, writes and the catalog, as thin functions over DataFrames."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def select(df: DataFrame, *fields: str, where: list[str] = (), group_by: list[str] = (), order_by: list[tuple[str, str]] = (), limit: int | None = None, offset: int = 0, distinct: bool = False) -> DataFrame:
    """One SELECT from parts in SQL: several conditions are joined by AND, aggregates are named in fields."""
    rows = df.where(reduce(lambda a, b: a & b, [F.expr(w) for w in where])) if where else df
    if group_by:
        aggregates = [f for f in fields if f not in group_by]
        rows = rows.groupBy(*group_by).agg(*[F.expr(f) for f in aggregates]) if aggregates else rows.select(*group_by).distinct()
        made = iter(rows.columns[len(group_by) :] if aggregates else [])
        rows = rows.select(*[F.col(f"`{f if f in group_by else next(made)}`") for f in fields])
    elif fields:
        rows = rows.selectExpr(*fields)
    rows = rows.distinct() if distinct else rows
    if order_by:
        rows = rows.orderBy(*[F.col(c).desc() if way.upper() == "DESC" else F.col(c).asc() for c, way in order_by])
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def insert_values(spark: SparkSession, path: str, rows: list[tuple], schema: str) -> None:
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)


def insert_select(rows: DataFrame, path: str) -> None:
    """Appends rows to a Parquet table, in its columns' order and types."""
    target = rows.sparkSession.read.parquet(path)
    rows.select(*[F.col(f.name).cast(f.dataType) for f in target.schema]).write.mode("append").parquet(path)


def create_like(df: DataFrame, path: str, where: str | None = None) -> DataFrame:
    """A copy of a table's rows, or of those that a condition holds for; `false` copies the columns alone."""
    (df.where(where) if where else df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    return df.withColumn(name, F.lit(None).cast(kind))


def random_sample(df: DataFrame, share: float, key: list[str], seed: int = 42, where: str | None = None) -> DataFrame:
    """round(share * n) rows of the least seeded hashes of the key: the same rows whatever the partitions."""
    rows = df.where(where) if where else df
    n = rows.count()
    return rows.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(round(share * n))


def subset_by_key(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def updated(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """df with the columns that changes has for its key; a key that isn't in it stays as it is."""
    columns = [c for c in changes.columns if c != key]
    marked = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    rows = df.join(marked, key, "left")
    return rows.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns], *[F.col(f"__{c}").alias(c) for c in columns if c not in df.columns])


def split_by(df: DataFrame, column: str, path: str) -> None:
    """One folder for each value of a column."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def renamed(df: DataFrame, names: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in (keep or df.columns)])


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once: empty for a primary key."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def tables(spark: SparkSession, like: str | None = None, features: bool | None = None) -> list[str]:
    """Names in the catalog, by a LIKE pattern, feature tables or others."""
    pattern = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in like or "%"), re.I)
    names = [t.name for t in spark.catalog.listTables() if pattern.fullmatch(t.name)]
    return sorted(n for n in names if features is None or n.startswith("feat$") == features)


def described(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(name)]


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def viewed(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a local master may have one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lingmill-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """df as a table of its own, for what is used more than once: Spark doesn't see that two plans with lambdas are alike, and would make each anew."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
