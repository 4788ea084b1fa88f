"""Outcomes: scans, counts, and the analysis set as one long table (outcome, group_id, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def group_outcomes(table: DataFrame, group: str, outcome: str, where: str | None = None) -> DataFrame:
    """(group_id, y) where the outcome isn't null."""
    rows = table.where(where) if where else table
    return rows.where(F.col(group).isNotNull() & F.col(outcome).isNotNull()).select(F.col(group).alias("group_id"), F.col(outcome).alias("y"))


def value_counts(table: DataFrame, outcome: str, control: str | None = None, with_nulls: bool = False) -> DataFrame:
    """Rows by value of an outcome, or of an outcome and a control."""
    keys = [outcome] + ([control] if control else [])
    rows = table if with_nulls else table.dropna(subset=keys)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def numeric_columns(table: DataFrame, group: str) -> list[str]:
    """What * stands for."""
    return [f.name for f in table.schema if isinstance(f.dataType, T.NumericType) and f.name != group]


def long_outcomes(table: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Numeric outcomes unpivoted, without nulls. The group's first value counts where it repeats (the least)."""
    rows = table.where(F.col(group).isNotNull()).select(F.col(group).alias("group_id"), *[F.col(c).cast("double").alias(c) for c in columns])
    long = rows.unpivot(["group_id"], columns, "outcome", "y").where("y IS NOT NULL AND NOT isnan(y)")
    return long.groupBy("outcome", "group_id").agg(F.min("y").alias("y"))


def dummies(table: DataFrame, group: str, column: str) -> DataFrame:
    """0/1 outcomes <column>__<label> of each label, of the first only if there are two. Labels in lower case."""
    rows = table.where(F.col(group).isNotNull() & F.col(column).isNotNull()).select(F.col(group).alias("group_id"), F.lower(F.col(column).cast("string")).alias("label"))
    rows = rows.groupBy("group_id").agg(F.min("label").alias("label"))
    labels = rows.select("label").distinct()
    n = labels.agg(F.count("*").alias("n"), F.min("label").alias("first"))
    kept = labels.crossJoin(F.broadcast(n)).where("n <> 2 OR label = first").select(F.col("label").alias("of"))
    return rows.crossJoin(kept).select(F.concat(F.lit(f"{column}__"), F.col("of")).alias("outcome"), "group_id", (F.col("label") == F.col("of")).cast("double").alias("y"))


def multiclass(table: DataFrame, group: str, column: str) -> DataFrame:
    """Outcome <column>__multiclass: labels in lower case numbered from 0 in their order."""
    rows = table.where(F.col(group).isNotNull() & F.col(column).isNotNull()).select(F.col(group).alias("group_id"), F.lower(F.col(column).cast("string")).alias("label"))
    rows = rows.groupBy("group_id").agg(F.min("label").alias("label"))
    codes = rows.select("label").distinct().withColumn("y", (F.row_number().over(W.orderBy("label")) - 1).cast("double"))
    return rows.join(codes, "label").select(F.lit(f"{column}__multiclass").alias("outcome"), "group_id", "y")


def analysis_set(table: DataFrame, group: str, outcomes: list[str], categorical: list[str] = (), multi: list[str] = (), controls: list[str] = (), words: DataFrame | None = None, threshold: int = 0, groups: DataFrame | None = None, low_variance: float | None = 0.0, common: bool = False) -> DataFrame:
    """(outcome, group_id, y) of all outcomes, of groups that have enough words and all controls.

    Outcomes whose spread (population variance) is no more than low_variance go, and so do labels that none or all of
    the groups have. common: only groups that have every outcome left.
    """
    rows = table.dropna(subset=list(controls)) if controls else table
    parts = [long_outcomes(rows, group, list(outcomes))] if outcomes else []
    parts += [dummies(rows, group, c) for c in categorical] + [multiclass(rows, group, c) for c in multi]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if words is not None and threshold > 0:
        out = out.join(words.groupBy("group_id").agg(F.sum("value").alias("w")).where(F.col("w") >= threshold), "group_id", "left_semi")
    if groups is not None:
        out = out.join(groups.select("group_id"), "group_id", "left_semi")
    if low_variance is not None:
        steady = out.groupBy("outcome").agg(F.var_pop("y").alias("v")).where(F.col("v") > low_variance + 1e-15)
        out = out.join(steady, "outcome", "left_semi")
    if common:
        k = out.agg(F.count_distinct("outcome").alias("k"))
        all_ = out.groupBy("group_id").agg(F.count("*").alias("c")).crossJoin(F.broadcast(k)).where("c = k")
        out = out.join(all_, "group_id", "left_semi")
    return out.select("outcome", "group_id", "y")


def groups_per_outcome(analysis: DataFrame) -> DataFrame:
    return analysis.groupBy("outcome").agg(F.count("*").alias("n"))


def folds(analysis: DataFrame, k: int, stratified: bool = True, seed: int = 42, super_groups: bool = False) -> DataFrame:
    """(outcome, group_id, y, fold): dealt round robin in the order of y (then of the group), or of a seeded hash.

    super_groups: groups that share what precedes their first _ stay together, in the order of their least y.
    """
    key = F.element_at(F.split(F.col("group_id").cast("string"), "_"), 1) if super_groups else F.col("group_id").cast("string")
    rows = analysis.withColumn("__key", key)
    order = ["__y", "__key"] if stratified else [F.xxhash64("__key", F.lit(seed)), "__key"]
    keys = rows.groupBy("outcome", "__key").agg(F.min("y").alias("__y"))
    dealt = keys.withColumn("fold", ((F.row_number().over(W.partitionBy("outcome").orderBy(*order)) - 1) % k).cast("int")).drop("__y")
    return rows.join(dealt, ["outcome", "__key"]).select("outcome", "group_id", "y", "fold")
