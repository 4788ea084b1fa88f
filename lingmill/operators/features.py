"""Scans, sums and matrices over a feature table (group_id, feat, value, group_norm).

Zeros aren't stored; only dense() and wide() write them. Statistics elsewhere use the number of groups instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lingmill.functions.special import p_of_t


def word_counts(words: DataFrame) -> DataFrame:
    """(group_id, words): the sum of values of a 1-gram table by group."""
    return words.groupBy("group_id").agg(F.sum("value").alias("words"))


def eligible_groups(words: DataFrame, threshold: int) -> DataFrame:
    """Groups with at least so many words."""
    return word_counts(words).where(F.col("words") >= threshold).select("group_id")


def within(ft: DataFrame, groups: DataFrame | None) -> DataFrame:
    return ft if groups is None else ft.join(groups, "group_id", "left_semi")


def feature_counts(ft: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """In how many groups each feature is."""
    return within(ft, groups).groupBy("feat").agg(F.count("*").alias("n_groups"))


def value_sums(ft: DataFrame, by: str | None = None, where: str | None = None) -> DataFrame:
    """Sum of values by feat, by group_id or over all."""
    rows = ft.where(where) if where else ft
    return rows.groupBy(*([by] if by else [])).agg(F.sum("value").alias("value"))


def distinct_features(ft: DataFrame) -> DataFrame:
    return ft.select("feat").distinct()


def distinct_groups(messages: DataFrame, group: str) -> DataFrame:
    return messages.where(F.col(group).isNotNull()).select(F.col(group).alias("group_id")).distinct()


def count_groups(words: DataFrame, threshold: int = 0) -> DataFrame:
    return eligible_groups(words, threshold).agg(F.count("*").alias("n"))


def top_features(ft: DataFrame, n: int) -> DataFrame:
    """The n features of the largest sums, ties by name: Spark keeps n rows a task, no full sort."""
    return value_sums(ft, "feat").orderBy(F.desc("value"), "feat").limit(n)


def scan(ft: DataFrame, columns: list[str], feats: list[str] | DataFrame | None = None, where: str | None = None) -> DataFrame:
    """Columns of rows, of given features: a short list is a pushed filter, a DataFrame with `feat` a semi join."""
    rows = ft.where(where) if where else ft
    if isinstance(feats, DataFrame):
        rows = rows.join(feats.select("feat").distinct(), "feat", "left_semi")
    elif feats is not None:
        rows = rows.where(F.col("feat").isin(feats))
    return rows.select(*columns)


def dense(ft: DataFrame, groups: DataFrame | None = None, column: str = "group_norm", blacklist: DataFrame | None = None) -> DataFrame:
    """(group_id, feat, column) for every group and feature, zeros written out."""
    if blacklist is not None:
        ft = ft.join(blacklist.select("feat").distinct(), "feat", "left_anti")
    groups = ft.select("group_id").distinct() if groups is None else groups.select("group_id").distinct()
    every = groups.crossJoin(ft.select("feat").distinct())
    return every.join(ft.select("group_id", "feat", column), ["group_id", "feat"], "left").select("group_id", "feat", F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias(column))


def sparse_rows(ft: DataFrame, column: str = "group_norm") -> DataFrame:
    """One row a group: its features and their numbers, as a map."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("feat", F.col(column).cast("double").alias("x")))))
    return ft.groupBy("group_id").agg(entries.alias("features"))


def sparse_columns(ft: DataFrame, column: str = "group_norm") -> DataFrame:
    """One row a feature: its groups and their numbers, as a map."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("group_id", F.col(column).cast("double").alias("x")))))
    return ft.groupBy("feat").agg(entries.alias("groups"))


def wide(ft: DataFrame, feats: list[str], column: str = "group_norm", prefix: str = "") -> DataFrame:
    """One row a group, one column for each of the named features, absent ones 0. One aggregate, no scan for the names."""
    cell = lambda f: F.coalesce(F.max(F.when(F.col("feat") == f, F.col(column).cast("double"))), F.lit(0.0)).alias(prefix + f)
    return ft.groupBy("group_id").agg(*[cell(f) for f in feats])


def with_feature_norms(ft: DataFrame, means: DataFrame) -> DataFrame:
    """feat_norm of all groups and features; an absent pair has its feature's zero_feat_norm."""
    every = ft.select("group_id").distinct().crossJoin(means.select("feat", "zero_feat_norm"))
    return every.join(ft.select("group_id", "feat", "feat_norm"), ["group_id", "feat"], "left").select("group_id", "feat", F.coalesce("feat_norm", "zero_feat_norm").alias("feat_norm"))


def paired_t_test(a: DataFrame, b: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Of each feature of both tables over their common groups: paired t, one-tailed p, d and N.

    Absent pairs are zeros of the closed forms; spreads are those of the population; d is the mean of b's numbers as
    z-scores of a's. t is null where all differences are alike: where they spread by less than 1e-5 of their size.
    """
    a, b = within(a, groups), within(b, groups)
    common = a.select("group_id").distinct().join(b.select("group_id").distinct(), "group_id")
    feats = a.select("feat").distinct().join(b.select("feat").distinct(), "feat")
    side = lambda t, name: within(t, common).join(feats, "feat", "left_semi").select("group_id", "feat", F.col("group_norm").cast("double").alias(name))
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    sums = side(a, "x").join(side(b, "y"), ["group_id", "feat"], "full").groupBy("feat").agg(
        F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), F.sum(y).alias("sy"), F.sum(x - y).alias("sd"), F.sum((x - y) * (x - y)).alias("sdd")
    )
    n = common.agg(F.count("*").alias("N"))
    s = sums.crossJoin(F.broadcast(n))
    mean = F.col("sd") / F.col("N")
    spread = lambda squares, m: F.when(squares - m * m > squares * F.lit(1e-10), F.sqrt(squares - m * m))
    t = mean / (spread(F.col("sdd") / F.col("N"), mean) / F.sqrt("N"))
    d = (F.col("sy") - F.col("sx")) / F.col("N") / spread(F.col("sxx") / F.col("N"), F.col("sx") / F.col("N"))
    return s.select("feat", t.alias("t"), d.alias("d"), "N").withColumn("p_1tail", p_of_t("t", F.col("N") - 1) / 2)


def top_messages(ft: DataFrame, messages: DataFrame, message_id: str, message: str, k: int, lexicon: DataFrame | None = None, groups: DataFrame | None = None, words: int = 15) -> DataFrame:
    """The k messages of the highest norm of each feature; with a lexicon (term, category, weight), its top words too."""
    order = W.partitionBy("feat").orderBy(F.desc("group_norm"), "group_id")
    top = within(ft, groups).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = top.join(messages.select(F.col(message_id).alias("group_id"), F.col(message).alias("message")), "group_id")
    out = out.select("feat", "rank", "group_id", "group_norm", "message")
    if lexicon is None:
        return out
    labels = topic_labels(lexicon, words).withColumnsRenamed({"category": "feat", "label": "words"})
    return out.join(labels, "feat", "left")


def topic_labels(lexicon: DataFrame, k: int, weighted: bool = True) -> DataFrame:
    """(category, label): the k terms of the highest weight of each category, joined."""
    order = W.partitionBy("category").orderBy(*([F.desc("weight")] if weighted else []), "term")
    top = lexicon.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ").alias("label"))


def joined_lines(ft: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(group_id, line): '<group> en ' and every feature as often as its value, spaces in it as underscores."""
    rows = ft if keep is None else ft.join(keep.select("feat").distinct(), "feat", "left_semi")
    part = F.array_join(F.array_repeat(F.replace("feat", F.lit(" "), F.lit("_")), F.col("value").cast("int")), " ")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("feat", part.alias("part")))), lambda x: x["part"])
    return rows.where("value >= 1").groupBy("group_id").agg(F.array_join(parts, " ").alias("line")).select("group_id", F.concat(F.col("group_id").cast("string"), F.lit(" en "), F.col("line")).alias("line"))


def contingency(ft: DataFrame, feats: list[str], zero: float = 1e-7, min_sum: float | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Groups by named features; an absent pair has a small number. min_sum: groups whose values sum to more."""
    rows = within(ft, groups)
    if min_sum is not None:
        rows = within(rows, rows.groupBy("group_id").agg(F.sum("value").alias("s")).where(F.col("s") > min_sum).select("group_id"))
    cell = lambda f: F.coalesce(F.max(F.when(F.col("feat") == f, F.col("group_norm"))), F.lit(zero)).alias(f)
    return rows.groupBy("group_id").agg(*[cell(f) for f in feats])


def group_z_scores(ft: DataFrame, n_groups: Column | None = None) -> DataFrame:
    """z of each stored norm against its feature's mean and spread over all groups, zeros included."""
    n = ft.select("group_id").distinct().agg(F.count("*").alias("n"))
    by = ft.groupBy("feat").agg(F.sum("group_norm").alias("s"), F.sum(F.col("group_norm") * F.col("group_norm")).alias("ss"))
    mean = F.col("s") / F.col("n")
    moments = by.crossJoin(F.broadcast(n)).select("feat", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))
    z = F.when(F.col("std") > 1e-12, (F.col("group_norm") - F.col("mean")) / F.col("std"))
    return ft.join(moments, "feat").select("group_id", "feat", "group_norm", "mean", "std", z.alias("z"))
