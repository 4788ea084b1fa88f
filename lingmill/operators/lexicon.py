"""Lexica (term, category[, weight]): scoring of word tables and algebra.

A wildcard term ends in * and matches words that begin with what precedes it (three characters or more). Words meet
wildcards by equality of prefixes, so no join compares every word to every term. How a lexicon is joined is left to
Spark's size estimates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingmill.functions.tokenize import ngrams
from lingmill.functions.transforms import TRANSFORMS

INTERCEPT = "_intercept"


def prepared(lexicon: DataFrame, weighted: bool = True) -> DataFrame:
    """Trimmed, terms in lower case, one row a term and category (the greatest weight); zero weights go."""
    weight = F.col("weight").cast("double") if weighted and "weight" in lexicon.columns else F.lit(1.0)
    rows = lexicon.select(F.lower(F.trim("term")).alias("term"), F.trim("category").alias("category"), weight.alias("weight"))
    rows = rows.where("term IS NOT NULL AND category IS NOT NULL AND weight <> 0")
    return rows.groupBy("term", "category").agg(F.max("weight").alias("weight"))


def categories_of(feats: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(feat, category, weight) of distinct features; of several matches of a category the greatest weight."""
    words = feats.select("feat").distinct().withColumn("term", F.lower("feat"))
    wild = F.col("term").endswith("*")
    exact = words.join(lexicon.where(~wild), "term").select("feat", "category", "weight")
    patterns = lexicon.where(wild & (F.length("term") >= 4)).select(F.expr("substring(term, 1, length(term) - 1)").alias("prefix"), "category", "weight")
    # only prefixes as long as some pattern's
    lengths = patterns.agg(F.collect_set(F.length("prefix")).alias("lengths"))
    some = F.filter("lengths", lambda k: k <= F.length("term"))
    prefixes = words.where(F.length("term") >= 3).crossJoin(F.broadcast(lengths)).select("feat", F.explode(F.transform(some, lambda k: F.substring("term", F.lit(1), k))).alias("prefix"))
    matched = exact.unionByName(prefixes.join(patterns, "prefix").select("feat", "category", "weight"))
    return matched.groupBy("feat", "category").agg(F.max("weight").alias("weight"))


def lexicon_features(words: DataFrame, lexicon: DataFrame, weighted: bool = True, transform: str = "identity", feat_transform: str = "identity", normalise: str | None = None, add_intercept: bool = True) -> DataFrame:
    """Categories as features of a word table.

    value is the sum of values, group_norm f(sum of weight * f2(norm) + the category's intercept). normalise: "lexicon"
    takes a word's share of the words of its category for its norm, "multicategory" that of words of any category.
    Categories with an intercept have a row in every group; without intercepts each group gets the row _intercept.
    """
    lex = prepared(lexicon, weighted)
    constants = lex.where(F.col("term") == INTERCEPT).select(F.col("category").alias("feat"), F.col("weight").alias("constant"))
    of = categories_of(words, lex.where(F.col("term") != INTERCEPT))
    norm = F.col("group_norm")
    rows = words.select("group_id", "feat", "value", "group_norm").join(of, "feat")
    if normalise == "lexicon":
        totals = rows.groupBy("group_id", "category").agg(F.sum("value").alias("total"))
        rows, norm = rows.join(totals, ["group_id", "category"]), F.col("value") / F.col("total")
    elif normalise == "multicategory":
        any_ = words.join(of.select("feat").distinct(), "feat", "left_semi").groupBy("group_id").agg(F.sum("value").alias("total"))
        rows, norm = rows.join(any_, "group_id"), F.col("value") / F.col("total")
    sums = rows.groupBy("group_id", F.col("category").alias("feat")).agg(F.sum("value").alias("value"), F.sum(F.col("weight") * TRANSFORMS[feat_transform](norm)).alias("score"))
    groups = words.select("group_id").distinct()
    every = groups.crossJoin(constants)
    full = sums.join(every, ["group_id", "feat"], "full")
    score = F.coalesce("score", F.lit(0.0)) + F.coalesce("constant", F.lit(0.0))
    out = full.select("group_id", "feat", F.coalesce("value", F.lit(0)).alias("value"), TRANSFORMS[transform](score).cast("double").alias("group_norm"))
    if not add_intercept:
        return out
    has = constants.limit(1).select(F.lit(True).alias("__has"))
    marks = groups.join(has, F.lit(True), "left_anti").select("group_id", F.lit(INTERCEPT).alias("feat"), F.lit(1).cast(out.schema["value"].dataType).alias("value"), F.lit(1.0).alias("group_norm"))
    return out.unionByName(marks)


def corpus_weights(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(term, category, weight): a term's mean norm over the groups that have it, times its weight."""
    lex = prepared(lexicon)
    of = categories_of(words, lex)
    by = words.groupBy("feat").agg(F.avg("group_norm").alias("mean"))
    return by.join(of, "feat").select(F.col("feat").alias("term"), "category", (F.col("mean") * F.col("weight")).alias("weight"))


# ---- algebra ---------------------------------------------------------------------------------------------------------


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All terms of both, by category; a shared term has the greater weight."""
    if "weight" not in a.columns:
        return a.select("term", "category").unionByName(b.select("term", "category")).distinct()
    both = a.select("term", "category", "weight").unionByName(b.select("term", "category", "weight"))
    return both.groupBy("term", "category").agg(F.max("weight").alias("weight"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Terms that a category has in both; the weights are a's."""
    keys = b.select("term", "category").distinct()
    return a.join(keys, ["term", "category"], "left_semi").select(*[c for c in ("term", "category", "weight") if c in a.columns]).distinct()


def depolarised(lexicon: DataFrame) -> DataFrame:
    """Categories without a trailing + or -."""
    return lexicon.withColumn("category", F.regexp_replace("category", r"[+-]$", "")).distinct()


def ungrouped(lexicon: DataFrame) -> DataFrame:
    """A category of its own for every term and category."""
    return lexicon.withColumn("category", F.concat_ws("_", "term", F.upper("category")))


def randomised(lexicon: DataFrame, seed: int = 42) -> DataFrame:
    """Terms dealt anew to categories of the same sizes, in the order of a seeded hash: the terms are ranked by it, the rows by category."""
    from pyspark.sql import Window as W

    rows = lexicon.select("term", "category").distinct()
    terms = rows.withColumn("k", F.row_number().over(W.orderBy(F.xxhash64("term", "category", F.lit(seed)), "term", "category"))).select("k", "term")
    slots = rows.withColumn("k", F.row_number().over(W.orderBy("category", "term"))).select("k", "category")
    return terms.join(slots, "k").select("term", "category").distinct()


def from_corpus(messages: DataFrame, message_id: str, message: str, min_freq: int = 1000, category: str = "CORPUS") -> DataFrame:
    """Words between white space that occur min_freq times or more; a message counts once."""
    once = messages.where(F.col(message).isNotNull()).select(message_id, message).dropDuplicates([message_id])
    words = once.select(F.explode(F.filter(F.split(F.lower(message), r"\s+"), lambda w: w != "")).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("weight")).where(F.col("weight") >= min_freq).select("term", F.lit(category).alias("category"), "weight")


def tagged(messages: DataFrame, lexicon: DataFrame, message_id: str, message: str, max_words: int = 1) -> DataFrame:
    """(message_id, term, n, words): whole-word matches of terms and wildcards in each message, case ignored."""
    words = F.regexp_extract_all(F.lower(message), F.lit(r"[\p{L}\p{N}_']+"), F.lit(0))
    rows = messages.select(F.col(message_id).alias("message_id"), words.alias("ws"))
    counts = None
    for n in range(1, max_words + 1):
        one = rows.select("message_id", F.size("ws").alias("words"), F.explode(ngrams(F.col("ws"), n, length=1 << 20)).alias("feat"))
        counts = one if counts is None else counts.unionByName(one)
    counts = counts.groupBy("message_id", "words", "feat").agg(F.count("*").alias("n"))
    lex = lexicon.select(F.lower(F.trim("term")).alias("term")).distinct()
    of = categories_of(counts, lex.select("term", F.col("term").alias("category"), F.lit(1.0).alias("weight"))).select("feat", F.col("category").alias("term"))
    return counts.join(of, "feat").groupBy("message_id", "term", "words").agg(F.sum("n").alias("n"))


def examples(messages: DataFrame, pattern: str, message_id: str, message: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """Messages that match a pattern; with n a sample of that size, by a seeded hash."""
    rows = messages.where(F.col(message).rlike(pattern)).select(message_id, message)
    return rows if n is None else rows.orderBy(F.xxhash64(F.col(message_id), F.lit(seed)), message_id).limit(n)


def expanded(lexicon: DataFrame, related: DataFrame) -> DataFrame:
    """Terms and their relatives of a given graph (term, relative), in the term's categories."""
    more = lexicon.join(related.select("term", "relative"), "term").select(F.col("relative").alias("term"), *[c for c in lexicon.columns if c != "term"])
    return lexicon.unionByName(more.select(lexicon.columns)).distinct()


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(category_a, category_b, jaccard, weighted_jaccard) of the categories that share a term; others have 0.

    Weighted: the sum of lesser weights over the sum of greater ones, for weights that aren't negative.
    """
    x, y = prepared(a), prepared(b)
    size = lambda t, s: t.groupBy(F.col("category").alias(f"category_{s}")).agg(F.count("*").alias(f"n_{s}"), F.sum("weight").alias(f"w_{s}"))
    shared = x.select("term", F.col("category").alias("category_a"), F.col("weight").alias("wa")).join(y.select("term", F.col("category").alias("category_b"), F.col("weight").alias("wb")), "term")
    by = shared.groupBy("category_a", "category_b").agg(F.count("*").alias("n"), F.sum(F.least("wa", "wb")).alias("low"))
    out = by.join(size(x, "a"), "category_a").join(size(y, "b"), "category_b")
    return out.select("category_a", "category_b", (F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n"))).alias("jaccard"), (F.col("low") / (F.col("w_a") + F.col("w_b") - F.col("low"))).alias("weighted_jaccard"))


def columns_by_category(lexicon: DataFrame) -> DataFrame:
    """(category, terms): the sorted terms of each category, a column of a printed lexicon each."""
    return lexicon.groupBy("category").agg(F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("terms"))


def super_topics(reduced: DataFrame, topics: DataFrame) -> DataFrame:
    """From components of topics (term = topic, category = component) to words: sums of products of weights."""
    r = reduced.select(F.col("term").alias("topic"), F.col("category").alias("component"), F.col("weight").alias("w1"))
    t = topics.select("term", F.col("category").alias("topic"), F.col("weight").alias("w2"))
    return r.join(t, "topic").groupBy("term", F.col("component").alias("category")).agg(F.sum(F.col("w1") * F.col("w2")).alias("weight"))


def word_list(lexicon: DataFrame, words: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Features of a word table that a lexicon's categories (all by default) have: for a white list by semi join, a black list by anti join."""
    lex = prepared(lexicon)
    if categories is not None:
        lex = lex.where(F.col("category").isin(categories))
    return categories_of(words, lex).select("feat").distinct()


def mapped_labels(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Features renamed to their labels (category, label) where they have one."""
    m = labels.groupBy(F.col("category").alias("feat")).agg(F.array_join(F.array_sort(F.collect_set("label")), "_").alias("__label"))
    return results.join(m, "feat", "left").withColumn("feat", F.coalesce("__label", "feat")).drop("__label")
