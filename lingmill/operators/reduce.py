"""Dimensionality reduction and topics.

Rows stay distributed: what comes to the driver are matrices of the size of the named features (moments, components).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import LDA, GaussianMixture, KMeans
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from lingmill.operators.kernel import stored


def matrix(ft: DataFrame, feats: list[str], column: str = "group_norm", groups: DataFrame | None = None) -> DataFrame:
    """(group_id, x): an array of the named features' numbers, absent ones 0; groups without any of them are all zeros."""
    rows = ft.where(F.col("feat").isin(feats)) if len(feats) <= 1000 else ft
    by = rows.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("feat", F.col(column).cast("double").alias("v")))).alias("m"))
    every = (ft if groups is None else groups).select("group_id").distinct().join(by, "group_id", "left")
    names = F.array(*[F.lit(f) for f in feats])
    return every.select("group_id", F.transform(names, lambda f: F.coalesce(F.element_at("m", f), F.lit(0.0))).alias("x"))


def moments(rows: DataFrame, columns: list[str], by: str | None = None) -> dict:
    """{key: (n, sums, products)} of the arrays in columns, one after another; tasks sum their rows in numpy, and blocks of 64 rows of a key's matrix are summed over the tasks."""
    key = F.col(by).cast("string") if by else F.lit("")
    picked = rows.select(key.alias("k"), F.concat(*[F.col(c) for c in columns]).alias("x"))

    def partial(batches):
        held: dict[str, list] = {}
        for pdf in batches:
            for k, part in pdf.groupby("k", dropna=False):
                m = np.array(part["x"].tolist(), float)
                h = held.setdefault(k, [0, 0.0, 0.0])
                h[0] += len(m)
                h[1] = h[1] + m.sum(0)
                h[2] = h[2] + m.T @ m
        for k, (n, s, p) in held.items():
            table = np.vstack([np.concatenate([[n], s]), np.column_stack([np.zeros(len(s)), p])])
            i = np.arange(len(table))
            yield pd.DataFrame({"k": k, "b": i // 64, "i": i, "row": list(table)})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        i = pdf["i"].to_numpy()
        order = np.argsort(i, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(i[order]) > 0]))
        rows = np.add.reduceat(np.stack(pdf["row"].to_numpy())[order], first, axis=0)
        return pd.DataFrame({"k": pdf["k"].iloc[0], "i": i[order][first], "row": list(rows)})

    parts = picked.mapInPandas(partial, "k string, b long, i long, row array<double>")
    found: dict[str, list] = {}
    for r in parts.groupBy("k", "b").applyInPandas(added, "k string, i long, row array<double>").toLocalIterator():
        found.setdefault(r["k"], []).append((r["i"], np.array(r["row"], float)))  # a list of Python's floats is four times as large
    out = {}
    for k in list(found):
        m = np.stack([row for _, row in sorted(found.pop(k), key=lambda t: t[0])])
        out[k] = (int(m[0, 0]), m[0, 1:], m[1:, 1:])
    return out


@dataclass
class Reducer:
    """components (k by features) and the mean to take away; kind says how scores are made."""

    kind: str
    feats: list[str]
    mean: np.ndarray
    components: np.ndarray
    explained: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "nmf":
            return nonnegative_scores(x, self.components)
        return (x - self.mean) @ self.components.T


def nonnegative_scores(x: np.ndarray, h: np.ndarray, steps: int = 200) -> np.ndarray:
    w = np.full((len(x), len(h)), 1.0)
    top, hh = np.maximum(x, 0) @ h.T, h @ h.T
    for _ in range(steps):
        w *= top / np.maximum(w @ hh, 1e-12)
    return w


def _signed(c: np.ndarray) -> np.ndarray:
    """The largest loading of each component is positive."""
    big = c[np.arange(len(c)), np.abs(c).argmax(1)]
    return c * np.where(big < 0, -1.0, 1.0)[:, None]


def pca(ft: DataFrame, feats: list[str], k: int | None = None, share: float | None = None, groups: DataFrame | None = None) -> Reducer:
    """Principal components, k of them or enough for a share of the variance, from one pass of moments."""
    n, s, p = next(iter(moments(matrix(ft, feats, groups=groups), ["x"]).values()))
    mean = s / n
    values, vectors = np.linalg.eigh(p / n - np.outer(mean, mean))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    if share is not None:
        k = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), share) + 1)
    k = min(k or len(feats), len(feats), n)
    return Reducer("pca", feats, mean, _signed(vectors[:, :k].T), values[:k])


def factor_analysis(ft: DataFrame, feats: list[str], k: int, steps: int = 500) -> Reducer:
    """Maximum likelihood factors by EM on the covariance."""
    n, s, p = next(iter(moments(matrix(ft, feats), ["x"]).values()))
    mean = s / n
    c = p / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(c)
    load = vectors[:, -k:] * np.sqrt(np.maximum(values[-k:], 1e-6))
    psi = np.maximum(np.diag(c) - (load**2).sum(1), 1e-6)
    for _ in range(steps):
        beta = load.T @ np.linalg.inv(load @ load.T + np.diag(psi))
        ez = np.eye(k) - beta @ load + beta @ c @ beta.T
        load = c @ beta.T @ np.linalg.inv(ez)
        psi = np.maximum(np.diag(c - load @ beta @ c), 1e-6)
    beta = load.T @ np.linalg.inv(load @ load.T + np.diag(psi))
    return Reducer("fa", feats, mean, _signed(beta))


def nmf(ft: DataFrame, feats: list[str], k: int, rounds: int = 20, seed: int = 42) -> Reducer:
    """Nonnegative components: each round one job solves the rows' scores for the components and sums what updates them."""
    rows = matrix(ft, feats)
    h = np.random.default_rng(seed).random((k, len(feats))) + 0.1
    for _ in range(rounds):
        def scored(batches, h=h):
            for pdf in batches:
                if len(pdf):
                    x = np.array(pdf["x"].tolist(), float)
                    yield pd.DataFrame({"x": x.tolist(), "w": nonnegative_scores(x, h).tolist()})

        got = moments(rows.select("x").mapInPandas(scored, "x array<double>, w array<double>"), ["w", "x"])
        _, _, p = next(iter(got.values()))
        ww, wx = p[:k, :k], p[:k, k:]
        for _ in range(50):
            h = h * np.maximum(wx, 0) / np.maximum(ww @ h, 1e-12)
    return Reducer("nmf", feats, np.zeros(len(feats)), h)


def varimax(components: np.ndarray, steps: int = 200, power: int = 1) -> np.ndarray:
    """Components turned so that loadings are large or small; power above 1 bends them towards that target (promax)."""
    load = components.T
    p, k = load.shape
    turn, last = np.eye(k), 0.0
    for _ in range(steps):
        r = load @ turn
        u, s, v = np.linalg.svd(load.T @ (r**3 - r * (r**2).sum(0) / p))
        turn = u @ v
        if s.sum() < last * (1 + 1e-10):
            break
        last = s.sum()
    r = load @ turn
    if power > 1:
        target = np.sign(r) * np.abs(r) ** power
        r = r @ np.linalg.lstsq(r, target, rcond=None)[0]
    return r.T


def without_main_components(ft: DataFrame, reducer: Reducer, d: int) -> DataFrame:
    """Rows less their mean and their projections on the first d components, as a feature table."""
    c = reducer.components[:d]
    return _mapped(ft, reducer.feats, lambda x: (x - reducer.mean) - x @ c.T @ c, reducer.feats)


def _mapped(ft: DataFrame, feats: list[str], f, names: list[str]) -> DataFrame:
    rows = matrix(ft, feats)
    schema = StructType([rows.schema["group_id"]]).add("s", ArrayType(DoubleType()))

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"group_id": pdf["group_id"], "s": f(np.array(pdf["x"].tolist(), float)).tolist()})

    scores = rows.mapInPandas(run, schema).select("group_id", F.posexplode("s").alias("i", "group_norm"))
    labels = F.array(*[F.lit(n) for n in names])
    return scores.select("group_id", F.element_at(labels, F.col("i") + 1).alias("feat"), F.col("group_norm").alias("value"), "group_norm")


def transformed(ft: DataFrame, reducer: Reducer) -> DataFrame:
    """Scores as features COMPONENT_0, COMPONENT_1, ..."""
    return _mapped(ft, reducer.feats, reducer.scores, [f"COMPONENT_{i}" for i in range(len(reducer.components))])


def to_lexicon(ft: DataFrame, reducer: Reducer, tiny: float = 1e-12) -> DataFrame:
    """(term, category, weight) of loadings that aren't zero."""
    rows = [(f, f"COMPONENT_{i}", float(w)) for i, c in enumerate(reducer.components) for f, w in zip(reducer.feats, c) if abs(w) > tiny]
    return ft.sparkSession.createDataFrame(rows, "term string, category string, weight double")


def clusters(ft: DataFrame, feats: list[str], k: int, kind: str = "kmeans", seed: int = 42) -> DataFrame:
    """(group_id, cluster) by k-means or a mixture of Gaussians."""
    rows = matrix(ft, feats).select("group_id", array_to_vector("x").alias("features"))
    model = {"kmeans": KMeans, "gmm": GaussianMixture}[kind](k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    return model.transform(rows).select("group_id", "cluster")


def shifted_nonnegative(ft: DataFrame) -> DataFrame:
    """Norms less the least of all if that is negative, never below 0."""
    low = ft.agg(F.least(F.min("group_norm"), F.lit(0.0)).alias("low"))
    x = F.greatest(F.col("group_norm") - F.col("low"), F.lit(0.0))
    return ft.crossJoin(F.broadcast(low)).select("group_id", "feat", "value", x.alias("group_norm"))


# ---- topics ----------------------------------------------------------------------------------------------------------


#: CountVectorizer counts the terms of enough documents and takes this many at most: the greatest size there is.
EVERY = (1 << 31) - 1


def lda_topics(documents: DataFrame, message_id: str, tokens: str, k: int = 100, iterations: int = 50, min_df: float = 1, stop_words: DataFrame | None = None, alpha: float | None = None, beta: float = 0.01, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """((message_id, topics), (term, category, weight)): shares of topics of each message, and of terms of each topic. Every iteration reads all documents, and all terms of min_df documents."""
    rows = documents.select(message_id, F.col(tokens).alias("words"))
    if stop_words is not None:
        each = rows.select(message_id, F.explode("words").alias("term")).join(stop_words.select("term").distinct(), "term", "left_anti")
        rows = each.groupBy(message_id).agg(F.collect_list("term").alias("words"))
    counts = CountVectorizer(inputCol="words", outputCol="features", vocabSize=EVERY, minDF=min_df).fit(rows)
    x = counts.transform(rows).select(message_id, "features").persist(StorageLevel.DISK_ONLY)
    lda = LDA(k=k, maxIter=iterations, seed=seed, optimizer="online", subsamplingRate=1.0, topicConcentration=beta, **({"docConcentration": [alpha] * k} if alpha else {}))
    model = lda.fit(x)
    x.unpersist()
    shares = model.transform(x).select(message_id, vector_to_array("topicDistribution").alias("topics"))
    terms = model.describeTopics(len(counts.vocabulary)).select(F.col("topic").cast("string").alias("category"), F.explode(F.arrays_zip("termIndices", "termWeights")).alias("t"))
    names = documents.sparkSession.createDataFrame(list(enumerate(counts.vocabulary)), "i int, term string")
    return shares, terms.join(names, F.col("t.termIndices") == F.col("i")).select("term", "category", F.col("t.termWeights").alias("weight"))


def topic_distributions(tokens: DataFrame) -> DataFrame:
    """(term, topic, n, topic_given_word, log_lift, word_given_topic, kept) from tokens (term, topic). kept: above half of the topic's greatest log lift, or its only word's."""
    both = stored(tokens.groupBy("term", "topic").agg(F.count("*").alias("n")), "topics")
    words = both.groupBy("term").agg(F.sum("n").alias("w"))
    topics = both.groupBy("topic").agg(F.sum("n").alias("t"), F.count("*").alias("terms"))
    total = both.agg(F.sum("n").alias("all"))
    s = both.join(words, "term").join(topics, "topic").crossJoin(F.broadcast(total))
    lift = F.log2(1 + F.col("n") * F.col("all") / (F.col("w") * F.col("t")))
    s = s.withColumn("log_lift", lift)
    top = s.groupBy("topic").agg(F.max("log_lift").alias("top"))
    return s.join(top, "topic").select("term", "topic", "n", (F.col("n") / F.col("w")).alias("topic_given_word"), "log_lift", (F.col("n") / F.col("t")).alias("word_given_topic"), (F.col("log_lift") > F.when(F.col("terms") > 1, 0.5 * F.col("top")).otherwise(0.0)).alias("kept"))


def distribution_lexicon(distributions: DataFrame) -> DataFrame:
    return distributions.where("kept").select("term", F.col("topic").cast("string").alias("category"), F.col("n").cast("double").alias("weight"))
