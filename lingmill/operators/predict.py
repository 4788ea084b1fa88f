"""Prediction: folds, models, metrics, significance, and models as lexica.

Ridge regression needs only moments: one pass gives the moments of every fold, from which the models of all folds, all
penalties and all sets of columns follow on the driver by subtraction. Other models are Spark ML's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import StandardScaler, UnivariateFeatureSelector
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lingmill.functions.special import p_of_t
from lingmill.operators.reduce import matrix, moments

PENALTIES = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0, 10000.0, 100000.0]


def aligned(ft: DataFrame, analysis: DataFrame, feats: list[str], controls: DataFrame | None = None, names: list[str] = (), zeros: bool = True) -> DataFrame:
    """(outcome, group_id, y[, fold], x, c): arrays of features and controls. zeros: groups without any feature stay, as zeros."""
    keys = [c for c in ("outcome", "group_id", "y", "fold") if c in analysis.columns]
    groups = analysis.select("group_id").distinct()
    x = matrix(ft.join(groups, "group_id", "left_semi"), feats, groups=groups if zeros else None)
    rows = analysis.select(*keys).join(x, "group_id")
    if controls is None:
        return rows.withColumn("c", F.array().cast("array<double>"))
    c = controls.dropna(subset=list(names)).select("group_id", F.array(*[F.col(n).cast("double") for n in names]).alias("c"))
    return rows.join(c, "group_id")


# ---- ridge by moments ------------------------------------------------------------------------------------------------


@dataclass
class Ridge:
    """Weights of the raw columns and an intercept; solved on standardised columns."""

    weights: np.ndarray
    intercept: float
    penalty: float
    columns: list[int]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.columns] @ self.weights + self.intercept


def ridge_of(m: tuple, columns: list[int], penalty: float) -> Ridge:
    """m: moments of rows that end with y."""
    n, s, p = m
    mean = s / n
    cov = p / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    scale[scale < 1e-12] = 1.0
    a = cov[np.ix_(columns, columns)] / np.outer(scale[columns], scale[columns])
    b = cov[columns, -1] / scale[columns]
    w = np.linalg.lstsq(a * n + penalty * np.eye(len(columns)), b * n, rcond=None)[0] / scale[columns] if columns else np.zeros(0)
    return Ridge(w, float(mean[-1] - w @ mean[columns]), penalty, list(columns))


def _less(a: tuple, b: tuple | None) -> tuple:
    return a if b is None else (a[0] - b[0], a[1] - b[1], a[2] - b[2])


def _plus(parts: list[tuple]) -> tuple:
    return tuple(sum(x) for x in zip(*parts))


def _error(m: tuple, r: Ridge) -> float:
    """Sum of squared errors over the rows that the moments are of."""
    n, s, p = m
    w = np.zeros(len(s))
    w[r.columns] = -r.weights
    w[-1] = 1.0
    return float(w @ p @ w - 2 * r.intercept * (w @ s) + n * r.intercept**2)


def best_ridge(by_fold: dict, columns: list[int], penalties: list[float] = PENALTIES) -> Ridge:
    """The penalty of the least squared error over the given folds, fitted on all of them."""
    whole = _plus(list(by_fold.values()))
    if len(by_fold) < 2 or len(penalties) == 1:
        return ridge_of(whole, columns, penalties[0])
    scores = [(sum(_error(m, ridge_of(_less(whole, m), columns, a)) for m in by_fold.values()), a) for a in penalties]
    return ridge_of(whole, columns, min(scores)[1])


def fold_moments(rows: DataFrame) -> dict[str, dict[int, tuple]]:
    """{outcome: {fold: moments of features, controls and y}} in one pass."""
    keyed = rows.withColumns({"__k": F.concat_ws("\t", "outcome", F.col("fold").cast("string")), "__y": F.array("y")})
    out: dict[str, dict[int, tuple]] = {}
    for key, m in moments(keyed, ["x", "c", "__y"], "__k").items():
        outcome, fold = key.rsplit("\t", 1)
        out.setdefault(outcome, {})[int(fold)] = m
    return out


def cross_validated(rows: DataFrame, n_features: int, n_controls: int = 0, penalties: list[float] = PENALTIES) -> DataFrame:
    """(outcome, group_id, y, fold, controls, with_language, prediction) for no controls and all subsets of one size up, with and without the features.

    rows: aligned() with folds. The penalty is chosen on the training folds.
    """
    subsets = [()] + ([tuple(range(n_controls))] if n_controls else [])
    return _predicted(rows, n_features, subsets, penalties)


def control_combinations(rows: DataFrame, n_features: int, n_controls: int, penalties: list[float] = PENALTIES) -> DataFrame:
    """cross_validated() for every subset of the controls."""
    return _predicted(rows, n_features, [c for k in range(n_controls + 1) for c in combinations(range(n_controls), k)], penalties)


def _predicted(rows: DataFrame, n_features: int, subsets: list[tuple], penalties: list[float]) -> DataFrame:
    models: dict[tuple, Ridge] = {}
    plans = [(some, lang) for some in subsets for lang in (False, True) if some or lang]
    for outcome, folds in fold_moments(rows).items():
        for fold in folds:
            rest = {f: m for f, m in folds.items() if f != fold}
            if not rest:
                continue
            for some, lang in plans:
                columns = (list(range(n_features)) if lang else []) + [n_features + i for i in some]
                models[outcome, fold, some, lang] = best_ridge(rest, columns, penalties)
    shared = rows.sparkSession.sparkContext.broadcast(models)
    schema = StructType([rows.schema[c] for c in ("outcome", "group_id", "y", "fold")]).add("controls", "string").add("with_language", "boolean").add("prediction", "double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (outcome, fold), part in pdf.groupby(["outcome", "fold"]):
                x = np.array([np.concatenate([a, b]) for a, b in zip(part["x"], part["c"])], float)
                for some, lang in plans:
                    model = shared.value.get((outcome, fold, some, lang))
                    if model is not None:
                        yield part[["outcome", "group_id", "y", "fold"]].assign(controls=" ".join(map(str, some)), with_language=lang, prediction=model.predict(x))

    return rows.select("outcome", "group_id", "y", "fold", "x", "c").mapInPandas(run, schema)


def adjusted_outcomes(rows: DataFrame, penalties: list[float] = PENALTIES) -> DataFrame:
    """(outcome, group_id, y): y less its prediction from the controls by models of the other folds, plus the mean of y."""
    n = len(rows.select("x").first()[0]) if rows.head(1) else 0
    k = len(rows.select("c").first()[0]) if rows.head(1) else 0
    p = _predicted(rows, n, [tuple(range(k))], penalties).where("NOT with_language")
    means = rows.groupBy("outcome").agg(F.avg("y").alias("mean"))
    return p.join(means, "outcome").select("outcome", "group_id", (F.col("y") - F.col("prediction") + F.col("mean")).alias("y"), "fold")


def residualised(rows: DataFrame, n_features: int, n_controls: int, penalties: list[float] = PENALTIES) -> DataFrame:
    """Two stages: controls first, the features on what is left; the predictions are summed."""
    first = _predicted(rows, n_features, [tuple(range(n_controls))], penalties).where("NOT with_language").select("outcome", "group_id", F.col("prediction").alias("p1"))
    left = rows.join(first, ["outcome", "group_id"]).withColumns({"__y0": F.col("y"), "y": F.col("y") - F.col("p1")})
    second = _predicted(left.withColumn("c", F.array().cast("array<double>")), n_features, [()], penalties).select("outcome", "group_id", "fold", F.col("prediction").alias("p2"))
    return left.select("outcome", "group_id", F.col("__y0").alias("y"), "p1").join(second, ["outcome", "group_id"]).select("outcome", "group_id", "y", "fold", (F.col("p1") + F.col("p2")).alias("prediction"))


def with_factors(ft: DataFrame, factors: DataFrame, names: list[str]) -> DataFrame:
    """Every feature and, for each factor (group_id, names...) scaled to 0..1, its product with it (`<feat>*<factor>`)."""
    ends = factors.agg(*[f(F.col(n)).alias(f"{k}_{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))])
    scaled = factors.crossJoin(F.broadcast(ends)).select("group_id", *[F.when(F.col(f"hi_{n}") > F.col(f"lo_{n}"), (F.col(n) - F.col(f"lo_{n}")) / (F.col(f"hi_{n}") - F.col(f"lo_{n}"))).otherwise(0.0).alias(n) for n in names])
    long = scaled.unpivot(["group_id"], names, "factor", "f").where("f IS NOT NULL AND f <> 0")
    more = ft.join(long, "group_id").select("group_id", F.concat_ws("*", "feat", "factor").alias("feat"), (F.col("value") * F.col("f")).alias("value"), (F.col("group_norm") * F.col("f")).alias("group_norm"))
    return ft.select("group_id", "feat", F.col("value").cast("double").alias("value"), "group_norm").unionByName(more)


# ---- models of Spark ML ----------------------------------------------------------------------------------------------


def estimator(name: str, **kw):
    """A model by name, for columns features and y. Extremely random trees and stochastic gradients, which Spark lacks, are refused."""
    common = {"featuresCol": "features", "labelCol": "y", "predictionCol": "prediction"}
    linear = lambda **p: R.LinearRegression(**common, **(p | kw))
    logit = lambda **p: C.LogisticRegression(**common, **(p | kw))
    zoo = {
        "linear": lambda: linear(), "ridge": lambda: linear(**({"regParam": 1.0} | kw)), "lasso": lambda: linear(regParam=0.01, elasticNetParam=1.0), "elasticnet": lambda: linear(regParam=0.01, elasticNetParam=0.5),
        "rfr": lambda: R.RandomForestRegressor(**common, seed=42, **kw),
        "gbr": lambda: R.GBTRegressor(**common, seed=42, **kw), "huber": lambda: linear(loss="huber"), "glm": lambda: R.GeneralizedLinearRegression(**common, **kw),
        "lr": lambda: logit(regParam=0.01), "lr1": lambda: logit(regParam=0.01, elasticNetParam=1.0), "lrnone": lambda: logit(regParam=0.0), "linear-svc": lambda: C.LinearSVC(**common, **kw),
        "rfc": lambda: C.RandomForestClassifier(**common, seed=42, **kw), "gbc": lambda: C.GBTClassifier(**common, seed=42, **kw),
        "mnb": lambda: C.NaiveBayes(**common, modelType="multinomial", **kw), "gnb": lambda: C.NaiveBayes(**common, modelType="gaussian", **kw), "bnb": lambda: C.NaiveBayes(**common, modelType="bernoulli", **kw),
        "mlp": lambda: C.MultilayerPerceptronClassifier(**common, seed=42, **kw), "ovr": lambda: C.OneVsRest(classifier=C.LogisticRegression(**common), **common),
    }
    if name not in zoo:
        raise ValueError(f"no model {name}; there are {', '.join(zoo)}")
    return zoo[name]()


def training_pipeline(model: str, selection: str | None = None, classes: bool = False, scale: bool = True, **kw) -> Pipeline:
    """Scaling by the spread, selection of features by family-wise error (`fwe`), false discoveries (`fdr`) or number (`top<k>`), and the model."""
    stages, at = [], "raw"
    if scale:
        stages.append(StandardScaler(inputCol=at, outputCol="scaled", withMean=False))
        at = "scaled"
    if selection:
        mode, threshold = ("numTopFeatures", int(selection[3:])) if selection.startswith("top") else (selection, 0.05)
        chosen = UnivariateFeatureSelector(featuresCol=at, outputCol="selected", labelCol="y", selectionMode=mode)
        stages.append(chosen.setFeatureType("continuous").setLabelType("categorical" if classes else "continuous").setSelectionThreshold(threshold))
        at = "selected"
    return Pipeline(stages=[*stages, estimator(model, **kw).setFeaturesCol(at)])


def vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("raw", array_to_vector(F.concat("x", "c")))


def trained(rows: DataFrame, model: str, selection: str | None = None, classes: bool = False, **kw) -> PipelineModel:
    return training_pipeline(model, selection, classes, **kw).fit(vectors(rows))


def predicted(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """(group_id, [outcome, y, fold,] prediction[, probability]); rows needn't have outcomes."""
    out = model.transform(vectors(rows))
    keep = [c for c in ("outcome", "group_id", "y", "fold") if c in rows.columns]
    more = [vector_to_array("probability").alias("probability")] if "probability" in out.columns else []
    return out.select(*keep, "prediction", *more)


def n_fold(rows: DataFrame, model: str, folds: int, selection: str | None = None, classes: bool = False, **kw) -> DataFrame:
    """Predictions of each fold by a model of the others, for one outcome. One fit a fold."""
    out = None
    for k in range(folds):
        part = predicted(rows.where(F.col("fold") == k), trained(rows.where(F.col("fold") != k), model, selection, classes, **kw))
        out = part if out is None else out.unionByName(part)
    return out


def split(analysis: DataFrame, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Groups for training and for testing, by a seeded hash: the same whatever the partitions."""
    part = F.pmod(F.xxhash64(F.col("group_id"), F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))
    return analysis.where(part), analysis.where(~part)


def training_bootstraps(rows: DataFrame, test: DataFrame, sizes: list[int], samples: int = 10, seed: int = 42, penalty: float = 1.0) -> DataFrame:
    """(size, sample, mse) of ridge models of resampled training rows: a row counts a Poisson number of times."""
    n = rows.count()
    m_test = _plus(list(moments(test.withColumn("__y", F.array("y")), ["x", "c", "__y"]).values()))
    out = []
    for size in sizes:
        for i in range(samples):
            drawn = rows.sample(True, size / n, seed + i)
            m = list(moments(drawn.withColumn("__y", F.array("y")), ["x", "c", "__y"]).values())
            if m:
                r = ridge_of(_plus(m), list(range(len(m_test[1]) - 1)), penalty)
                out.append((size, i, _error(m_test, r) / m_test[0]))
    return rows.sparkSession.createDataFrame(out, "size int, sample int, mse double")


def stacked(predictions: DataFrame, penalties: list[float] = PENALTIES) -> DataFrame:
    """Predictions of several tables (outcome, group_id, y, fold, source, prediction) as columns of a second ridge model."""
    sources = [r[0] for r in predictions.select("source").distinct().orderBy("source").collect()]
    wide = predictions.groupBy("outcome", "group_id", "y", "fold").agg(F.array(*[F.coalesce(F.max(F.when(F.col("source") == s, F.col("prediction"))), F.lit(0.0)) for s in sources]).alias("x"))
    return _predicted(wide.withColumn("c", F.array().cast("array<double>")), len(sources), [()], penalties)


def classify_then_regress(rows: DataFrame, labels: DataFrame, accepted: list[float], classifier: str = "lr", penalty: float = 1.0) -> DataFrame:
    """(group_id, y, prediction): a regression of the groups whose predicted class is accepted. labels: (group_id, label)."""
    with_label = rows.join(labels.select("group_id", F.col("label").cast("double").alias("__l")), "group_id")
    model = trained(with_label.withColumn("y", F.col("__l")), classifier, classes=True)
    chosen = rows.join(predicted(rows, model).where(F.col("prediction").isin(accepted)).select("group_id"), "group_id", "left_semi")
    m = list(moments(chosen.withColumn("__y", F.array("y")), ["x", "c", "__y"]).values())
    if not m:
        return chosen.select("group_id", "y", F.lit(None).cast("double").alias("prediction"))
    r = ridge_of(_plus(m), list(range(len(m[0][1]) - 1)), penalty)
    terms = F.zip_with(F.concat("x", "c"), F.array(*[F.lit(float(w)) for w in r.weights]), lambda a, b: a * b)
    return chosen.select("group_id", "y", (F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) + F.lit(r.intercept)).alias("prediction"))


def as_features(predictions: DataFrame) -> DataFrame:
    """Predictions as a feature table, the outcome's name as feature."""
    return predictions.select("group_id", F.col("outcome").alias("feat"), F.col("prediction").alias("value"), F.col("prediction").alias("group_norm"))


def as_outcomes(predictions: DataFrame, model: str, outcomes: list[str]) -> DataFrame:
    """One row a group, a column p_<model>_<outcome> for each outcome."""
    return predictions.groupBy("group_id").agg(*[F.max(F.when(F.col("outcome") == o, F.col("prediction"))).alias(f"p_{model[:4]}_{o}") for o in outcomes])


# ---- metrics ---------------------------------------------------------------------------------------------------------


def regression_metrics(predictions: DataFrame, by: list[str] = ("outcome",)) -> DataFrame:
    """r2, r (root of r2), pearson and p, spearman, mse, mae, mae of the mean, n."""
    y, p = F.col("y"), F.col("prediction")
    rank = lambda c: F.rank().over(W.partitionBy(*by).orderBy(c)) + (F.count("*").over(W.partitionBy(*by, c)) - 1) / 2
    rows = predictions.withColumns({"__ry": rank("y"), "__rp": rank("prediction"), "__mean": F.avg("y").over(W.partitionBy(*by))})
    s = rows.groupBy(*by).agg(
        (1 - F.sum((y - p) * (y - p)) / F.nullif(F.sum((y - F.col("__mean")) * (y - F.col("__mean"))), F.lit(0.0))).alias("r2"), F.corr("y", "prediction").alias("pearson"), F.corr("__ry", "__rp").alias("spearman"),
        F.avg((y - p) * (y - p)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"), F.avg(F.abs(y - F.col("__mean"))).alias("mean_mae"), F.count("*").alias("n"),
    )
    s = s.withColumn("r", F.when(F.col("r2") >= 0, F.sqrt("r2")))
    t = F.when(F.abs("pearson") < 1, F.col("pearson") * F.sqrt((F.col("n") - 2) / (1 - F.col("pearson") * F.col("pearson"))))
    return s.withColumn("pearson_p", p_of_t(t, F.col("n") - 2))


def classification_metrics(predictions: DataFrame, by: list[str] = ("outcome",)) -> DataFrame:
    """acc, precision, recall, f1 (macro and weighted), mcc, most frequent class's acc, n, from the counts of (y, prediction)."""
    by = list(by)
    cells = predictions.groupBy(*by, "y", "prediction").agg(F.count("*").alias("c"))
    total = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("y") == F.col("prediction"), F.col("c")).otherwise(0)).alias("hits"))
    true = cells.groupBy(*by, F.col("y").alias("k")).agg(F.sum("c").alias("t"), F.sum(F.when(F.col("y") == F.col("prediction"), F.col("c")).otherwise(0)).alias("hit"))
    said = cells.groupBy(*by, F.col("prediction").alias("k")).agg(F.sum("c").alias("s"))
    k = true.join(said, [*by, "k"], "full").select(*by, "k", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("t", "hit", "s")])
    div = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    k = k.withColumns({"pr": div(F.col("hit"), F.col("s")), "re": div(F.col("hit"), F.col("t")), "f": div(2 * F.col("hit"), F.col("s") + F.col("t"))})
    a = k.groupBy(*by).agg(
        F.avg("pr").alias("precision"), F.avg("re").alias("recall"), F.avg("f").alias("f1"), (F.sum(F.col("f") * F.col("t")) / F.sum("t")).alias("f1_weighted"), F.max("t").alias("top"),
        F.sum(F.col("t") * F.col("s")).alias("ts"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("s") * F.col("s")).alias("ss"),
    ).join(total, by)
    n, h = F.col("n").cast("double"), F.col("hits")
    mcc = div(h * n - F.col("ts"), F.sqrt((n * n - F.col("ss")) * (n * n - F.col("tt"))))
    return a.select(*by, (h / n).alias("acc"), "precision", "recall", "f1", "f1_weighted", mcc.alias("mcc"), (F.col("top") / n).alias("mfclass_acc"), "n")


def auc(scores: DataFrame, score: str = "score", by: list[str] = ("outcome",)) -> DataFrame:
    """Area under the ROC curve of 0/1 y by ranks with averaged ties."""
    by = list(by)
    rank = F.rank().over(W.partitionBy(*by).orderBy(score)) + (F.count("*").over(W.partitionBy(*by, score)) - 1) / 2
    s = scores.withColumn("__r", rank).groupBy(*by).agg(F.sum(F.when(F.col("y") == 1, F.col("__r"))).alias("r1"), F.sum((F.col("y") == 1).cast("double")).alias("n1"), F.count("*").alias("n"))
    n0 = F.col("n") - F.col("n1")
    return s.select(*by, F.when((F.col("n1") > 0) & (n0 > 0), (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * n0)).alias("auc"), "n")


def roc_curve(scores: DataFrame, score: str = "score", by: list[str] = ("outcome",)) -> DataFrame:
    """(threshold, fpr, tpr): one point a distinct score."""
    by = list(by)
    steps = scores.groupBy(*by, F.col(score).alias("threshold")).agg(F.sum((F.col("y") == 1).cast("int")).alias("p"), F.sum((F.col("y") != 1).cast("int")).alias("f"))
    w, all_ = W.partitionBy(*by).orderBy(F.desc("threshold")), W.partitionBy(*by)
    rate = lambda c: F.sum(c).over(w) / F.nullif(F.sum(c).over(all_), F.lit(0))
    return steps.select(*by, "threshold", rate("f").alias("fpr"), rate("p").alias("tpr"))


def compared_models(predictions: DataFrame, score_a: str, score_b: str, kind: str = "auc", samples: int = 2000, seed: int = 42, by: list[str] = ("outcome",)) -> DataFrame:
    """(a, b, p) of two models on the same groups: `auc` by a paired bootstrap, `error` by permuted signs, `t` by a paired t, `wilcoxon` by signed ranks. A task holds one outcome's two columns."""
    by = list(by)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values([score_a, score_b, "y"])
        y, a, b = (d[c].to_numpy(float) for c in ("y", score_a, score_b))
        rng = np.random.default_rng(seed)
        n = len(y)
        if kind == "auc":
            def area(s: np.ndarray, t: np.ndarray) -> float:
                r = pd.Series(s).rank().to_numpy()
                n1 = t.sum()
                return (r[t == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(t) - n1)) if 0 < n1 < len(t) else np.nan

            fa, fb = area(a, y), area(b, y)
            gaps = []
            for _ in range(samples):
                i = rng.integers(0, n, n)
                gaps.append(area(b[i], y[i]) - area(a[i], y[i]))
            gaps = np.array(gaps)
            gaps = gaps[~np.isnan(gaps)]
            p = float(min(1.0, 2 * min((gaps <= 0).mean(), (gaps >= 0).mean()))) if len(gaps) else 1.0
        else:
            ea, eb = np.abs(y - a), np.abs(y - b)
            g = ea - eb
            fa, fb = ea.mean(), eb.mean()
            if kind == "error":
                p = float(np.mean([abs((g * rng.choice([-1, 1], n)).mean()) >= abs(g.mean()) - 1e-15 for _ in range(samples)]))
            elif kind == "t":
                from lingmill.functions.special import t_two_tailed

                sd = g.std(ddof=1) if n > 1 else 0.0
                p = float(t_two_tailed(g.mean() / (sd / np.sqrt(n)), n - 1)) if sd > 0 else 1.0
            else:
                import math

                g = g[g != 0]
                m = len(g)
                r = pd.Series(np.abs(g)).rank().to_numpy()
                ties = np.unique(r, return_counts=True)[1]
                var = m * (m + 1) * (2 * m + 1) / 24 - (ties**3 - ties).sum() / 48
                p = math.erfc(abs(r[g > 0].sum() - m * (m + 1) / 4) / math.sqrt(2 * var)) if var > 0 else 1.0
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in by}, "a": [fa], "b": [fb], "p": [p]})

    schema = StructType([predictions.schema[c] for c in by]).add("a", "double").add("b", "double").add("p", "double")
    return predictions.select(*by, "y", score_a, score_b).groupBy(*by).applyInPandas(test, schema)


def weighted_ensemble(scores: DataFrame, by: list[str] = ("outcome",)) -> DataFrame:
    """(outcome, group_id, y, score): the mean of models' scores (columns model, score) with weights ((max(AUC, .5) - .5) / .5) squared; alike if all are 0."""
    by = list(by)
    areas = auc(scores, "score", [*by, "model"]).select(*by, "model", F.pow((F.greatest("auc", F.lit(0.5)) - 0.5) / 0.5, F.lit(2.0)).alias("w"))
    rows = scores.join(areas, [*by, "model"])
    total = F.sum("w")
    return rows.groupBy(*by, "group_id", "y").agg(F.when(total > 0, F.sum(F.col("w") * F.col("score")) / total).otherwise(F.avg("score")).alias("score"))


# ---- models as lexica ------------------------------------------------------------------------------------------------


def ridge_lexicon(spark, model: Ridge, feats: list[str], category: str) -> DataFrame:
    """(term, category, weight): weights of raw norms, and the intercept."""
    rows = [(feats[i], category, float(w)) for i, w in zip(model.columns, model.weights) if i < len(feats) and w] + [("_intercept", category, model.intercept)]
    return spark.createDataFrame(rows, "term string, category string, weight double")


def unpacked_topics(weights: DataFrame, topics: DataFrame) -> DataFrame:
    """Weights of topics (term, category, weight) as weights of words: sums over topics of weight times the word's weight in it. Intercepts stay."""
    t = topics.select("term", F.col("category").alias("topic"), F.col("weight").alias("w2"))
    m = weights.where("term <> '_intercept'").select(F.col("term").alias("topic"), "category", F.col("weight").alias("w1"))
    words = m.join(t, "topic").groupBy("term", "category").agg(F.sum(F.col("w1") * F.col("w2")).alias("weight"))
    return words.unionByName(weights.where("term = '_intercept'").select("term", "category", "weight"))
