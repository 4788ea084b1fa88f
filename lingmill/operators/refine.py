"""Refinement: feature tables to feature tables.

Means and spreads count absent pairs as zeros by closed forms over stored rows and the number of groups; only
standardised() writes a dense table, as that is its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lingmill.functions.tokenize import tokenize
from lingmill.operators.features import dense, within
from lingmill.operators.kernel import stored

TINY = 1e-12


def _n_groups(ft: DataFrame) -> DataFrame:
    return ft.agg(F.count_distinct("group_id").alias("n"))


def occurrence_filter(ft: DataFrame, p: float, groups: DataFrame | None = None, min_sum: float = 0) -> DataFrame:
    """Features in at least a share p < 1 of the groups (rounded half to even), or in p groups or more; and of such a sum."""
    rows = within(ft, groups)
    by = rows.groupBy(F.lower("feat").alias("feat")).agg(F.count("*").alias("c"), F.sum("value").alias("s"))
    if p < 1:
        n = (rows if groups is None else groups).agg(F.count_distinct("group_id").alias("n"))
        by = by.crossJoin(F.broadcast(n)).where(F.col("c") >= F.bround(F.col("n") * F.lit(float(p)), 0))
    else:
        by = by.where(F.col("c") >= p)
    if min_sum > 1:
        by = by.where(F.col("s") >= min_sum)
    return ft.join(by.select(F.col("feat").alias("__keep")), F.lower("feat") == F.col("__keep"), "left_semi")


def combined(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _cut(ft: DataFrame) -> DataFrame:
    """(feat, freq, words): each distinct feature is cut once, not every stored row."""
    freqs = ft.groupBy("feat").agg(F.sum("value").alias("freq"))
    return freqs.withColumn("words", F.transform(tokenize(F.col("feat")), lambda w: F.substring(w, 1, 36)))


def collocation_pmi(ft: DataFrame, words: DataFrame) -> DataFrame:
    """(feat, freq, pmi, length, pmi_by_length) of features of several words; words the 1-gram table lacks are left out."""
    return _pmi(_cut(ft), words)


def _pmi(cut: DataFrame, words: DataFrame) -> DataFrame:
    known = words.groupBy(F.col("feat").alias("word")).agg(F.sum("value").alias("word_freq"))
    total = words.agg(F.sum("value").alias("total"))
    parts = cut.where(F.size("words") > 1)
    each = parts.select("feat", F.col("freq"), F.size("words").alias("length"), F.explode("words").alias("word"))
    sums = each.join(known, "word", "left").groupBy("feat", "freq", "length").agg(F.sum(F.log2("word_freq")).alias("logs"), F.count("word_freq").alias("found"))
    t = F.log2("total")
    pmi = F.log2("freq") - t - (F.coalesce("logs", F.lit(0.0)) - F.col("found") * t)
    return sums.crossJoin(F.broadcast(total)).select("feat", "freq", pmi.alias("pmi"), "length").withColumn("pmi_by_length", F.col("pmi") / (F.col("length") - 1))


def pmi_filter(ft: DataFrame, words: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Single words, and collocations whose PMI is above threshold for each word after the first."""
    cut = stored(_cut(ft), "cut")
    good = _pmi(cut, words).where(F.col("pmi") > (F.col("length") - 1) * threshold).select("feat")
    single = cut.where(F.size("words") <= 1).select("feat")
    return ft.join(good.unionByName(single), "feat", "left_semi")


def salience(pmi: Column, freq: Column) -> Column:
    return pmi * F.log2(freq)


def collocation_scores(ft: DataFrame, words: DataFrame) -> DataFrame:
    """(feat, count, pmi, pmi_filter_val, npmi, npmi_filter_val, pocc): natural logs; scores only where a feature occurs more than once and all its words are known; pocc is the share of groups."""
    by = stored(ft.groupBy("feat").agg(F.sum("value").alias("count"), F.count("*").alias("groups")), "by")
    known = words.groupBy(F.col("feat").alias("word")).agg(F.sum("value").alias("word_freq"))
    total = words.agg(F.sum("value").alias("total"))
    parts = by.where((F.col("count") > 1) & F.col("feat").contains(" ")).select("feat", F.col("count").alias("c"), F.split("feat", " ").alias("ws"))
    each = parts.select("feat", "c", F.size("ws").alias("k"), F.explode("ws").alias("word")).join(known, "word", "left")
    sums = each.groupBy("feat", "c", "k").agg(F.sum(F.log("word_freq")).alias("logs"), F.count("word_freq").alias("found")).where("found = k").crossJoin(F.broadcast(total))
    t, k1 = F.log("total"), F.col("k") - 1
    joint = F.log("c") - t
    pmi = joint - (F.col("logs") - F.col("k") * t)
    npmi = F.when(joint < 0, pmi / -joint)
    scored = sums.select("feat", pmi.alias("pmi"), (pmi / k1).alias("pmi_filter_val"), npmi.alias("npmi"), (npmi / k1).alias("npmi_filter_val"))
    return by.crossJoin(F.broadcast(_n_groups(ft))).join(scored, "feat", "left").select(
        "feat", "count", "pmi", "pmi_filter_val", "npmi", "npmi_filter_val", F.when(F.col("count") > 1, F.col("groups") / F.col("n")).alias("pocc")
    )


def tf_idf(ft: DataFrame) -> DataFrame:
    """group_norm times ln(groups / groups with the feature)."""
    df = ft.groupBy("feat").agg(F.count_distinct("group_id").alias("df")).crossJoin(F.broadcast(_n_groups(ft)))
    return ft.join(df, "feat").select("group_id", "feat", "value", (F.col("group_norm") * F.log(F.col("n") / F.col("df"))).alias("group_norm"))


def feature_means(ft: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(feat, mean, std, zero_feat_norm) over all groups; zero_feat_norm is null for constant features."""
    n = (ft if groups is None else groups).agg(F.count_distinct("group_id").alias("n"))
    by = within(ft, groups).groupBy("feat").agg(F.sum("group_norm").alias("s"), F.sum(F.col("group_norm") * F.col("group_norm")).alias("ss")).crossJoin(F.broadcast(n))
    mean = F.col("s") / F.col("n")
    out = by.select("feat", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"))
    return out.withColumn("zero_feat_norm", F.when(F.col("std") > TINY, -F.col("mean") / F.col("std")))


def standardised(ft: DataFrame, use_mean: bool = True, use_std: bool = True, groups: DataFrame | None = None) -> DataFrame:
    """z-scores of all groups and features (dense); a spread of zero counts as one."""
    rows = within(ft, groups)
    means = feature_means(rows, groups)
    z = F.col("group_norm") - (F.col("mean") if use_mean else F.lit(0.0))
    z = z / F.when(F.col("std") > TINY, F.col("std")).otherwise(1.0) if use_std else z
    return dense(rows, groups).join(means, "feat").select("group_id", "feat", z.alias("value"), z.alias("group_norm"))


def with_feature_norms(ft: DataFrame) -> DataFrame:
    """Stored rows with feat_norm, their z-score; null for constant features."""
    m = feature_means(ft)
    return ft.join(m, "feat").select("group_id", "feat", "value", "group_norm", F.when(F.col("std") > TINY, (F.col("group_norm") - F.col("mean")) / F.col("std")).alias("feat_norm"))


def by_outcome(ft: DataFrame, outcomes: DataFrame, outcome: str) -> DataFrame:
    """One group for each value of an outcome: sums, shares of all its values, spread of norms over its groups, and their number."""
    o = outcomes.where(F.col(outcome).isNotNull()).select("group_id", F.col(outcome).alias("o")).join(ft.select("group_id").distinct(), "group_id", "left_semi")
    sizes = o.groupBy("o").agg(F.count("*").alias("n"))
    rows = ft.join(o, "group_id")
    sums = rows.groupBy("o", "feat").agg(F.sum("value").alias("value"), F.sum("group_norm").alias("s"), F.sum(F.col("group_norm") * F.col("group_norm")).alias("ss"))
    totals = sums.groupBy("o").agg(F.sum("value").alias("total"))
    spread = F.sqrt(F.greatest(F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), F.lit(2.0)), F.lit(0.0)))
    return sums.join(totals, "o").join(sizes, "o").select(F.col("o").alias("group_id"), "feat", "value", (F.col("value") / F.col("total")).alias("group_norm"), spread.alias("std_dev"), "n")


def by_outcome_with_control(ft: DataFrame, outcomes: DataFrame, outcome: str, control: str) -> DataFrame:
    """As by_outcome() for each value of a control, then averaged over its values; features that some value lacks go.

    The mean norm counts absent groups as zeros; the spread pools those within values and between them.
    """
    o = outcomes.where(F.col(outcome).isNotNull() & F.col(control).isNotNull()).select("group_id", F.col(outcome).alias("o"), F.col(control).alias("c"))
    o = o.join(ft.select("group_id").distinct(), "group_id", "left_semi")
    sizes = o.groupBy("o", "c").agg(F.count("*").alias("n"))
    values = sizes.agg(F.count_distinct("c").alias("k"))
    per = ft.join(o, "group_id").groupBy("o", "c", "feat").agg(F.sum("value").alias("value"), F.sum("group_norm").alias("s"), F.sum(F.col("group_norm") * F.col("group_norm")).alias("ss")).join(sizes, ["o", "c"])
    mean = F.col("s") / F.col("n")
    per = per.select("o", "feat", "value", mean.alias("m"), (F.col("ss") / F.col("n") - mean * mean).alias("var"), "n")
    by = per.groupBy("o", "feat").agg(F.count("*").alias("found"), F.avg("value").alias("value"), F.avg("m").alias("group_norm"), F.avg(F.col("m") * F.col("m")).alias("mm"), F.avg("var").alias("v"), F.sum("n").alias("n"))
    spread = F.sqrt(F.greatest(F.col("v") + F.col("mm") - F.col("group_norm") * F.col("group_norm"), F.lit(0.0)))
    return by.crossJoin(F.broadcast(values)).where("found = k").select(F.col("o").alias("group_id"), "feat", "value", "group_norm", spread.alias("std_dev"), "n")


def regrouped(ft: DataFrame, members: DataFrame) -> DataFrame:
    """From groups to groups of them; members: (group_id, new_group)."""
    pairs = members.where(F.col("group_id").isNotNull() & F.col("new_group").isNotNull()).select("group_id", "new_group").distinct()
    sums = ft.join(pairs, "group_id").groupBy(F.col("new_group").alias("group_id"), "feat").agg(F.sum("value").alias("value"))
    totals = sums.groupBy("group_id").agg(F.sum("value").alias("total"))
    return sums.join(totals, "group_id").select("group_id", "feat", "value", (F.col("value") / F.col("total")).alias("group_norm"))


def binned(ft: DataFrame, sizes: DataFrame, bins: int) -> DataFrame:
    """Equal-frequency bins of numbered groups: one closes once it holds total / (bins + 2) members or more.

    ft: feature table with std_dev; sizes: (group_id, n), one row a numbered group. Whether a bin closes depends on
    where the last one did, so the list of sizes (one row a group of the bins' axis) is folded in one task.
    """
    axis = sizes.select(F.col("group_id").cast("long").alias("g"), F.col("n").cast("long").alias("n"))

    def fold(pdf):
        pdf = pdf.sort_values("g")
        limit, at, held, start, rows = pdf["n"].sum() / (bins + 2), 0, 0, None, []
        pending = []
        for g, n in zip(pdf["g"], pdf["n"]):
            start = g if start is None else start
            pending.append((g, n))
            held += n
            if held >= limit:
                rows += [(x, m, start, g) for x, m in pending]
                at, held, start, pending = at + 1, 0, None, []
        if pending:
            rows += [(x, m, start, pending[-1][0]) for x, m in pending]
        return type(pdf)(rows, columns=["group_id", "n", "lo", "hi"])

    placed = axis.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(fold, "group_id long, n long, lo long, hi long")
    about = placed.groupBy("lo", "hi").agg(F.sum("n").alias("bin_n"), (F.sum(F.col("n") * F.col("group_id")) / F.sum("n")).alias("bin_center_w"))
    rows = ft.withColumn("group_id", F.col("group_id").cast("long")).join(placed, "group_id").join(about, ["lo", "hi"])
    norm = F.col("group_norm")
    sums = rows.groupBy("lo", "hi", "feat", "bin_n", "bin_center_w").agg(
        F.sum("value").alias("value"), F.sum(norm * F.col("n")).alias("s"), F.sum(F.col("n") * norm * norm).alias("ss"), F.sum("n").alias("w"), F.sum(F.col("n") * F.col("std_dev") * F.col("std_dev")).alias("v")
    )
    mean = F.col("s") / F.col("bin_n")
    spread = F.sqrt(F.greatest((F.col("ss") - 2 * mean * F.col("s") + mean * mean * F.col("w") + F.col("v")) / F.col("bin_n"), F.lit(0.0)))
    return sums.select(
        F.concat_ws("_", "lo", "hi").alias("group_id"), "feat", "value", mean.alias("group_norm"), spread.alias("std_dev"), F.col("bin_n").alias("n"),
        ((F.col("lo") + F.col("hi")) / 2).alias("bin_center"), "bin_center_w", (F.col("hi") - F.col("lo") + 1).alias("bin_width"),
    )


def interpolated(series: DataFrame, days: int, min_points: int = 2) -> DataFrame:
    """Linear interpolation over a grid of days. series: (group_id, ts, feat, group_norm).

    Time is whole steps since the first timestamp of all; several values of a step are averaged; zeros are dropped; a
    group's feature needs min_points steps. One row `_<days>dInter` = 1 is added for each group and step.
    Between two known steps a sequence is exploded, so no grid of all steps is joined.
    """
    start = series.agg(F.min("ts").alias("t0"))
    step = F.floor(F.datediff(F.to_date("ts"), F.to_date("t0")) / F.lit(days)).cast("int")
    points = series.where("group_id IS NOT NULL AND feat IS NOT NULL AND ts IS NOT NULL").crossJoin(F.broadcast(start)).groupBy("group_id", "feat", step.alias("t")).agg(F.avg("group_norm").alias("y"))
    w = W.partitionBy("group_id", "feat")
    o = w.orderBy("t")
    known = points.withColumns({"t2": F.lead("t").over(o), "y2": F.lead("y").over(o), "k": F.count("*").over(w)}).where(F.col("k") >= min_points)
    ends = F.when(F.col("t2").isNull(), F.col("t")).otherwise(F.col("t2") - 1)
    grid = known.select("group_id", "feat", "t", "y", "t2", "y2", F.explode(F.sequence("t", ends)).alias("time"))
    y = F.when(F.col("t2").isNull(), F.col("y")).otherwise(F.col("y") + (F.col("y2") - F.col("y")) * (F.col("time") - F.col("t")) / (F.col("t2") - F.col("t")))
    rows = grid.select("group_id", "time", "feat", y.alias("group_norm")).where("group_norm <> 0")
    marks = rows.select("group_id", "time").distinct().select("group_id", "time", F.lit(f"_{days}dInter").alias("feat"), F.lit(1.0).alias("group_norm"))
    return rows.unionByName(marks)


def correlation_filter(ft: DataFrame, correlations: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Features with p <= alpha for any outcome; correlations: (outcome, feat, p)."""
    return ft.join(correlations.where(F.col("p") <= alpha).select("feat").distinct(), "feat", "left_semi")


def archetype_similarity(ft: DataFrame, archetypes: DataFrame, centre: bool = True, standardise: bool = False) -> DataFrame:
    """Cosine of each group to each archetype (group_id, feat, group_norm) over the archetypes' features.

    centre: the groups' means are taken from both; standardise: the groups' spreads divide the groups, each archetype's
    own spread over its features divides the archetype. Zeros are closed forms: for centred vectors x - m the product
    with an archetype vector v is sum(x v) over stored rows minus m.v.
    """
    feats = archetypes.select("feat").distinct()
    rows = ft.join(feats, "feat", "left_semi")
    groups = ft.select("group_id").distinct()
    n = groups.agg(F.count("*").alias("n"))
    by = rows.groupBy("feat").agg(F.sum("group_norm").alias("s"), F.sum(F.col("group_norm") * F.col("group_norm")).alias("ss"))
    mean = F.coalesce(F.col("s") / F.col("n"), F.lit(0.0))
    spread = F.sqrt(F.greatest(F.coalesce(F.col("ss") / F.col("n"), F.lit(0.0)) - mean * mean, F.lit(0.0)))
    moments = feats.join(by, "feat", "left").crossJoin(F.broadcast(n)).select("feat", (mean if centre else F.lit(0.0)).alias("m"), (F.when(spread > TINY, spread).otherwise(1.0) if standardise else F.lit(1.0)).alias("d"))
    every = archetypes.select(F.col("group_id").alias("arch")).distinct().crossJoin(moments)
    v = every.join(archetypes.select(F.col("group_id").alias("arch"), "feat", "group_norm"), ["arch", "feat"], "left").select("arch", "feat", "m", "d", (F.coalesce("group_norm", F.lit(0.0)) - F.col("m")).alias("v"))
    if standardise:
        own = v.groupBy("arch").agg(F.stddev_pop("v").alias("own"))
        v = v.join(own, "arch").select("arch", "feat", "m", "d", (F.col("v") / F.when(F.col("own") > TINY, F.col("own")).otherwise(1.0)).alias("v"))
    base = v.groupBy("arch").agg(F.sum(F.col("m") / F.col("d") * F.col("v")).alias("mv"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    x, m, d = F.col("group_norm"), F.col("m"), F.col("d")
    dots = rows.select("group_id", "feat", "group_norm").join(v, "feat").groupBy("group_id", "arch").agg(F.sum(x / d * F.col("v")).alias("xv"))
    zero = moments.agg(F.sum((m / d) * (m / d)).alias("mm"))
    lengths = rows.join(moments, "feat").groupBy("group_id").agg(F.sum((x / d) * (x / d) - 2 * x * m / (d * d)).alias("q"))
    all_ = groups.crossJoin(base).join(dots, ["group_id", "arch"], "left").join(lengths, "group_id", "left").crossJoin(F.broadcast(zero))
    size = F.sqrt(F.greatest(F.coalesce("q", F.lit(0.0)) + F.col("mm"), F.lit(0.0))) * F.col("length")
    cosine = F.when(size > TINY, (F.coalesce("xv", F.lit(0.0)) - F.col("mv")) / size)
    return all_.select("group_id", F.col("arch").alias("feat"), F.bround(cosine, 0).cast("int").alias("value"), cosine.alias("group_norm"))
