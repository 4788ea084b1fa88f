"""Sinks of results: correlation tables, prediction scores, outcome tables, example messages.

Files are written by Spark, as folders of parts; a wide table has one row a feature or group, so that rows stay distributed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lingmill.operators.association import correlation_matrix, significant, sorted_correlations


def _write(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", "\"").csv(path)


def write_correlation_matrix(results: DataFrame, outcomes: list[str], path: str) -> None:
    _write(correlation_matrix(results, outcomes), path)


def write_sorted_correlations(results: DataFrame, path: str) -> None:
    _write(sorted_correlations(results), path)


def combination_matrix(results: DataFrame, outcomes: list[str]) -> DataFrame:
    """correlation_matrix() of every set of controls (column controls), one row a set and feature."""
    keyed = results.withColumn("feat", F.concat_ws("\t", "controls", "feat"))
    wide = correlation_matrix(keyed, outcomes)
    at = F.instr("feature", "\t")
    return wide.withColumns({"controls": F.substr("feature", F.lit(1), at - 1), "feature": F.substr("feature", at + 1)})


def write_significant(results: DataFrame, path: str, alpha: float = 0.05) -> None:
    """Coefficients of p below alpha, by tabs."""
    _write(significant(results, alpha), path, "\t")


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line): one row of an HTML table for each row; significant ones, of a column p below .05, have the class sig."""
    cells = F.concat(*[F.concat(F.lit("<td>"), _escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns])
    head = F.when(F.col("p") < 0.05, F.lit('<tr class="sig">')).otherwise(F.lit("<tr>")) if "p" in rows.columns else F.lit("<tr>")
    return rows.select(F.concat(head, cells, F.lit("</tr>")).alias("line"))


def write_html(rows: DataFrame, columns: list[str], path: str, title: str = "Correlations") -> None:
    """A folder of parts to be read one after another: the head, the rows in their order, the end."""
    spark = rows.sparkSession
    names = "".join(f"<th>{c}</th>" for c in columns)
    line = lambda text: spark.createDataFrame([(text,)], "line string")
    page = line(f"<html><head><title>{title}</title></head><body><table><tr>{names}</tr>").unionByName(html_rows(rows, columns)).unionByName(line("</table></body></html>"))
    page.select(F.col("line").alias("value")).write.mode("overwrite").text(path)


# ---- predictions -----------------------------------------------------------------------------------------------------


def write_scores(metrics: DataFrame, path: str) -> None:
    """One row for each outcome, set of controls, and with or without language."""
    keys = [c for c in ("outcome", "controls", "with_language") if c in metrics.columns]
    _write(metrics.select(*keys, *[c for c in metrics.columns if c not in keys]), path)


def wide_predictions(predictions: DataFrame, outcomes: list[str], column: str = "prediction") -> DataFrame:
    """One row a group, for each outcome its true value and each prediction, by set of controls and language if these are columns."""
    parts = [F.coalesce("outcome", F.lit(""))]
    for c in ("controls", "with_language"):
        if c in predictions.columns:
            parts.append(F.col(c).cast("string"))
    keyed = predictions.withColumn("__k", F.concat_ws("|", *parts))
    names = sorted(r[0] for r in keyed.where(F.col("outcome").isin(outcomes)).select("__k").distinct().collect())  # as many as there are models
    true = [F.max(F.when(F.col("outcome") == o, F.col("y").cast("double"))).alias(f"{o}_true") for o in outcomes]
    return keyed.groupBy("group_id").agg(*true, *[F.max(F.when(F.col("__k") == k, F.col(column).cast("double"))).alias(k) for k in names])


def write_predictions(predictions: DataFrame, outcomes: list[str], path: str) -> None:
    _write(wide_predictions(predictions, outcomes), path)


def class_probabilities(predictions: DataFrame, classes: list[str]) -> DataFrame:
    """(group_id, outcome, class, probability) of an array column probability, its elements in the order of classes."""
    names = F.array(*[F.lit(c) for c in classes])
    each = F.explode(F.arrays_zip(names.alias("class"), F.col("probability").alias("p")))
    return predictions.select("group_id", *[c for c in ("outcome",) if c in predictions.columns], each.alias("e")).select("*", F.col("e.class").alias("class"), F.col("e.p").alias("probability")).drop("e")


def write_probabilities(predictions: DataFrame, classes: list[str], path: str) -> None:
    _write(class_probabilities(predictions, classes), path)


def create_outcome_table(df: DataFrame, name: str, if_exists: str = "fail") -> None:
    """A table of the catalog: `fail` or `replace` where there is one."""
    modes = {"fail": "errorifexists", "replace": "overwrite"}
    if if_exists not in modes:
        raise ValueError("if_exists is fail or replace")
    df.write.mode(modes[if_exists]).saveAsTable(name)


def messages_with_predictions(predictions: DataFrame, messages: DataFrame, group: str, message_id: str, message: str, groups: int = 20, per_group: int = 3) -> DataFrame:
    """(group_id, y, prediction, message_id, message): a report of the first groups' first messages."""
    first = predictions.select("group_id", "y", "prediction").orderBy("group_id").limit(groups)
    known = messages.where(F.col(group).isNotNull()).select(F.col(group).alias("group_id"), F.col(message_id).alias("message_id"), F.col(message).alias("message"))
    order = W.partitionBy("group_id").orderBy("message_id")
    # the groups are few: their messages alone are ranked
    return first.join(known.join(first.select("group_id"), "group_id", "left_semi").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= per_group).drop("__r"), "group_id")

