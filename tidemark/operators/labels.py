"""Resolution of labels from several reviewers, and comparisons between runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import ratio


def final_labels(first: DataFrame, second: DataFrame, adjudicated: DataFrame, key: str, label: str = "label") -> DataFrame:
    """The first reviewer's label unless a second disagreed: then the adjudicated one (null while it is open)."""
    d = first.select(key, F.col(label).alias("l1")).join(second.select(key, F.col(label).alias("l2"), F.lit(True).alias("has2")), key, "left").join(adjudicated.select(key, F.col(label).alias("la"), F.lit(True).alias("hasa")), key, "left")
    same = F.col("l1") == F.col("l2")
    final = F.when(F.col("has2").isNull(), F.col("l1")).when(same, F.col("l1")).otherwise(F.col("la"))
    origin = F.when(F.col("has2").isNull(), "reviewer_1").when(same, "agreed").when(F.col("hasa"), "adjudicated").otherwise("open")
    return d.select(key, final.alias("final_label"), origin.alias("origin"))


def double_review(first: DataFrame, second: DataFrame, key: str, label: str = "label") -> DataFrame:
    d = first.select(key, F.col(label).alias("label_1")).join(second.select(key, F.col(label).alias("label_2")), key)
    return d.withColumn("agree", F.col("label_1").eqNullSafe(F.col("label_2")))


def broken_agreements(first: DataFrame, second: DataFrame, adjudicated: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Rows on which both reviewers agreed but adjudication says otherwise."""
    d = double_review(first, second, key, label).where("agree").join(adjudicated.select(key, F.col(label).alias("adjudicated")), key)
    return d.where("adjudicated <> label_1").select(key, F.col("label_1").alias("agreed"), "adjudicated")


def raw_agreement(rows: DataFrame, a: str, b: str, uncertain: str = "uncertain") -> DataFrame:
    same = (F.col(a) == F.col(b)).cast("int")
    sure = (F.col(a) != uncertain) & (F.col(b) != uncertain)
    return rows.agg(F.count("*").alias("n"), F.avg(same).alias("agreement"), F.count_if(sure).alias("n_certain"), F.avg(F.when(sure, same)).alias("agreement_certain"))


def multilabel_by_code(rows: DataFrame, truth: str, predicted: str, codes: Sequence[str]) -> DataFrame:
    """Per code: tp, fp, fn, precision, recall, F1 and the share of rows that agree on its presence; one pass."""
    x = F.explode(F.array(*map(F.lit, codes)))
    r = rows.select(truth, predicted, x.alias("code"))
    a, b = F.expr(f"array_contains({truth}, code)"), F.expr(f"array_contains({predicted}, code)")
    g = r.groupBy("code").agg(F.count_if(a & b).alias("tp"), F.count_if(~a & b).alias("fp"), F.count_if(a & ~b).alias("fn"), F.count("*").alias("n"))
    tp, fp, fn = map(F.col, ("tp", "fp", "fn"))
    return g.select("code", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ((F.col("n") - fp - fn) / F.col("n")).alias("presence_agreement"))


def deltas(metrics: DataFrame, route: str, columns: Sequence[str]) -> DataFrame:
    """Differences of metrics between every two routes."""
    a, b = metrics.alias("a"), metrics.alias("b")
    j = a.join(b, F.col(f"a.{route}") < F.col(f"b.{route}"))
    return j.select(F.col(f"a.{route}").alias(route), F.col(f"b.{route}").alias("against"), *((F.col(f"a.{c}") - F.col(f"b.{c}")).alias(f"delta_{c}") for c in columns))


def overfit_gap(metrics: DataFrame, split: str = "split", metric: str = "f1", limit: float = 0.15) -> DataFrame:
    at = lambda s: F.max(F.when(F.col(split) == s, F.col(metric)))
    gap = at("train") - at("validation")
    return metrics.agg(gap.alias("gap"), (gap >= limit).alias("overfit"))


def error_rows(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    return rows.where(F.col(label) != F.col(predicted)).withColumn("error", F.when(F.col(label) == 1, "FN").otherwise("FP"))
