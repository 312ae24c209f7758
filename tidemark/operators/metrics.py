"""Agreement and classifier metrics, as aggregates over (label, prediction) rows.

Threshold-free metrics group equal scores first and sum along them by range partitions: no key gathers its scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .targets import ranked


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def confusion(rows: DataFrame, label: str, predicted: str, labels: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Counts for every pair of labels, also those that do not occur; rows with a null are left out."""
    spark = rows.sparkSession
    counts = rows.dropna(subset=[label, predicted]).groupBy(*keys, F.col(label).cast("int").alias("true_label"), F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("__n"))
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], "true_label int, predicted int")
    if keys:
        grid = rows.select(*keys).distinct().crossJoin(F.broadcast(grid))
    return grid.join(counts, [*keys, "true_label", "predicted"], "left").select(*keys, "true_label", "predicted", F.coalesce("__n", F.lit(0)).cast("long").alias("n"))


def binary_metrics(rows: DataFrame, label: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp and the usual ratios, which are 0 where their denominator is."""
    y, p = F.col(label), F.col(predicted)
    c = rows.where(y.isNotNull() & p.isNotNull()).groupBy(*keys).agg(*(F.count_if((y == a) & (p == b)).alias(n) for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))))
    tn, fp, fn, tp = map(F.col, ("tn", "fp", "fn", "tp"))
    prec, rec, spec = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    return c.select(*keys, "tn", "fp", "fn", "tp", ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"), ((rec + spec) / 2).alias("balanced_accuracy"), prec.alias("precision"), rec.alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), spec.alias("specificity"))


def _by_score(rows: DataFrame, label: str, score: str, keys: Sequence[str]) -> DataFrame:
    return rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n")).withColumn("neg", F.col("n") - F.col("pos"))


def roc_auc(rows: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """The share of (negative, positive) pairs in order, ties counting half; null unless both classes occur."""
    # sums over all lower scores, also of keys before; what those keys have is the least of a key's sums
    d = ranked(_by_score(rows, label, score, keys), [*keys, "s"], before={"below": F.col("neg")})
    u2 = F.sum(F.col("pos") * (2 * F.col("below") + F.col("neg"))) - 2 * F.min("below") * F.sum("pos")
    g = d.groupBy(*keys).agg(u2.alias("u2"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    return g.select(*keys, F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("u2") / (2 * F.col("p") * F.col("q"))).alias("roc_auc"))


def average_precision(rows: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean precision at each distinct score, weighted by the recall it adds (no interpolation)."""
    d = ranked(_by_score(rows, label, score, keys), [*(F.col(k) for k in keys), F.desc("s")], before={"tp": F.col("pos"), "all": F.col("n")})
    if keys:  # less what the keys before have
        first = d.groupBy(*keys).agg(F.min("tp").alias("tp0"), F.min("all").alias("all0"))
        d = d.join(first, list(keys)).withColumns({"tp": F.col("tp") - F.col("tp0"), "all": F.col("all") - F.col("all0")})
    d = d.withColumns({"tp": F.col("tp") + F.col("pos"), "all": F.col("all") + F.col("n")})
    g = d.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("tp") / F.col("all"))).alias("a"), F.sum("pos").alias("p"))
    return g.select(*keys, F.when(F.col("p") > 0, F.col("a") / F.col("p")).alias("average_precision"))


def brier(rows: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg(F.pow(F.col(score) - F.col(label), F.lit(2.0))).alias("brier"))


def calibration(rows: DataFrame, label: str, score: str, bins: int = 10, right_closed: bool = True) -> DataFrame:
    """bin, n, mean_score, observed and gap for every bin; bins are (lo, hi] or [lo, hi), the ends clamped."""
    x = F.col(score) * bins
    b = (F.ceil(x) - 1 if right_closed else F.floor(x)).cast("int")
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), b))
    g = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("__n"), F.avg(score).alias("mean_score"), F.avg(label).alias("observed"))
    grid = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(g, "bin", "left").select("bin", F.coalesce("__n", F.lit(0)).cast("long").alias("n"), "mean_score", "observed", F.abs(F.col("mean_score") - F.col("observed")).alias("gap"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"))


def kappa(rows: DataFrame, a: str, b: str, levels: Sequence[int], weights: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa, plain or with linear or quadratic weights; null where chance agreement is certain."""
    c = confusion(rows, a, b, levels, keys)
    place = {v: i for i, v in enumerate(levels)}
    at = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])
    d = F.abs(at[F.col("true_label")] - at[F.col("predicted")]).cast("double")
    w = {None: (d > 0).cast("double"), "linear": d, "quadratic": d * d}[weights]
    rowsum = F.sum("n").over(Window.partitionBy(*keys, "true_label"))
    colsum = F.sum("n").over(Window.partitionBy(*keys, "predicted"))
    t = c.withColumn("w", w).withColumn("e", rowsum * colsum)
    g = t.groupBy(*keys).agg(F.sum(F.col("w") * F.col("n")).alias("o"), F.sum(F.col("w") * F.col("e")).alias("x"), F.sum("n").alias("t"), F.sum(F.when(F.col("true_label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("same"))
    return g.select(*keys, F.col("t").alias("n"), F.when(F.col("t") > 0, F.col("same") / F.col("t")).alias("agreement"), F.when(F.col("x") > 0, 1 - F.col("o") * F.col("t") / F.col("x")).alias("kappa"))


def ordinal_metrics(rows: DataFrame, label: str, predicted: str, levels: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, mean absolute error and macro F1 over the levels (F1 0 for a level that never occurs on either side)."""
    c = confusion(rows, label, predicted, levels, keys)
    agg = [F.sum("n").alias("n"), F.sum(F.when(F.col("true_label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("same"), F.sum(F.abs(F.col("true_label") - F.col("predicted")) * F.col("n")).alias("err")]
    for v in levels:
        agg += [F.sum(F.when((F.col("true_label") == v) & (F.col("predicted") == v), 2 * F.col("n")).otherwise(0)).alias(f"t{v}"), F.sum(F.when(F.col("true_label") == v, F.col("n")).otherwise(0) + F.when(F.col("predicted") == v, F.col("n")).otherwise(0)).alias(f"s{v}")]
    g = c.groupBy(*keys).agg(*agg)
    f1 = sum((ratio(F.col(f"t{v}"), F.col(f"s{v}")) for v in levels), F.lit(0.0)) / len(levels)
    return g.select(*keys, "n", (F.col("same") / F.col("n")).alias("accuracy"), (F.col("err") / F.col("n")).alias("mae"), f1.alias("macro_f1"))


def closeness(left: DataFrame, right: DataFrame, keys: Sequence[str], score: str, predicted: str, atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """How far a rerun's predictions and scores are from the first run's."""
    j = left.alias("l").join(right.alias("r"), list(keys))
    a, b = F.col(f"l.{score}"), F.col(f"r.{score}")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col(f"l.{predicted}") != F.col(f"r.{predicted}")).alias("prediction_mismatches"), F.count_if(F.abs(a - b) > atol + rtol * F.abs(b)).alias("score_mismatches"), F.max(F.abs(a - b)).alias("max_diff"), F.avg(F.abs(a - b)).alias("mean_diff"))


def precision_at(rows: DataFrame, label: str, score: str, tie: Sequence[str], ks: Sequence[int]) -> DataFrame:
    """Precision and recall among the k highest scores (an extension)."""
    n = rows.agg(F.sum(F.col(label).cast("long")).alias("p"))
    top = rows.orderBy(F.desc(score), *tie).limit(max(ks)).withColumn("k", F.row_number().over(Window.orderBy(F.desc(score), *tie)))
    each = top.crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(k,) for k in ks], "cut int"))).where("k <= cut").groupBy("cut").agg(F.sum(F.col(label).cast("long")).alias("hit"), F.count("*").alias("n"))
    return each.crossJoin(F.broadcast(n)).select("cut", (F.col("hit") / F.col("n")).alias("precision"), F.when(F.col("p") > 0, F.col("hit") / F.col("p")).alias("recall"))
