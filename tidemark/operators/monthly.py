"""Review rows to product-month rows.  Every aggregate is one hash aggregation with a partial step before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_STAR = 2
KEYS = ("product", "review_month")


def share(n: Column, of: Column) -> Column:
    """n / of as a double; null where of is 0 or null."""
    return F.when(of != 0, n.cast("double") / of)


def rating_months(reviews: DataFrame, keys: Sequence[str] = ("product", "device", "review_month", "m")) -> DataFrame:
    """n_reviews, rating_sum, low_star_count, mean_rating and low_star_share for each key; null keys are left out."""
    r = reviews.dropna(subset=list(keys))
    g = r.groupBy(*keys).agg(F.count("*").alias("n_reviews"), F.sum("rating").cast("long").alias("rating_sum"), F.count_if(F.col("rating") <= LOW_STAR).alias("low_star_count"))
    return g.withColumn("mean_rating", share(F.col("rating_sum"), F.col("n_reviews"))).withColumn("low_star_share", share(F.col("low_star_count"), F.col("n_reviews")))


def failure_months(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts, shares and the mean, median (exact) and maximum of probabilities; null keys make a group of their own."""
    p = F.col("probability")
    return predictions.groupBy(*keys).agg(F.count("*").alias("n_reviews"), F.sum("prediction").cast("long").alias("failure_count"), F.avg("prediction").alias("failure_share"), F.avg(p).alias("mean_probability"), F.percentile(p, 0.5).alias("median_probability"), F.max(p).alias("max_probability"))


def mean_months(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n_reviews"), *(F.avg(c).alias(f"mean_{c}") for c in columns))


def category_months(rows: DataFrame, codes: Sequence[str], keys: Sequence[str], codes_col: str = "codes", separator: str = ";") -> DataFrame:
    """Hits and overlapping counts of each code in a separated list; a row may count for several codes."""
    have = F.split(F.coalesce(F.col(codes_col), F.lit("")), separator)
    r = rows.withColumn("__c", F.filter(have, lambda x: x != ""))
    return r.groupBy(*keys).agg(F.count("*").alias("n_reviews"), F.count_if(F.size("__c") > 0).alias("hits"), *(F.count_if(F.array_contains("__c", c)).alias(f"n_{c.lower()}") for c in codes)).withColumn("hit_share", share(F.col("hits"), F.col("n_reviews")))


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def with_total(df: DataFrame, key: str, aggs: Mapping[str, Column], total: str = "ALL") -> DataFrame:
    """Aggregates for each value of key and over all rows; the total row is told by grouping(), not by a null key."""
    g = df.rollup(key).agg(F.grouping(key).alias("__all"), *(c.alias(n) for n, c in aggs.items()))
    return g.select(F.when(F.col("__all") == 1, F.lit(total)).otherwise(F.col(key)).alias("scope"), *aggs)


def histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Counts in [lo, hi) between edges, the last closed; empty bins stay.  Values outside are counted in bin -1."""
    x, last = F.col(value), len(edges) - 2
    b = F.lit(-1)
    for k in range(last + 1):
        up = x <= edges[k + 1] if k == last else x < edges[k + 1]
        b = F.when((x >= edges[k]) & up, F.lit(k)).otherwise(b)
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    spark = df.sparkSession
    bins = spark.createDataFrame([(k, float(a), float(z)) for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, lo double, hi double")
    return bins.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def distribution(df: DataFrame, value: str, quantiles: Sequence[float] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99), keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, extremes, population deviation and exact quantiles by linear interpolation."""
    x = F.col(value)
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_pop(x).alias("std"), *(F.percentile(x, q).alias(f"p{round(q * 100):02d}") for q in quantiles))
