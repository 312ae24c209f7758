"""Windows over calendar months.

With an integer month index, frames by RANGE see gaps as gaps, so the sparse table of observed months gives the same
sums as a dense grid of every product and month, at the size of the observations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import month_of_index
from .monthly import share

MEASURES = ("n_reviews", "rating_sum", "low_star_count")


def trailing_and_leading(months: DataFrame, product: str = "product", index: str = "m", horizons: Sequence[int] = (1, 2, 3), history: int = 3) -> DataFrame:
    """Sums over the last `history` months and the next h, for observed months.

    hist_complete and fut_complete_h say whether the frames lie within the months of the whole table; sums of frames
    that do not are null, as are future sums, means and shares over no reviews.
    """
    ends = months.agg(F.min(index).alias("first_m"), F.max(index).alias("last_m"))  # one row
    w = Window.partitionBy(product).orderBy(index)
    d = months.crossJoin(F.broadcast(ends))
    d = d.withColumn("hist_complete", F.col(index) - F.col("first_m") >= history - 1)
    for c in MEASURES:
        d = d.withColumn(f"hist_{c}", F.when(F.col("hist_complete"), F.sum(c).over(w.rangeBetween(-(history - 1), 0))))
    d = d.withColumn("hist_mean", share(F.col("hist_rating_sum"), F.col("hist_n_reviews"))).withColumn("hist_low_share", share(F.col("hist_low_star_count"), F.col("hist_n_reviews")))
    for h in horizons:
        d = d.withColumn(f"fut_complete_{h}", F.col(index) + h <= F.col("last_m"))
        for c in MEASURES:
            d = d.withColumn(f"fut_{c}_{h}", F.when(F.col(f"fut_complete_{h}"), F.coalesce(F.sum(c).over(w.rangeBetween(1, h)), F.lit(0))))
        d = d.withColumn(f"fut_mean_{h}", share(F.col(f"fut_rating_sum_{h}"), F.col(f"fut_n_reviews_{h}"))).withColumn(f"fut_low_share_{h}", share(F.col(f"fut_low_star_count_{h}"), F.col(f"fut_n_reviews_{h}")))
    return d.drop("first_m", "last_m")


def dense_grid(months: DataFrame, product: str = "product", index: str = "m") -> DataFrame:
    """Every product in every month of the table's span, measures 0 where nothing was observed."""
    ends = months.agg(F.min(index).alias("a"), F.max(index).alias("b"))
    grid = months.select(product).distinct().crossJoin(F.broadcast(ends)).select(product, F.explode(F.sequence("a", "b")).alias(index))
    d = grid.join(months.select(product, index, *MEASURES), [product, index], "left")
    return d.select(product, index, month_of_index(F.col(index)).alias("review_month"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in MEASURES), F.col("n_reviews").isNotNull().alias("observed"))


def dense_windows(grid: DataFrame, product: str = "product", index: str = "m", horizon: int = 3, history: int = 3) -> DataFrame:
    """The same sums from a dense grid by ROWS frames (a cross-check of the sparse form)."""
    w = Window.partitionBy(product).orderBy(index)
    d = grid
    for c in MEASURES:
        back, ahead = w.rowsBetween(-(history - 1), 0), w.rowsBetween(1, horizon)
        d = d.withColumn(f"hist_{c}", F.when(F.count("*").over(back) == history, F.sum(c).over(back))).withColumn(f"fut_{c}", F.when(F.count("*").over(ahead) == horizon, F.sum(c).over(ahead)))
    return d


def complaint_signals(months: DataFrame, value: str, product: str = "product", index: str = "m") -> DataFrame:
    """Extensions: change against the month before, and deviation from the product's own past."""
    w = Window.partitionBy(product).orderBy(index)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    mean, sd = F.avg(value).over(past), F.stddev_pop(value).over(past)
    return months.withColumn("acceleration", F.col(value) - F.lag(value).over(w)).withColumn("burst", F.when(sd > 1e-9, (F.col(value) - mean) / sd))
