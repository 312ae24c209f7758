"""Three-valued quality targets and chronological splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

# fixed values: thresholds of deterioration (hundredths) and support
DROP, RISE = 30, 10
DROPS, RISES = (20, 30, 40), (5, 10, 15)
SUPPORT = {"current": 5, "history": 10, "future": 10}
ROBUST = (10, 20)


def deterioration(h: int, drop: int = DROP, rise: int = RISE) -> tuple[Column, Column]:
    """Whether the mean rating falls by drop hundredths, and the low-star share rises by rise hundredths, in h months.

    Compared in whole numbers: hist and fut means are ratios of counts, and thresholds lie on their steps.
    """
    n, N = F.col("hist_n_reviews"), F.col(f"fut_n_reviews_{h}")
    fell = F.col(f"fut_rating_sum_{h}") * n * 100 <= F.col("hist_rating_sum") * N * 100 - drop * n * N
    rose = F.col(f"fut_low_star_count_{h}") * n * 100 >= F.col("hist_low_star_count") * N * 100 + rise * n * N
    return fell, rose


def quality_targets(windows: DataFrame, horizons: Sequence[int] = (1, 2, 3), device: str | None = "device") -> DataFrame:
    """Targets 1, 0 or null (not known) for each horizon, their sensitivity variants, support and eligibility.

    Eligible are supported rows with a known target, of any device type but the case study's.
    """
    out: dict[str, Column] = {}
    for h in horizons:
        valid = F.coalesce(F.col("hist_complete") & F.col(f"fut_complete_{h}") & (F.col("hist_n_reviews") > 0) & (F.col(f"fut_n_reviews_{h}") > 0), F.lit(False))
        fell, rose = deterioration(h)
        out |= {f"target_rating_drop_{h}": F.when(valid, fell.cast("int")), f"target_low_star_rise_{h}": F.when(valid, rose.cast("int")), f"target_any_{h}": F.when(valid, (fell | rose).cast("int"))}
        for a in DROPS:
            for b in RISES:
                x, y = deterioration(h, a, b)
                out[f"target_any_{h}_d{a}_r{b}"] = F.when(valid, (x | y).cast("int"))
        supported = F.coalesce((F.col("n_reviews") >= SUPPORT["current"]) & (F.col("hist_n_reviews") >= SUPPORT["history"]) & (F.col(f"fut_n_reviews_{h}") >= SUPPORT["future"]), F.lit(False))
        role = F.col(device) != "smart_switch" if device else F.lit(True)
        out |= {f"supported_{h}": supported, f"eligible_{h}": supported & valid & role}
        out |= {f"eligible_{h}_ge{k}": supported & valid & role & (F.col("n_reviews") >= k) for k in ROBUST}
    return windows.withColumns(out)


def month_split(rows: DataFrame, eligible: str, index: str = "m", embargo: int = 3, shares: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """rows with split: train, validation and test by distinct eligible months, with embargoed months between.

    Fewer than five eligible months are refused (every row is then not_eligible).  The embargo is in calendar months and
    is measured from the last month that was kept.  rows are written once, since both their months and they are read.
    """
    rows = cut(rows)
    months = rows.where(F.col(eligible)).select(index).distinct()
    one = Window.orderBy(index)  # months of the calendar: a bounded table
    n = F.count("*").over(Window.partitionBy())
    train_n = F.greatest(F.lit(1), F.floor(n * shares[0]))
    val_n = F.least(F.greatest(train_n + 1, F.floor(n * shares[1])), n - 1)
    k = F.row_number().over(one)
    raw = F.when(k <= train_n, "train").when(k <= val_n, "validation").otherwise("test")
    m = months.select(index, raw.alias("raw"), n.alias("n")).where("n >= 5")
    all_ = Window.partitionBy()
    m = m.withColumn("last_train", F.max(F.when(F.col("raw") == "train", F.col(index))).over(all_))
    m = m.withColumn("kept_val", (F.col("raw") == "validation") & (F.col(index) > F.col("last_train") + embargo))
    m = m.withColumn("last_val", F.max(F.when(F.col("kept_val"), F.col(index))).over(all_))
    split = F.when(F.col("raw") == "train", "train").when(F.col("kept_val"), "validation").when(F.col("raw") == "validation", "embargo_train_validation").when(F.col("last_val").isNull() | (F.col(index) > F.col("last_val") + embargo), "test").otherwise("embargo_validation_test")
    named = m.select(F.col(index).alias("__m"), split.alias("__split"))
    joined = rows.join(F.broadcast(named), F.col(index) == F.col("__m"), "left")
    return joined.withColumn("split", F.when(F.col(eligible) & F.col("__split").isNotNull(), F.col("__split")).otherwise("not_eligible")).drop("__m", "__split")


def boundary_split(month: Column, bounds: Sequence[tuple[str, str]], last: str) -> Column:
    """A split by fixed first days: bounds are (name, last day) in order, then `last`."""
    out = None
    for name, end in bounds:
        hit = month <= F.lit(end).cast("date")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(month.isNotNull(), out.otherwise(last))


def row_split(rows: DataFrame, order: Sequence[str], shares: tuple[float, float] = (0.6, 0.8)) -> DataFrame:
    """rows with split by place in a total order: floor(n * share) rows train, then validation, then test.

    Places are counted without one global window: rows are range-partitioned by the order, numbered within their
    partition, and offset by the counts of the partitions before.
    """
    d = ranked(rows, order)
    n = rows.agg(F.count("*").alias("__n"))
    d = d.crossJoin(F.broadcast(n))
    return d.withColumn("split", F.when(F.col("place") <= F.floor(F.col("__n") * shares[0]), "train").when(F.col("place") <= F.floor(F.col("__n") * shares[1]), "validation").otherwise("test")).drop("__n")


def ranked(rows: DataFrame, order: Sequence[str], place: str = "place", before: dict[str, Column] | None = None) -> DataFrame:
    """rows with their place, from 1, in a total order; before: sums of columns over all rows before.

    Scales with the rows: they are range-partitioned, and only a row a partition meets in one task.
    """
    before = before or {}
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    s = rows.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id())
    s = cut(s)  # range bounds are sampled anew each time: both uses below must see the same partitions
    inside = Window.partitionBy("__p").orderBy(*order)
    prior = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    s = s.withColumns({"__k": F.row_number().over(inside)} | {f"__b_{n}": zero(F.sum(c).over(prior(inside))) for n, c in before.items()})
    counts = s.groupBy("__p").agg(F.count("*").alias("__c"), *(F.sum(c).alias(f"__c_{n}") for n, c in before.items()))
    offset = counts.select("__p", *(zero(F.sum(f"__c{x}").over(prior(Window.orderBy("__p")))).alias(f"__o{x}") for x in ("", *(f"_{n}" for n in before))))
    out = s.join(F.broadcast(offset), "__p").withColumns({place: F.col("__o") + F.col("__k")} | {n: F.col(f"__o_{n}") + F.col(f"__b_{n}") for n in before})
    return out.drop("__p", "__k", "__o", *(f"__{x}_{n}" for x in "bo" for n in before))


def split_check(rows: DataFrame, index: str = "m", split: str = "split") -> DataFrame:
    """First and last month of each split; chronological if none overlaps the next."""
    g = rows.groupBy(split).agg(F.min(index).alias("first_m"), F.max(index).alias("last_m"), F.count("*").alias("n"))
    order = F.array_position(F.array(*map(F.lit, ("train", "validation", "test"))), F.col(split))
    g = g.where(order > 0)
    prior = F.max("last_m").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return g.withColumn("after_prior", F.coalesce(F.col("first_m") > prior, F.lit(True)))


def leaking_keys(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    return rows.groupBy(key).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")
