"""Deterministic sampling: seeded hash orders instead of random numbers, so any engine can replay it."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_order

BUCKETS = ("high_uncertainty", "rating_keyword_disagreement", "diversity_control")
# fixed values: shares of the balanced selection
RATING_SHARES = {"low_1_2": 0.35, "middle_3": 0.20, "high_4_5": 0.45}
TIME_SHARES = {"early_2011_2017": 1 / 3, "middle_2018_2020": 1 / 3, "recent_2021_2023": 1 / 3}
HIT_SHARES = {"hit": 0.5, "non_hit": 0.5}


def proportional_targets(total: int, shares: Mapping[str, float]) -> dict[str, int]:
    """Largest remainders; of equal ones the greater key first."""
    floors = {k: math.floor(total * s) for k, s in shares.items()}
    by_rest = sorted(shares, key=lambda k: (total * shares[k] - floors[k], k), reverse=True)
    for k in by_rest[: total - sum(floors.values())]:
        floors[k] += 1
    return floors


def apportion(shares: DataFrame, key: str, share: str, total: int) -> DataFrame:
    """proportional_targets over a table of shares."""
    raw = F.lit(float(total)) * F.col(share)
    d = shares.withColumn("__f", F.floor(raw)).withColumn("__r", raw - F.floor(raw))
    left = F.lit(total) - F.sum("__f").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("__r"), F.desc(key)))
    return d.select(key, (F.col("__f") + (place <= left).cast("long")).alias("target"))


def bucket_targets(total: int, shares: Mapping[str, float]) -> dict[str, int]:
    """Floors for the two risk buckets; the control bucket takes what is left."""
    a, b = (math.floor(total * shares[k]) for k in BUCKETS[:2])
    return {BUCKETS[0]: a, BUCKETS[1]: b, BUCKETS[2]: total - a - b}


def assign_bucket(score: Column, low_star: Column, keyword: Column, band: tuple[float, float] = (0.40, 0.60)) -> Column:
    """Uncertain before disagreeing before control."""
    return F.when(score.between(*band), BUCKETS[0]).when(low_star != keyword, BUCKETS[1]).otherwise(BUCKETS[2])


def round_robin(rows: DataFrame, buckets: Sequence[str], order: Column, n: int, tie: Sequence[str]) -> DataFrame:
    """n rows, one of each bucket in turn while it lasts."""
    k = F.row_number().over(Window.partitionBy(*buckets).orderBy(order, *tie))
    # a bucket gives at most n rows, so rank limits are pushed below the sort
    return rows.withColumn("round", k).where(F.col("round") <= n).orderBy("round", *buckets).limit(n)


def diversity_order(rows: DataFrame, seed: int, purpose: str, parent: str, key: str, stratum: Sequence[str]) -> DataFrame:
    """rows with parent_round, stratum_hash and row_hash; sorted by those three and the key, parents take turns."""
    d = rows.withColumn("row_hash", seeded_order(seed, F.lit(purpose), F.col(key))).withColumn("stratum_hash", seeded_order(seed, F.lit(f"{purpose}|stratum"), F.concat_ws("|", *(F.col(c).cast("string") for c in stratum))))
    return d.withColumn("parent_round", F.row_number().over(Window.partitionBy(parent).orderBy("row_hash", key)) - 1)


ORDER = ("parent_round", "stratum_hash", "row_hash")


def bucket_mix(pool: DataFrame, total: int, shares: Mapping[str, float], seed: int, purpose: str, parent: str, key: str, stratum: Sequence[str], bucket: str = "bucket") -> DataFrame:
    """total rows with the buckets in shares, shortfalls filled from what is left; stage tells which pass took a row.

    A pool with fewer rows is refused.
    """
    if pool.limit(total).count() < total:
        raise ValueError(f"the pool has fewer than {total} rows")
    targets = bucket_targets(total, shares)
    taken = None
    for b in BUCKETS:
        d = diversity_order(pool.where(F.col(bucket) == b), seed, f"{purpose}|bucket={b}", parent, key, stratum)
        part = d.orderBy(*ORDER, key).limit(targets[b]).select(*pool.columns).withColumn("stage", F.lit("bucket"))
        taken = part if taken is None else taken.unionByName(part)
    rest = diversity_order(pool.join(taken.select(key), key, "left_anti"), seed, f"{purpose}|fallback", parent, key, stratum)
    # the fallback rows keep their own order: at most total are numbered, and as many are kept as the buckets lack
    fill = rest.orderBy(*ORDER, key).limit(total).withColumn("__k", F.row_number().over(Window.orderBy(*ORDER, key)))
    lack = taken.agg((F.lit(total) - F.count("*")).alias("__m"))
    fill = fill.crossJoin(F.broadcast(lack)).where(F.col("__k") <= F.col("__m")).select(*pool.columns).withColumn("stage", F.lit("fallback"))
    return taken.unionByName(fill)


def balanced_select(pool: DataFrame, quota: int, seed: int, purpose: str, group: str) -> DataFrame:
    """quota rows of each group by greedy balance: the row whose parent, keyword, rating and period are least used.

    Each choice depends on all before it, so a group is chosen in one task.  It gets only the columns that the choice
    needs, and only rows that can be chosen: of a combination of keyword, rating and period the quota first parents by
    their first row, and the quota first rows of each.  A row behind those always stands behind an unused one of equal
    pressure, so a task has at most quota squared rows a combination.  Ties go by a seeded hash.  pool: duplicate_key,
    parent_asin, keyword_candidate_hit, rating_stratum, time_stratum and group.
    """
    slim = pool.select(group, "duplicate_key", "parent_asin", "keyword_candidate_hit", "rating_stratum", "time_stratum", seeded_order(seed, F.lit(purpose), F.col("duplicate_key")).alias("order"))

    kinds = [group, "keyword_candidate_hit", "rating_stratum", "time_stratum"]
    slim = slim.withColumn("__n", F.row_number().over(Window.partitionBy(*kinds, "parent_asin").orderBy("order", "duplicate_key"))).where(F.col("__n") <= quota)
    heads = slim.where("__n = 1").withColumn("__h", F.row_number().over(Window.partitionBy(*kinds).orderBy("order", "duplicate_key"))).where(F.col("__h") <= quota)
    same = F.lit(True)
    a, b = slim.alias("a"), heads.select(*kinds, "parent_asin").alias("b")
    for c in (*kinds, "parent_asin"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    slim = a.join(b, same, "left_semi").drop("__n")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        take = greedy_balance(pdf.to_dict("records"), min(quota, len(pdf)))
        return pd.DataFrame({group: [r[group] for r in take], "duplicate_key": [r["duplicate_key"] for r in take], "place": range(1, len(take) + 1)})

    kind = pool.schema[group].dataType.simpleString()
    key = pool.schema["duplicate_key"].dataType.simpleString()
    return slim.groupBy(group).applyInPandas(choose, f"{group} {kind}, duplicate_key {key}, place int")


def greedy_balance(rows: list[dict], quota: int) -> list[dict]:
    """Rows of equal attributes differ only in their order, so one candidate per attribute combination is compared."""
    wants = {"k": proportional_targets(quota, HIT_SHARES), "r": proportional_targets(quota, RATING_SHARES), "t": proportional_targets(quota, TIME_SHARES)}
    queues: dict[tuple, list[dict]] = {}
    for r in sorted(rows, key=lambda r: r["order"], reverse=True):
        queues.setdefault((r["parent_asin"], "hit" if r["keyword_candidate_hit"] else "non_hit", r["rating_stratum"], r["time_stratum"]), []).append(r)
    used: dict[tuple, int] = {}
    out: list[dict] = []
    while len(out) < quota:
        def pressure(q: tuple) -> tuple:
            share = lambda kind, v: used.get((kind, v), 0) / max(wants[kind].get(v, 0), 1)
            return used.get(("p", q[0]), 0), share("k", q[1]), share("r", q[2]), share("t", q[3]), queues[q][-1]["order"]

        best = min(queues, key=pressure)
        out.append(queues[best].pop())
        if not queues[best]:
            del queues[best]
        for kind, v in zip("pkrt", best, strict=True):
            used[kind, v] = used.get((kind, v), 0) + 1
    return out


def batches(pool: DataFrame, key: str, group: str, seed: int, quotas: Mapping[str, int], n_batches: int) -> DataFrame:
    """n_batches disjoint batches with a quota for each group: one ranked pass, cut into runs of the quota."""
    q = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(group))
    k = F.row_number().over(Window.partitionBy(group).orderBy(seeded_order(seed, F.col(key)), key))
    d = pool.withColumn("__q", q).where("__q > 0").withColumn("__k", k).where(F.col("__k") <= F.col("__q") * n_batches)
    return d.withColumn("batch", F.floor((F.col("__k") - 1) / F.col("__q")).cast("int") + 1).drop("__q", "__k")


def bootstrap_draws(clusters: DataFrame, cluster: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, cluster, times): clusters drawn with replacement, as many as there are, by hash.

    Draws are counts, so a cluster's rows are weighted and not copied.
    """
    spark = clusters.sparkSession
    places = clusters.select(cluster).distinct().withColumn("place", F.row_number().over(Window.orderBy(cluster)) - 1)
    n = places.agg(F.count("*").alias("n"))
    slots = places.select(F.col("place").alias("slot")).crossJoin(F.broadcast(spark.range(replicates).withColumnRenamed("id", "replicate"))).crossJoin(F.broadcast(n))
    h = F.conv(F.substring(seeded_order(seed, F.col("replicate"), F.col("slot")), 1, 12), 16, 10).cast("bigint")
    drawn = slots.withColumn("place", (h % F.col("n")).cast("int")).groupBy("replicate", "place").agg(F.count("*").alias("times"))
    return drawn.join(places, "place").select("replicate", cluster, "times")


def bootstrap_interval(replicated: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return replicated.groupBy(*keys).agg(F.count(value).alias("n_replicates"), F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high")).withColumn("crosses_zero", (F.col("low") <= 0) & (F.col("high") >= 0))
