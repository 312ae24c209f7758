"""Deduplication, merging of candidates, and audits of keys and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: domains in order of preference
DOMAIN_ORDER = {"Electronics": 1, "Home_and_Kitchen": 2}


def first_of_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in order (which must be total for a stable result)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def dedup_reviews(rows: DataFrame, key: str = "duplicate_key") -> DataFrame:
    """Per key the richest row: most non-empty fields, longest text, preferred domain, first row number, then ids."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DOMAIN_ORDER.items() for x in kv]), F.col("source_domain")), F.lit(999))
    order = [F.desc("nonempty_fields"), F.desc(F.length("text")), rank, F.col("row_number"), F.col("parent_asin"), F.coalesce("asin", F.lit(""))]
    return first_of_key(rows, [key], order).select(*[c for c in rows.columns if not c.startswith("_")])


def dedup_summary(rows: DataFrame, key: Sequence[str], domain: str) -> DataFrame:
    """Keys, duplicate groups, and rows that deduplication removes, within one domain or across several."""
    g = rows.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct(domain).alias("d"))
    return g.agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.sum(F.col("n") - 1).alias("removed"), F.sum(F.when(F.col("d") > 1, F.col("n") - 1).otherwise(0)).alias("removed_across"), F.sum(F.when(F.col("d") == 1, F.col("n") - 1).otherwise(0)).alias("removed_within"))


def merge_ranked(rows: DataFrame, key: str, order: Sequence[Column], fill: Sequence[str], union: Sequence[str], eligible: str) -> DataFrame:
    """One row per key: the first eligible record (any, if none is), gaps filled from the next ones of that pool.

    fill: columns taken from the first record of the pool that has them (null, "", null, [] and {} count as gaps).
    union: array columns united over all records of the key, sorted.
    """
    w = Window.partitionBy(key)
    d = rows.withColumn("__e", F.max(F.col(eligible).cast("int")).over(w)).withColumn("__pool", F.col(eligible) | (F.col("__e") == 0))
    ranked = d.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__pool"), *order)))
    have = lambda c: F.when(F.col("__pool") & ~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "null", "[]", "{}"), F.struct("__r", F.col(c).alias("v")))
    agg = [F.min(have(c))["v"].alias(c) for c in fill]
    agg += [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in union]
    agg += [F.count("*").alias("n_records"), F.count_if(F.col(eligible)).alias("n_eligible")]
    return ranked.groupBy(key).agg(*agg).withColumn("merge_rule", F.when(F.col("n_records") == 1, "only_source_record").when((F.col("n_eligible") > 0) & (F.col("n_eligible") < F.col("n_records")), "eligible_record_preferred").otherwise("ranked"))


def sorted_union(c: Column | str) -> Column:
    """The sorted distinct members of array columns across a group."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two code sets; 1 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def top_share(totals: DataFrame, value: str, key: Sequence[str], within: Sequence[str] = (), ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Share of the k largest in the total of each group."""
    w = Window.partitionBy(*within).orderBy(F.desc(value), *key)
    r = totals.withColumn("__r", F.row_number().over(w))
    return r.groupBy(*within).agg(*(F.sum(F.when(F.col("__r") <= k, F.col(value)).otherwise(0)).cast("double").alias(f"s{k}") for k in ks), F.sum(value).alias("total")).select(*within, "total", *((F.col(f"s{k}") / F.col("total")).alias(f"top{k}_share") for k in ks))


def mismatches(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Joined rows and, for each column, how many differ between the two copies (null equals null)."""
    j = left.alias("l").join(right.alias("r"), list(keys))
    return j.agg(F.count("*").alias("n"), *(F.count_if(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))).alias(f"diff_{c}") for c in columns))


def violations_of_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def prefix_changes(base: DataFrame, base_order: Sequence, combined: DataFrame, order: Sequence) -> DataFrame:
    """One row: rows of base and of combined, and how many of the first rows of combined, in order, differ from base's.

    The columns of base are compared; a row of base that combined lacks counts as changed.
    """
    from .targets import ranked

    a = ranked(base, base_order, "__at").select("__at", F.struct(*base.columns).alias("__a"))
    b = ranked(combined, order, "__at").select("__at", F.struct(*base.columns).alias("__b"))
    n_base, n = base.agg(F.count("*").alias("n_base")), combined.agg(F.count("*").alias("n_combined"))
    changed = a.join(b, "__at", "left").agg(F.count_if(~F.col("__a").eqNullSafe(F.col("__b"))).alias("n_changed"))
    return F.broadcast(n_base).crossJoin(n).crossJoin(changed)
