"""Aggregates: coverage, totals, quantiles, histograms, concentration and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.maths import mapped
from ..operators import audits, monthly
from .facts import PRODUCTS_SQL, REVIEWS_SQL, ROLES, products, reviews, table
from .registry import query

CODES = ("F1", "F2", "F3")


@query("agg_05_rating_baseline", f"""WITH {REVIEWS_SQL} SELECT device, review_month, count(*) AS n_reviews, count(DISTINCT product) AS n_products, round(avg(rating), 9) AS mean_rating, round(avg(CAST(rating <= 2 AS INT)), 9) AS low_star_share FROM reviews GROUP BY 1, 2""")
def agg_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reviews(spark, sf_dir).groupBy("device", "review_month").agg(F.count("*").alias("n_reviews"), F.countDistinct("product").alias("n_products"), F.round(F.avg("rating"), 9).alias("mean_rating"), F.round(F.avg((F.col("rating") <= 2).cast("int")), 9).alias("low_star_share"))
    return d


@query("agg_05_device_summary", f"""WITH {REVIEWS_SQL}, pm AS (SELECT device, product, review_month, count(*) AS n, avg(rating) AS mean FROM reviews GROUP BY ALL)
 SELECT device, count(*) AS n_months, CAST(sum(n) AS BIGINT) AS n_reviews, round(avg(n), 9) AS mean_n, round(quantile_cont(n, 0.5), 9) AS median_n, round(min(mean), 9) AS min_mean, round(max(mean), 9) AS max_mean FROM pm GROUP BY device""")
def agg_05_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pm = reviews(spark, sf_dir).groupBy("device", "product", "review_month").agg(F.count("*").alias("n"), F.avg("rating").alias("mean"))
    return pm.groupBy("device").agg(F.count("*").alias("n_months"), F.sum("n").alias("n_reviews"), F.round(F.avg("n"), 9).alias("mean_n"), F.round(F.percentile("n", 0.5), 9).alias("median_n"), F.round(F.min("mean"), 9).alias("min_mean"), F.round(F.max("mean"), 9).alias("max_mean"))


@query("agg_06_category_months", f"""WITH {REVIEWS_SQL}, c AS (SELECT device, review_month, rating <= 2 AS f1, fp >= 0.7 AS f2, pers >= 1.8 AS f3 FROM reviews)
 SELECT device, review_month, count(*) AS n_reviews, count(*) FILTER (WHERE f1 OR f2 OR f3) AS hits, count(*) FILTER (WHERE f1) AS n_f1, count(*) FILTER (WHERE f2) AS n_f2, count(*) FILTER (WHERE f3) AS n_f3, round(count(*) FILTER (WHERE f1 OR f2 OR f3) / count(*), 9) AS hit_share FROM c GROUP BY 1, 2""")
def agg_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.concat_ws(";", F.when(F.col("rating") <= 2, "F1"), F.when(F.col("fp") >= 0.7, "F2"), F.when(F.col("pers") >= 1.8, "F3"))
    d = monthly.category_months(reviews(spark, sf_dir).withColumn("codes", codes), CODES, ["device", "review_month"])
    return d.withColumn("hit_share", F.round("hit_share", 9))


@query("agg_07_dedup_summary", """WITH g AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_returnflag) AS d FROM lineitem GROUP BY 1, 2)
 SELECT count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS duplicate_groups, CAST(sum(n - 1) AS BIGINT) AS removed, CAST(sum(CASE WHEN d > 1 THEN n - 1 ELSE 0 END) AS BIGINT) AS removed_across, CAST(sum(CASE WHEN d = 1 THEN n - 1 ELSE 0 END) AS BIGINT) AS removed_within FROM g""")
def agg_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.dedup_summary(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag")


@query("agg_08_distinct_keys", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS n_keys, count(*) - count(DISTINCT l_orderkey) AS n_duplicates FROM lineitem GROUP BY 1")
def agg_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("n_keys")).withColumn("n_duplicates", F.col("n") - F.col("n_keys"))


@query("agg_09_cross_domain_conflicts", """WITH g AS (SELECT l_orderkey, l_linenumber, count(DISTINCT l_returnflag) AS domains, count(DISTINCT l_partkey) AS versions FROM lineitem GROUP BY 1, 2)
 SELECT domains, versions, count(*) AS n FROM g WHERE domains > 1 GROUP BY 1, 2""")
def agg_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.countDistinct("l_returnflag").alias("domains"), F.countDistinct("l_partkey").alias("versions"))
    return g.where("domains > 1").groupBy("domains", "versions").agg(F.count("*").alias("n"))


@query("agg_10_coverage", f"""WITH {REVIEWS_SQL}, c AS (SELECT 'year' AS kind, CAST(year(review_month) AS VARCHAR) AS value FROM reviews UNION ALL SELECT 'rating', CAST(rating AS VARCHAR) FROM reviews UNION ALL SELECT 'verified', CAST(verified AS VARCHAR) FROM reviews UNION ALL SELECT 'product', CAST(product AS VARCHAR) FROM reviews UNION ALL SELECT 'domain_device', domain || '|' || device FROM reviews)
 SELECT kind, value, count(*) AS n FROM c GROUP BY 1, 2""")
def agg_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir)
    kinds = {"year": F.year("review_month").cast("string"), "rating": F.col("rating").cast("string"), "verified": F.col("verified").cast("string"), "product": F.col("product").cast("string"), "domain_device": F.concat_ws("|", "domain", "device")}
    long = r.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()))).alias("x")).select("x.*")
    return long.groupBy("kind", "value").agg(F.count("*").alias("n"))


@query("agg_11_totals", f"""WITH {REVIEWS_SQL} SELECT CASE WHEN grouping(device) = 1 THEN 'ALL' ELSE device END AS scope, count(*) AS n_reviews, count(DISTINCT product) AS n_products, round(avg(rating), 9) AS mean_rating, CAST(min(review_month) AS VARCHAR) AS first_month, CAST(max(review_month) AS VARCHAR) AS last_month FROM reviews GROUP BY ROLLUP (device)""")
def agg_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    aggs = {"n_reviews": F.count("*"), "n_products": F.countDistinct("product"), "mean_rating": F.round(F.avg("rating"), 9), "first_month": F.date_format(F.min("review_month"), "yyyy-MM-dd"), "last_month": F.date_format(F.max("review_month"), "yyyy-MM-dd")}
    return monthly.with_total(reviews(spark, sf_dir), "device", aggs)


@query("agg_12_threshold_coverage", f"""WITH {REVIEWS_SQL}, pm AS (SELECT device, product, review_month, count(*) AS n FROM reviews GROUP BY ALL), t AS (SELECT unnest([1, 5, 10, 20, 30]) AS threshold)
 SELECT coalesce(device, 'ALL') AS scope, threshold, count(*) FILTER (WHERE n >= threshold) AS n_months, count(DISTINCT product) FILTER (WHERE n >= threshold) AS n_products FROM pm CROSS JOIN t GROUP BY GROUPING SETS ((device, threshold), (threshold))""")
def agg_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pm = reviews(spark, sf_dir).groupBy("device", "product", "review_month").agg(F.count("*").alias("n"))
    each = pm.withColumn("threshold", F.explode(F.array(*map(F.lit, (1, 5, 10, 20, 30)))))
    both = each.withColumn("scope", F.explode(F.array("device", F.lit("ALL"))))
    return both.groupBy("scope", "threshold").agg(F.count_if(F.col("n") >= F.col("threshold")).alias("n_months"), F.countDistinct(F.when(F.col("n") >= F.col("threshold"), F.col("product"))).alias("n_products"))


QS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@query("agg_13_quantiles", f"SELECT c_mktsegment, count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean, min(c_acctbal) AS min, max(c_acctbal) AS max, round(stddev_pop(c_acctbal), 6) AS std, {', '.join(f'round(quantile_cont(c_acctbal, {q}), 6) AS p{round(q * 100):02d}' for q in QS)} FROM customer GROUP BY 1")
def agg_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = monthly.distribution(table(spark, sf_dir, "customer"), "c_acctbal", QS, ["c_mktsegment"])
    return d.select("c_mktsegment", "n", "min", "max", *(F.round(c, 6).alias(c) for c in ("mean", "std", *(f"p{round(q * 100):02d}" for q in QS))))


@query("agg_14_weighted_mean", f"WITH {REVIEWS_SQL}, pm AS (SELECT device, product, review_month, count(*) AS n, avg(fp) AS v FROM reviews GROUP BY ALL) SELECT device, round(sum(v * n) / sum(n), 8) AS weighted_mean, round(avg(v), 8) AS plain_mean FROM pm GROUP BY 1")
def agg_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    pm = reviews(spark, sf_dir).groupBy("device", "product", "review_month").agg(F.count("*").alias("n"), F.avg("fp").alias("v"))
    return pm.groupBy("device").agg(F.round(monthly.weighted_mean("v", "n"), 8).alias("weighted_mean"), F.round(F.avg("v"), 8).alias("plain_mean"))


EDGES = (0.0, 10000.0, 25000.0, 50000.0, 75000.0, 200000.0)


@query("agg_15_histogram", f"""WITH e AS (SELECT * FROM (VALUES {', '.join(f'({k}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))' for k, (a, b) in enumerate(zip(EDGES, EDGES[1:], strict=False)))}) AS t(bin, lo, hi))
 SELECT CAST(bin AS INT) AS bin, lo, hi, count(l_extendedprice) AS n FROM e LEFT JOIN lineitem ON l_extendedprice >= lo AND (l_extendedprice < hi OR bin = {len(EDGES) - 2} AND l_extendedprice <= hi) GROUP BY 1, 2, 3""")
def agg_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", EDGES)


@query("agg_16_concentration", f"""WITH {REVIEWS_SQL}, p AS (SELECT device, product, count(*) AS n FROM reviews GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY n DESC, product) AS k FROM p)
 SELECT device, CAST(sum(n) AS BIGINT) AS total, {', '.join(f'round(coalesce(sum(n) FILTER (WHERE k <= {k}), 0) / sum(n), 9) AS top{k}_share' for k in (1, 5, 10))} FROM r GROUP BY 1""")
def agg_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reviews(spark, sf_dir).groupBy("device", "product").agg(F.count("*").alias("n"))
    d = audits.top_share(p, "n", ["product"], ["device"])
    return d.select("device", "total", *(F.round(f"top{k}_share", 9).alias(f"top{k}_share") for k in (1, 5, 10)))


@query("agg_23_reason_counts", f"""WITH {REVIEWS_SQL}, a AS (SELECT list_filter([CASE WHEN rating <= 2 THEN 'low_star' END, CASE WHEN fp >= 0.7 THEN 'likely_failure' END, CASE WHEN pers >= 1.8 THEN 'persistent' END], lambda x: x IS NOT NULL) AS reasons FROM reviews), u AS (SELECT unnest(reasons) AS reason FROM a) SELECT reason, count(*) AS n FROM u GROUP BY 1""")
def agg_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.array_compact(F.array(F.when(F.col("rating") <= 2, "low_star"), F.when(F.col("fp") >= 0.7, "likely_failure"), F.when(F.col("pers") >= 1.8, "persistent")))
    return reviews(spark, sf_dir).select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("agg_24_confusion", """WITH g AS (SELECT a, b FROM (SELECT unnest([0, 1]) AS a) CROSS JOIN (SELECT unnest([0, 1]) AS b)) SELECT CAST(a AS INT) AS true_label, CAST(b AS INT) AS predicted, count(quality) AS n FROM g LEFT JOIN labels ON quality = a AND toxic = b GROUP BY 1, 2""")
def agg_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.metrics import confusion

    return confusion(table(spark, sf_dir, "labels"), "quality", "toxic", (0, 1))


@query("agg_25_audit_precision", f"""WITH {REVIEWS_SQL}, g AS (SELECT device, count(*) AS reviewed, count(*) FILTER (WHERE rating >= 2) AS correct FROM reviews GROUP BY 1) SELECT device, reviewed, correct, round(correct / reviewed, 9) AS "precision", correct / reviewed >= 0.80 AS passed FROM g""")
def agg_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = reviews(spark, sf_dir).groupBy("device").agg(F.count("*").alias("reviewed"), F.count_if(F.col("rating") >= 2).alias("correct"))
    p = F.col("correct") / F.col("reviewed")
    return g.withColumn("precision", F.round(p, 9)).withColumn("passed", p >= 0.80)


WARN = f"""WITH {REVIEWS_SQL}, d AS (SELECT device, count(*) AS n, count(DISTINCT product) AS np FROM reviews GROUP BY 1), p AS (SELECT device, product, count(*) AS n FROM reviews GROUP BY ALL), t AS (SELECT d.device, max(p.n) / max(d.n) AS s FROM d JOIN p ON d.device = p.device GROUP BY 1)
 SELECT 'few_products' AS warning, device AS scope, CAST(np AS DOUBLE) AS value FROM d WHERE np < 35 UNION ALL SELECT 'top_product_share', device, round(s, 9) FROM t WHERE s > 0.033 UNION ALL SELECT 'imbalance', 'ALL', round(max(n) / min(n), 9) FROM d HAVING max(n) / min(n) > 1.1"""


@query("agg_26_readiness_warnings", WARN)
def agg_26(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = reviews(spark, sf_dir).groupBy("device", "product").agg(F.count("*").alias("n"))
    d = p.groupBy("device").agg(F.sum("n").alias("n"), F.count("*").alias("np"), (F.max("n") / F.sum("n")).alias("s"))
    few = d.where("np < 35").select(F.lit("few_products").alias("warning"), F.col("device").alias("scope"), F.col("np").cast("double").alias("value"))
    top = d.where("s > 0.033").select(F.lit("top_product_share"), "device", F.round("s", 9))
    ratio = F.max("n") / F.min("n")
    imb = d.agg(ratio.alias("r")).where("r > 1.1").select(F.lit("imbalance"), F.lit("ALL"), F.round("r", 9))
    return few.union(top).union(imb)


@query("agg_27_year_series", f"WITH {REVIEWS_SQL} SELECT CASE WHEN grouping(device) = 1 THEN 'ALL' ELSE device END AS scope, CAST(year(review_month) AS INT) AS year, count(*) AS n, round(avg(fp), 8) AS mean_fp FROM reviews GROUP BY GROUPING SETS ((device, year(review_month)), (year(review_month)))")
def agg_27(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir).select("device", F.year("review_month").alias("year"), "fp")
    return r.groupingSets([[F.col("device"), F.col("year")], [F.col("year")]], "device", "year").agg(F.grouping("device").alias("gd"), F.count("*").alias("n"), F.round(F.avg("fp"), 8).alias("mean_fp")).select(F.when(F.col("gd") == 1, "ALL").otherwise(F.col("device")).alias("scope"), "year", "n", "mean_fp")


@query("agg_28_balance", f"WITH {REVIEWS_SQL} SELECT device, CASE WHEN rating <= 2 THEN 'low_1_2' WHEN rating = 3 THEN 'middle_3' ELSE 'high_4_5' END AS stratum, count(*) AS n, count(*) FILTER (WHERE fp >= 0.7) AS hits, count(*) FILTER (WHERE NOT fp >= 0.7) AS misses, count(DISTINCT product) AS n_products FROM reviews GROUP BY 1, 2")
def agg_28(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import rating_stratum

    hit = F.col("fp") >= 0.7
    return reviews(spark, sf_dir).groupBy("device", rating_stratum(F.col("rating")).alias("stratum")).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.countDistinct("product").alias("n_products"))


@query("agg_29_list_lengths", "WITH g AS (SELECT o_custkey, list(DISTINCT o_orderstatus) AS s FROM orders GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (WHERE len(s) > 1) AS n_several FROM g")
def agg_29(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return g.agg(F.count("*").alias("n"), F.count_if(F.size("s") > 1).alias("n_several"))


@query("flt_04_reject_funnel", """WITH r AS (SELECT CASE WHEN p_name IS NULL OR p_name = '' THEN 'missing_name' WHEN p_size > 40 THEN 'too_large' WHEN p_retailprice < 1000 THEN 'too_cheap' WHEN p_type NOT LIKE '%A%' THEN 'wrong_type' ELSE 'kept' END AS reason FROM part) SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def flt_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("p_name").isNull() | (F.col("p_name") == ""), "missing_name").when(F.col("p_size") > 40, "too_large").when(F.col("p_retailprice") < 1000, "too_cheap").when(~F.col("p_type").like("%A%"), "wrong_type").otherwise("kept")
    return table(spark, sf_dir, "part").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("flt_05_bounds", """SELECT 'l_discount' AS "column", count(*) FILTER (WHERE l_discount < 0) AS n_low, count(*) FILTER (WHERE l_discount > 0.1) AS n_high, count(*) FILTER (WHERE isnan(l_discount)) AS n_nan, count(*) FILTER (WHERE l_discount IS NULL) AS n_null, NOT bool_or(l_discount < 0 OR l_discount > 0.1 OR isnan(l_discount) OR l_discount IS NULL) AS passed FROM lineitem
 UNION ALL SELECT 'l_quantity', count(*) FILTER (WHERE l_quantity < 1), count(*) FILTER (WHERE l_quantity > 49), count(*) FILTER (WHERE isnan(l_quantity)), count(*) FILTER (WHERE l_quantity IS NULL), NOT bool_or(l_quantity < 1 OR l_quantity > 49 OR isnan(l_quantity) OR l_quantity IS NULL) FROM lineitem""")
def flt_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..contracts import bounds_check

    return bounds_check(table(spark, sf_dir, "lineitem"), {"l_discount": (0, 0.1), "l_quantity": (1, 49)})


@query("rpt_06_product_coverage", f"""WITH {REVIEWS_SQL}, p2 AS (SELECT p_partkey, count(part) AS n FROM part LEFT JOIN reviews ON p_partkey = part AND rating = 1 AND review_month >= DATE '2000-01-01' GROUP BY 1)
 SELECT count(*) AS n_products, count(*) FILTER (WHERE n = 0) AS n_without, min(n) AS min_n, round(quantile_cont(n, 0.5), 6) AS median_n, round(avg(n), 9) AS mean_n, max(n) AS max_n FROM p2""")
def rpt_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir).where((F.col("rating") == 1) & (F.col("review_month") >= F.lit("2000-01-01").cast("date"))).groupBy("part").agg(F.count("*").alias("k"))
    p = table(spark, sf_dir, "part").select("p_partkey").join(r, F.col("p_partkey") == F.col("part"), "left").select(F.coalesce("k", F.lit(0)).cast("long").alias("n"))
    return p.agg(F.count("*").alias("n_products"), F.count_if(F.col("n") == 0).alias("n_without"), F.min("n").alias("min_n"), F.round(F.percentile("n", 0.5), 6).alias("median_n"), F.round(F.avg("n"), 9).alias("mean_n"), F.max("n").alias("max_n"))


@query("rpt_07_month_coverage", f"""WITH {REVIEWS_SQL}, pm AS (SELECT device, product, review_month, count(*) AS n FROM reviews GROUP BY ALL)
 SELECT CASE WHEN grouping(device) = 1 THEN 'ALL' ELSE device END AS scope, count(*) AS n_months, round(avg(n), 9) AS mean_n, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75, round(quantile_cont(n, 0.9), 6) AS p90, max(n) AS max_n, count(*) FILTER (WHERE n >= 5) AS n_ge5, count(*) FILTER (WHERE n >= 10) AS n_ge10 FROM pm GROUP BY ROLLUP (device)""")
def rpt_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    pm = reviews(spark, sf_dir).groupBy("device", "product", "review_month").agg(F.count("*").alias("n"))
    aggs = {"n_months": F.count("*"), "mean_n": F.round(F.avg("n"), 9), **{f"p{round(q * 100)}": F.round(F.percentile("n", q), 6) for q in (0.25, 0.5, 0.75, 0.9)}, "max_n": F.max("n"), "n_ge5": F.count_if(F.col("n") >= 5), "n_ge10": F.count_if(F.col("n") >= 10)}
    return monthly.with_total(pm, "device", aggs)


@query("rpt_11_device_signals", f"""WITH {REVIEWS_SQL}, pm AS (SELECT device, product, review_month, count(*) AS n, avg(fp) AS v FROM reviews GROUP BY ALL), a AS (SELECT device, count(DISTINCT product) AS n_products, count(*) AS n_reviews, avg(CAST(fp >= 0.5 AS INT)) AS share FROM reviews GROUP BY 1), b AS (SELECT device, count(*) AS n_months, sum(v * n) / sum(n) AS w FROM pm GROUP BY 1)
 SELECT a.device, n_products, n_reviews, round(share, 9) AS failure_share, n_months, round(w, 8) AS weighted_probability FROM a JOIN b ON a.device = b.device""")
def rpt_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir)
    a = r.groupBy("device").agg(F.countDistinct("product").alias("n_products"), F.count("*").alias("n_reviews"), F.round(F.avg((F.col("fp") >= 0.5).cast("int")), 9).alias("failure_share"))
    pm = r.groupBy("device", "product", "review_month").agg(F.count("*").alias("n"), F.avg("fp").alias("v"))
    b = pm.groupBy("device").agg(F.count("*").alias("n_months"), F.round(monthly.weighted_mean("v", "n"), 8).alias("weighted_probability"))
    return a.join(b, "device")


@query("prj_03_role_map", f"WITH {PRODUCTS_SQL} SELECT product, device, role FROM products")
def prj_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir).select("product", "device")
    return p.withColumn("role", mapped(F.col("device"), ROLES))
