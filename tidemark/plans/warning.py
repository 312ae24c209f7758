"""Product-months, calendar windows, targets, splits and the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts
from ..functions import maths
from ..operators import monthly, targets, windows
from .facts import REVIEWS_SQL, reviews
from .registry import query

PM = f"""{REVIEWS_SQL}, pm AS (SELECT product, device, review_month, m, count(*) AS n_reviews, CAST(sum(rating) AS BIGINT) AS rating_sum, count(*) FILTER (WHERE rating <= 2) AS low_star_count FROM reviews GROUP BY ALL)"""
ENDS = "ends AS (SELECT min(m) AS a, max(m) AS b FROM pm)"


def _win(h: int) -> str:
    return f"""CASE WHEN m + {h} <= b THEN CAST(coalesce(sum(n_reviews) OVER (PARTITION BY product ORDER BY m RANGE BETWEEN 1 FOLLOWING AND {h} FOLLOWING), 0) AS BIGINT) END AS fn{h},
 CASE WHEN m + {h} <= b THEN CAST(coalesce(sum(rating_sum) OVER (PARTITION BY product ORDER BY m RANGE BETWEEN 1 FOLLOWING AND {h} FOLLOWING), 0) AS BIGINT) END AS fr{h},
 CASE WHEN m + {h} <= b THEN CAST(coalesce(sum(low_star_count) OVER (PARTITION BY product ORDER BY m RANGE BETWEEN 1 FOLLOWING AND {h} FOLLOWING), 0) AS BIGINT) END AS fl{h}"""


HIST = """CASE WHEN m - a >= 2 THEN CAST(sum(n_reviews) OVER (PARTITION BY product ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) END AS hn,
 CASE WHEN m - a >= 2 THEN CAST(sum(rating_sum) OVER (PARTITION BY product ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) END AS hr,
 CASE WHEN m - a >= 2 THEN CAST(sum(low_star_count) OVER (PARTITION BY product ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) END AS hl"""
WIN = f"{PM}, {ENDS}, w AS (SELECT pm.*, a, b, {HIST}, {_win(1)}, {_win(2)}, {_win(3)} FROM pm CROSS JOIN ends)"


def _any(h: int, drop: int = 30, rise: int = 10) -> str:
    return f"CASE WHEN hn > 0 AND fn{h} > 0 THEN CAST(fr{h} * hn * 100 <= hr * fn{h} * 100 - {drop} * hn * fn{h} OR fl{h} * hn * 100 >= hl * fn{h} * 100 + {rise} * hn * fn{h} AS INT) END"


def _supported(h: int) -> str:
    return f"coalesce(n_reviews >= 5 AND hn >= 10 AND fn{h} >= 10, false)"


TARGETS = f"""{WIN}, t AS (SELECT *, {', '.join(f'{_any(h)} AS any{h}, {_supported(h)} AS sup{h}' for h in (1, 2, 3))} FROM w),
 e AS (SELECT *, {', '.join(f"sup{h} AND any{h} IS NOT NULL AND device <> 'smart_switch' AS el{h}" for h in (1, 2, 3))} FROM t)"""


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly.rating_months(reviews(spark, sf_dir))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.quality_targets(windows.trailing_and_leading(_months(spark, sf_dir)))


@query("agg_01_rating_month", f"WITH {PM} SELECT product, device, review_month, n_reviews, rating_sum, low_star_count, round(rating_sum / n_reviews, 9) AS mean_rating, round(low_star_count / n_reviews, 9) AS low_star_share FROM pm")
def agg_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _months(spark, sf_dir).select("product", "device", "review_month", "n_reviews", "rating_sum", "low_star_count", F.round("mean_rating", 9).alias("mean_rating"), F.round("low_star_share", 9).alias("low_star_share"))


@query("agg_02_failure_month", f"""WITH {REVIEWS_SQL} SELECT product, review_month, count(*) AS n_reviews, CAST(sum(CAST(fp >= 0.5 AS INT)) AS BIGINT) AS failure_count, round(avg(CAST(fp >= 0.5 AS INT)), 10) AS failure_share,
 round(avg(fp), 10) AS mean_probability, round(quantile_cont(fp, 0.5), 10) AS median_probability, round(max(fp), 10) AS max_probability FROM reviews GROUP BY product, review_month""")
def agg_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir).withColumn("probability", F.col("fp")).withColumn("prediction", (F.col("fp") >= 0.5).cast("int"))
    d = monthly.failure_months(r)
    return d.select("product", "review_month", "n_reviews", "failure_count", *(F.round(c, 10).alias(c) for c in ("failure_share", "mean_probability", "median_probability", "max_probability")))


@query("agg_03_component_month", f"""WITH {REVIEWS_SQL} SELECT product, review_month, 'v1' AS model_version, count(*) AS n_reviews, round(avg(fp * (1 + s2 + s3)), 10) AS mean_severity_signal, round(avg(fp * pers), 10) AS mean_persistence_signal,
 round(avg(s2), 10) AS mean_s2, round(avg(CAST(s2 >= 0.5 AS INT)), 10) AS s2_share, round(max(pers), 10) AS max_persistence FROM reviews GROUP BY 1, 2""")
def agg_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir).withColumn("model_version", F.lit("v1"))
    sev = F.col("fp") * maths.expected_value([F.col("s2"), F.col("s3")], 1)
    g = r.groupBy("product", "review_month", "model_version").agg(F.count("*").alias("n_reviews"), F.avg(sev).alias("mean_severity_signal"), F.avg(F.col("fp") * F.col("pers")).alias("mean_persistence_signal"), F.avg("s2").alias("mean_s2"), F.avg((F.col("s2") >= 0.5).cast("int")).alias("s2_share"), F.max("pers").alias("max_persistence"))
    return g.select("product", "review_month", "model_version", "n_reviews", *(F.round(c, 10).alias(c) for c in g.columns[4:]))


INDEX_SQL = f"""{REVIEWS_SQL}, c AS (SELECT *, greatest(0, least(1, fp)) AS f, greatest(0, least(1, s2)) AS s, greatest(0, least(1, s3)) AS t, greatest(0, least(1, pers / 2.0)) AS p FROM reviews),
 idx AS (SELECT *, f * (0.5 + 0.25 * s + 0.25 * p) AS index_main, f AS index_failure_only, f * (CAST(1 AS DOUBLE) / 3 + CAST(1 AS DOUBLE) / 3 * s + CAST(1 AS DOUBLE) / 3 * p) AS index_equal, f * (0.6 + 0.2 * s + 0.2 * p) AS index_emphasis, f * (0.5 + 0.25 * greatest(0, least(1, (s + t) / 2)) + 0.25 * p) AS index_full_severity FROM c)"""
INDEX = ("index_main", "index_failure_only", "index_equal", "index_emphasis", "index_full_severity")


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir)
    return r.withColumns(maths.composite_index(F.col("fp"), F.col("s2"), F.col("s3"), F.col("pers")))


@query("mth_01_composite_index", f"WITH {INDEX_SQL} SELECT order_id, line_no, product, part, ts, {', '.join(f'round({c}, 7) AS {c}' for c in INDEX)} FROM idx")
def mth_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).select("order_id", "line_no", "product", "part", "ts", *(F.round(c, 7).alias(c) for c in INDEX))


@query("agg_04_index_month", f"WITH {INDEX_SQL} SELECT product, review_month, count(*) AS n_reviews, {', '.join(f'round(avg({c}), 10) AS mean_{c}' for c in INDEX)} FROM idx GROUP BY product, review_month")
def agg_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = monthly.mean_months(_indexed(spark, sf_dir), INDEX)
    return d.select("product", "review_month", "n_reviews", *(F.round(f"mean_{c}", 10).alias(f"mean_{c}") for c in INDEX))


@query("mth_02_monotone_clamp", f"WITH {REVIEWS_SQL} SELECT order_id, line_no, part, ts, round(fp, 7) AS p1, round(least(s2, fp), 7) AS p2, round(least(s3, least(s2, fp)), 7) AS p3, CAST(s2 > fp AS INT) + CAST(s3 > least(s2, fp) AS INT) AS n_clamped FROM reviews")
def mth_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = [F.col(c) for c in ("fp", "s2", "s3")]
    done = maths.monotone(ps)
    n = sum(((a > b).cast("int") for a, b in zip(ps[1:], done, strict=False)), F.lit(0))
    return reviews(spark, sf_dir).select("order_id", "line_no", "part", "ts", *(F.round(c, 7).alias(f"p{k}") for k, c in enumerate(done, 1)), n.alias("n_clamped"))


@query("mth_03_expected_value", f"WITH {REVIEWS_SQL} SELECT order_id, line_no, part, ts, round(1.0 + s2 + s3, 7) AS expected_severity, 1 + CAST(s2 >= 0.5 AS INT) + CAST(s3 >= 0.5 AS INT) AS severity_class FROM reviews")
def mth_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = [F.col("s2"), F.col("s3")]
    return reviews(spark, sf_dir).select("order_id", "line_no", "part", "ts", F.round(maths.expected_value(ps, 1), 7).alias("expected_severity"), maths.hard_class(ps, 1).alias("severity_class"))


@query("mth_04_signals", f"WITH {REVIEWS_SQL} SELECT order_id, line_no, part, ts, round(fp * (1 + s2 + s3), 7) AS severity_signal, round(fp * pers, 7) AS persistence_signal, CAST((rating - 3) / 2.0 <= -0.05 AS INT) AS negative FROM reviews")
def mth_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    sev = F.col("fp") * maths.expected_value([F.col("s2"), F.col("s3")], 1)
    return reviews(spark, sf_dir).select("order_id", "line_no", "part", "ts", F.round(sev, 7).alias("severity_signal"), F.round(F.col("fp") * F.col("pers"), 7).alias("persistence_signal"), maths.negative_sentiment((F.col("rating") - 3) / 2.0).alias("negative"))


@query("win_02_03_calendar_windows", f"WITH {WIN} SELECT product, review_month, n_reviews, hn, hr, hl, fn1, fr1, fl1, fn2, fr2, fl2, fn3, fr3, fl3 FROM w")
def win_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windows.trailing_and_leading(_months(spark, sf_dir))
    ahead = [F.col(f"fut_{c}_{h}").alias(f"{s}{h}") for h in (1, 2, 3) for c, s in zip(windows.MEASURES, ("fn", "fr", "fl"), strict=True)]
    return d.select("product", "review_month", "n_reviews", *(F.col(f"hist_{c}").alias(s) for c, s in zip(windows.MEASURES, ("hn", "hr", "hl"), strict=True)), *ahead)


PART = f"""{REVIEWS_SQL}, pm AS (SELECT part AS product, review_month, m, count(*) AS n_reviews, CAST(sum(rating) AS BIGINT) AS rating_sum, count(*) FILTER (WHERE rating <= 2) AS low_star_count FROM reviews GROUP BY ALL), {ENDS}"""


@query("win_03_sparse_products", f"WITH {PART}, w AS (SELECT pm.*, a, b, {HIST}, {_win(3)} FROM pm CROSS JOIN ends) SELECT product, review_month, n_reviews, hn, hr, hl, fn3, fr3, fl3 FROM w")
def win_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir).drop("product").withColumnRenamed("part", "product")
    d = windows.trailing_and_leading(monthly.rating_months(r, ("product", "review_month", "m")), horizons=(3,))
    return d.select("product", "review_month", "n_reviews", F.col("hist_n_reviews").alias("hn"), F.col("hist_rating_sum").alias("hr"), F.col("hist_low_star_count").alias("hl"), F.col("fut_n_reviews_3").alias("fn3"), F.col("fut_rating_sum_3").alias("fr3"), F.col("fut_low_star_count_3").alias("fl3"))


GRID = f"""{PM}, {ENDS}, grid AS (SELECT product, unnest(generate_series(a, b)) AS m FROM (SELECT DISTINCT product FROM pm) CROSS JOIN ends),
 g AS (SELECT grid.product, CAST(grid.m AS INT) AS m, CAST(coalesce(n_reviews, 0) AS BIGINT) AS n_reviews, CAST(coalesce(rating_sum, 0) AS BIGINT) AS rating_sum, CAST(coalesce(low_star_count, 0) AS BIGINT) AS low_star_count, n_reviews IS NOT NULL AS observed
 FROM grid LEFT JOIN pm ON grid.product = pm.product AND grid.m = pm.m)"""


@query("win_04_dense_grid", f"""WITH {GRID} SELECT product, make_date((m - 1) // 12, (m - 1) % 12 + 1, 1) AS review_month, n_reviews, rating_sum, low_star_count, observed,
 CASE WHEN count(*) OVER back = 3 THEN CAST(sum(n_reviews) OVER back AS BIGINT) END AS hist_n, CASE WHEN count(*) OVER ahead = 3 THEN CAST(sum(n_reviews) OVER ahead AS BIGINT) END AS fut_n FROM g
 WINDOW back AS (PARTITION BY product ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ahead AS (PARTITION BY product ORDER BY m ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""")
def win_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windows.dense_windows(windows.dense_grid(_months(spark, sf_dir)))
    return d.select("product", "review_month", "n_reviews", "rating_sum", "low_star_count", "observed", F.col("hist_n_reviews").alias("hist_n"), F.col("fut_n_reviews").alias("fut_n"))


@query("win_04_grid_audit", f"WITH {GRID} SELECT count(*) AS grid_rows, count(*) FILTER (WHERE NOT observed) AS zero_rows, count(DISTINCT product) AS n_products, count(DISTINCT m) AS n_months, CAST(sum(n_reviews) AS BIGINT) AS n_reviews FROM g")
def win_04_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = windows.dense_grid(_months(spark, sf_dir))
    return g.agg(F.count("*").alias("grid_rows"), F.count_if(~F.col("observed")).alias("zero_rows"), F.countDistinct("product").alias("n_products"), F.countDistinct("m").alias("n_months"), F.sum("n_reviews").alias("n_reviews"))


VARIANTS = [(h, a, b) for h in (1, 2, 3) for a in (20, 30, 40) for b in (5, 10, 15)]


@query("mth_05_quality_targets", f"""WITH {TARGETS} SELECT product, device, review_month, n_reviews, {', '.join(f'any{h} AS target_any_{h}, sup{h} AS supported_{h}, el{h} AS eligible_{h}, el{h} AND n_reviews >= 10 AS eligible_{h}_ge10, el{h} AND n_reviews >= 20 AS eligible_{h}_ge20' for h in (1, 2, 3))},
 {', '.join(f'{_any(h, a, b)} AS target_any_{h}_d{a}_r{b}' for h, a, b in VARIANTS)} FROM e""")
def mth_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _targets(spark, sf_dir)
    names = [f"{c}_{h}{s}" for h in (1, 2, 3) for c, s in (("target_any", ""), ("supported", ""), ("eligible", ""), ("eligible", "_ge10"), ("eligible", "_ge20"))]
    return d.select("product", "device", "review_month", "n_reviews", *names, *(f"target_any_{h}_d{a}_r{b}" for h, a, b in VARIANTS))


SPLIT = f"""{TARGETS}, em AS (SELECT m, row_number() OVER (ORDER BY m) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT m FROM e WHERE el3)),
 em2 AS (SELECT *, greatest(1, CAST(floor(n * 0.6) AS BIGINT)) AS tn FROM em WHERE n >= 5), em3 AS (SELECT *, least(greatest(tn + 1, CAST(floor(n * 0.8) AS BIGINT)), n - 1) AS vn FROM em2),
 em4 AS (SELECT *, CASE WHEN k <= tn THEN 'train' WHEN k <= vn THEN 'validation' ELSE 'test' END AS raw FROM em3), em5 AS (SELECT *, max(m) FILTER (WHERE raw = 'train') OVER () AS lt FROM em4),
 em6 AS (SELECT *, raw = 'validation' AND m > lt + 3 AS kv FROM em5), em7 AS (SELECT *, max(m) FILTER (WHERE kv) OVER () AS lv FROM em6),
 ms AS (SELECT m, CASE WHEN raw = 'train' THEN 'train' WHEN kv THEN 'validation' WHEN raw = 'validation' THEN 'embargo_train_validation' WHEN lv IS NULL OR m > lv + 3 THEN 'test' ELSE 'embargo_validation_test' END AS s FROM em7),
 sp AS (SELECT e.*, CASE WHEN el3 AND s IS NOT NULL THEN s ELSE 'not_eligible' END AS split FROM e LEFT JOIN ms ON e.m = ms.m)"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.month_split(_targets(spark, sf_dir), "eligible_3")


@query("win_07_month_split", f"WITH {SPLIT} SELECT product, review_month, split FROM sp")
def win_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("product", "review_month", "split")


@query("win_08_boundary_split", f"WITH {PM} SELECT product, review_month, CASE WHEN review_month <= DATE '1999-06-30' THEN 'train' WHEN review_month <= DATE '1999-09-30' THEN 'embargo' WHEN review_month <= DATE '2000-06-30' THEN 'validation' WHEN review_month <= DATE '2000-09-30' THEN 'embargo' ELSE 'test' END AS split FROM pm")
def win_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = [("train", "1999-06-30"), ("embargo", "1999-09-30"), ("validation", "2000-06-30"), ("embargo", "2000-09-30")]
    return _months(spark, sf_dir).select("product", "review_month", targets.boundary_split(F.col("review_month"), bounds, "test").alias("split"))


@query("win_06_chronological_split", """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place, count(*) OVER () AS n FROM orders)
 SELECT o_orderkey, place, CASE WHEN place <= floor(n * 0.6) THEN 'train' WHEN place <= floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM o""")
def win_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    return targets.row_split(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "place", "split")


@query("win_11_split_check", f"""WITH {SPLIT}, g AS (SELECT split, min(m) AS first_m, max(m) AS last_m, count(*) AS n, CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END AS k FROM sp WHERE split IN ('train', 'validation', 'test') GROUP BY split)
 SELECT split, first_m, last_m, n, coalesce(first_m > max(last_m) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS after_prior FROM g""")
def win_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.split_check(_split(spark, sf_dir))


@query("win_11_leaking_keys", f"WITH {SPLIT} SELECT review_month, count(DISTINCT split) AS n_splits FROM sp WHERE split <> 'not_eligible' GROUP BY review_month HAVING count(DISTINCT split) > 1")
def win_11_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.leaking_keys(_split(spark, sf_dir).where("split <> 'not_eligible'"), "review_month")


@query("prj_06_panel", f"""WITH {SPLIT}, ix AS (SELECT product, review_month, f * (0.5 + 0.25 * s + 0.25 * p) AS x FROM (SELECT product, review_month, greatest(0, least(1, fp)) AS f, greatest(0, least(1, s2)) AS s, greatest(0, least(1, pers / 2.0)) AS p FROM reviews)),
 im AS (SELECT product, review_month, avg(x) AS v FROM ix GROUP BY ALL)
 SELECT sp.product, sp.review_month, n_reviews AS feature_n_reviews, round(rating_sum / n_reviews, 10) AS feature_mean_rating, round(hr / hn, 10) AS feature_hist_mean, round(v, 10) AS feature_index_main, any3 AS target_any_3, split AS split_h3 FROM sp JOIN im ON sp.product = im.product AND sp.review_month = im.review_month""")
def prj_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _split(spark, sf_dir)
    i = monthly.mean_months(_indexed(spark, sf_dir), ["index_main"]).select("product", "review_month", "mean_index_main")
    d = s.join(i, ["product", "review_month"]).select("product", "review_month", F.col("n_reviews").alias("feature_n_reviews"), F.round("mean_rating", 10).alias("feature_mean_rating"), F.round("hist_mean", 10).alias("feature_hist_mean"), F.round("mean_index_main", 10).alias("feature_index_main"), "target_any_3", F.col("split").alias("split_h3"))
    contracts.namespaces(d, ["product", "review_month"], managed=["split_h3"])
    return contracts.forbid(d, ["user_id", "fut_n_reviews_3", "fut_mean_3"])


@query("agg_21_target_prevalence", f"""WITH {TARGETS}, u AS ({' UNION ALL '.join(f"SELECT {h} AS horizon, device, any{h} AS t, el{h} AS el FROM e" for h in (1, 2, 3))})
 SELECT horizon, coalesce(device, 'ALL') AS scope, count(t) AS n_known, CAST(coalesce(sum(t), 0) AS BIGINT) AS n_positive, count(*) FILTER (WHERE el) AS n_eligible, CAST(coalesce(sum(t) FILTER (WHERE el), 0) AS BIGINT) AS n_eligible_positive FROM u GROUP BY GROUPING SETS ((horizon, device), (horizon))""")
def agg_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _targets(spark, sf_dir)
    long = d.select("device", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"target_any_{h}").alias("t"), F.col(f"eligible_{h}").alias("el")) for h in (1, 2, 3)))).alias("x")).select("device", "x.*")
    both = long.unionByName(long.withColumn("device", F.lit("ALL")))
    return both.groupBy("horizon", F.col("device").alias("scope")).agg(F.count("t").alias("n_known"), F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("n_positive"), F.count_if("el").alias("n_eligible"), F.coalesce(F.sum(F.when(F.col("el"), F.col("t"))), F.lit(0)).cast("long").alias("n_eligible_positive"))


@query("agg_22_device_support", f"WITH {TARGETS} SELECT device, count(*) AS n, count(DISTINCT product) AS n_products, count(*) FILTER (WHERE sup3) AS n_supported, count(any3) AS n_known, CAST(coalesce(sum(any3), 0) AS BIGINT) AS n_positive, count(*) FILTER (WHERE el3 AND n_reviews >= 10) AS n_ge10 FROM e GROUP BY device")
def agg_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir).groupBy("device").agg(F.count("*").alias("n"), F.countDistinct("product").alias("n_products"), F.count_if("supported_3").alias("n_supported"), F.count("target_any_3").alias("n_known"), F.coalesce(F.sum("target_any_3"), F.lit(0)).cast("long").alias("n_positive"), F.count_if("eligible_3_ge10").alias("n_ge10"))


@query("ext_complaint_signals", f"""WITH {PM}, s AS (SELECT product, m, review_month, low_star_count / n_reviews AS v FROM pm), w AS (SELECT *, lag(v) OVER o AS prev, avg(v) OVER past AS mu, stddev_pop(v) OVER past AS sd FROM s WINDOW o AS (PARTITION BY product ORDER BY m), past AS (PARTITION BY product ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT product, review_month, round(v - prev, 6) AS acceleration, round(CASE WHEN sd > 1e-9 THEN (v - mu) / sd END, 5) AS burst FROM w""")
def ext_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = windows.complaint_signals(_months(spark, sf_dir).select("product", "m", "review_month", F.col("low_star_share").alias("v")), "v")
    return d.select("product", "review_month", F.round("acceleration", 6).alias("acceleration"), F.round("burst", 5).alias("burst"))
