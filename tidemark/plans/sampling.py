"""Samples and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import seeded_order
from ..functions.text import rating_stratum
from ..operators import sampling, targets
from .facts import REVIEWS_SQL, reviews, table
from .registry import query

SEED = 20260731


def _h(*parts: str, sep: str = "chr(0)") -> str:
    return f"sha256(concat_ws({sep}, '{SEED}', {', '.join(parts)}))"


@query("smp_01_seeded_order", f"SELECT c_custkey, {_h('CAST(c_custkey AS VARCHAR)', 'c_mktsegment')} AS rank FROM customer")
def smp_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", seeded_order(SEED, F.col("c_custkey"), F.col("c_mktsegment")).alias("rank"))


@query("smp_02_round_robin", f"WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_h('CAST(c_custkey AS VARCHAR)')}, c_custkey) AS round FROM customer) SELECT c_custkey, c_mktsegment, CAST(round AS INT) AS round FROM r ORDER BY round, c_mktsegment LIMIT 123")
def smp_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return sampling.round_robin(c, ["c_mktsegment"], seeded_order(SEED, F.col("c_custkey")), 123, ["c_custkey"])


@query("smp_03_audit_sample", f"""WITH a AS (SELECT p_partkey, p_type, {_h('CAST(p_partkey AS VARCHAR)')} AS h FROM part), e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY h, p_partkey) AS k FROM a) WHERE k <= 20), b AS (SELECT * FROM (SELECT a.*, row_number() OVER (ORDER BY h, a.p_partkey) AS k FROM a WHERE p_partkey % 7 = 0 AND p_partkey NOT IN (SELECT p_partkey FROM e)) WHERE k <= 50),
 u AS (SELECT 'eligible' AS stratum, p_partkey, h FROM e UNION ALL SELECT 'ambiguous', p_partkey, h FROM b) SELECT 'AUD-' || lpad(CAST(row_number() OVER (ORDER BY h, p_partkey) AS VARCHAR), 4, '0') AS audit_id, stratum, p_partkey FROM u""")
def smp_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    a = table(spark, sf_dir, "part").select("p_partkey", "p_type", seeded_order(SEED, F.col("p_partkey")).alias("h"))
    e = a.withColumn("k", F.row_number().over(Window.partitionBy("p_type").orderBy("h", "p_partkey"))).where("k <= 20").select(F.lit("eligible").alias("stratum"), "p_partkey", "h")
    b = a.where("p_partkey % 7 = 0").join(e.select("p_partkey"), "p_partkey", "left_anti").orderBy("h", "p_partkey").limit(50).select(F.lit("ambiguous").alias("stratum"), "p_partkey", "h")
    u = e.unionByName(b)  # a bounded sample
    return u.select(F.concat(F.lit("AUD-"), F.lpad(F.row_number().over(Window.orderBy("h", "p_partkey")).cast("string"), 4, "0")).alias("audit_id"), "stratum", "p_partkey")


@query("smp_04_recovery_sample", f"""WITH a AS (SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN 'include' WHEN 1 THEN 'hold' WHEN 2 THEN 'control' ELSE 'other' END AS role, {_h('CAST(p_partkey AS VARCHAR)')} AS h FROM part),
 r AS (SELECT *, CASE role WHEN 'include' THEN 1 WHEN 'hold' THEN 2 WHEN 'control' THEN 3 ELSE 4 END AS pri, row_number() OVER (PARTITION BY role ORDER BY h, p_partkey) AS k FROM a) SELECT role, p_partkey FROM r WHERE pri <= 2 OR pri = 3 AND k <= 25 OR pri = 4 AND k <= 40""")
def smp_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    m = F.col("p_partkey") % 11
    a = table(spark, sf_dir, "part").select("p_partkey", F.when(m == 0, "include").when(m == 1, "hold").when(m == 2, "control").otherwise("other").alias("role"), seeded_order(SEED, F.col("p_partkey")).alias("h"))
    whole = a.where(F.col("role").isin("include", "hold"))
    quota = F.when(F.col("role") == "control", 25).otherwise(40)
    part = a.where(~F.col("role").isin("include", "hold")).withColumn("k", F.row_number().over(Window.partitionBy("role").orderBy("h", "p_partkey"))).where(F.col("k") <= quota)
    return whole.select("role", "p_partkey").unionByName(part.select("role", "p_partkey"))


POOL = f"""{REVIEWS_SQL}, pool AS (SELECT order_id * 10 + line_no AS k, product, device, CASE WHEN fp BETWEEN 0.4 AND 0.6 THEN 'high_uncertainty' WHEN (rating <= 2) <> (pers >= 1.2) THEN 'rating_keyword_disagreement' ELSE 'diversity_control' END AS bucket,
 CASE WHEN rating <= 2 THEN 'low_1_2' WHEN rating = 3 THEN 'middle_3' ELSE 'high_4_5' END AS rs FROM (SELECT *, row_number() OVER (PARTITION BY order_id, line_no ORDER BY part, product, ts, price) AS q FROM reviews) WHERE q = 1)"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.audits import first_of_key

    r = first_of_key(reviews(spark, sf_dir), ["order_id", "line_no"], [F.col(c) for c in ("part", "product", "ts", "price")])
    return r.select((F.col("order_id") * 10 + F.col("line_no")).alias("k"), "product", "device", sampling.assign_bucket(F.col("fp"), F.col("rating") <= 2, F.col("pers") >= 1.2).alias("bucket"), rating_stratum(F.col("rating")).alias("rs"))


@query("smp_05_buckets", f"WITH {POOL} SELECT bucket, rs, count(*) AS n FROM pool GROUP BY 1, 2")
def smp_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir).groupBy("bucket", "rs").agg(F.count("*").alias("n"))


def _div(source: str, purpose: str) -> str:
    return f"""SELECT *, row_number() OVER (ORDER BY pr, sh, rh, k) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY rh, k) - 1 AS pr FROM (SELECT *, {_h(f"'{purpose}'", 'CAST(k AS VARCHAR)')} AS rh, {_h(f"'{purpose}|stratum'", 'rs')} AS sh FROM {source}))"""


@query("win_05_diversity_order", f"WITH {POOL}, o AS ({_div('pool', 'div')}) SELECT k, CAST(pr AS INT) AS parent_round, pos AS place FROM o")
def win_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sampling.diversity_order(_pool(spark, sf_dir), SEED, "div", "product", "k", ["rs"])
    return targets.ranked(d, [*sampling.ORDER, "k"]).select("k", "parent_round", "place")


SHARES = {"high_uncertainty": 0.4, "rating_keyword_disagreement": 0.3, "diversity_control": 0.3}
MIX = sampling.bucket_targets(232, SHARES)


@query("smp_06_bucket_mix", f"""WITH {POOL}, {', '.join(f"b{i} AS ({_div(f'(SELECT * FROM pool WHERE bucket = {chr(39)}{b}{chr(39)})', f'mix|bucket={b}')})" for i, b in enumerate(sampling.BUCKETS))}
, t AS ({' UNION ALL '.join(f"SELECT k, bucket FROM b{i} WHERE pos <= {MIX[b]}" for i, b in enumerate(sampling.BUCKETS))}), f AS ({_div('(SELECT * FROM pool WHERE k NOT IN (SELECT k FROM t))', 'mix|fallback')})
 SELECT k, bucket, 'bucket' AS stage FROM t UNION ALL SELECT k, bucket, 'fallback' FROM f WHERE pos <= {sum(MIX.values())} - (SELECT count(*) FROM t)""")
def smp_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bucket_mix(_pool(spark, sf_dir), 232, SHARES, SEED, "mix", "product", "k", ["rs"]).select("k", "bucket", "stage")


@query("smp_07_apportionment", "WITH s AS (SELECT c_mktsegment, count(*) / (SELECT count(*) FROM customer) AS share FROM customer GROUP BY 1), f AS (SELECT *, CAST(101 AS DOUBLE) * share AS raw FROM s), p AS (SELECT *, floor(raw) AS f, row_number() OVER (ORDER BY raw - floor(raw) DESC, c_mktsegment DESC) AS k, 101 - sum(floor(raw)) OVER () AS l FROM f) SELECT c_mktsegment, CAST(f AS BIGINT) + CASE WHEN k <= l THEN 1 ELSE 0 END AS target FROM p")
def smp_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = c.agg(F.count("*").alias("n"))
    s = c.groupBy("c_mktsegment").agg(F.count("*").alias("k")).crossJoin(F.broadcast(n)).select("c_mktsegment", (F.col("k") / F.col("n")).alias("share"))
    return sampling.apportion(s, "c_mktsegment", "share", 101).withColumn("target", F.col("target").cast("long"))


@query("smp_08_balanced_select")
def smp_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pool(spark, sf_dir)
    time = F.element_at(F.array(*map(F.lit, sampling.TIME_SHARES)), (F.col("k") % 3).cast("int") + 1)
    pool = p.select("device", F.col("k").alias("duplicate_key"), F.col("product").cast("string").alias("parent_asin"), (F.col("bucket") != "diversity_control").alias("keyword_candidate_hit"), F.col("rs").alias("rating_stratum"), time.alias("time_stratum"))
    return sampling.balanced_select(pool, 60, SEED, "select", "device")


@query("smp_09_batches", f"""WITH {POOL}, q AS (SELECT *, CASE device WHEN 'smart_plug' THEN 30 WHEN 'smart_bulb' THEN 20 ELSE 10 END AS quota FROM pool), r AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY {_h('CAST(k AS VARCHAR)')}, k) AS n FROM q) SELECT k, device, CAST((n - 1) // quota + 1 AS INT) AS batch FROM r WHERE n <= quota * 4""")
def smp_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.batches(_pool(spark, sf_dir), "k", "device", SEED, {"smart_plug": 30, "smart_bulb": 20, "smart_switch": 10}, 4).select("k", "device", "batch")


BOOT = f"""{REVIEWS_SQL}, c AS (SELECT product, row_number() OVER (ORDER BY product) - 1 AS place FROM (SELECT DISTINCT product FROM reviews)), n AS (SELECT count(*) AS n FROM c), s AS (SELECT place AS slot, r AS replicate, n FROM c CROSS JOIN range(40) t(r) CROSS JOIN n),
 d AS (SELECT replicate, CAST(('0x' || substr({_h('CAST(replicate AS VARCHAR)', 'CAST(slot AS VARCHAR)')}, 1, 12)) AS BIGINT) % n AS place FROM s), w AS (SELECT replicate, place, count(*) AS times FROM d GROUP BY 1, 2), dr AS (SELECT replicate, product, times FROM w JOIN c ON w.place = c.place),
 t AS (SELECT product, count(*) FILTER (WHERE rating <= 2 AND fp >= 0.5) AS tp, count(*) FILTER (WHERE rating > 2 AND fp >= 0.5) AS fp, count(*) FILTER (WHERE rating <= 2 AND fp < 0.5) AS fn FROM reviews GROUP BY 1)"""


def _draws(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = reviews(spark, sf_dir)
    low, hit = F.col("rating") <= 2, F.col("fp") >= 0.5
    t = r.groupBy("product").agg(F.count_if(low & hit).alias("tp"), F.count_if(~low & hit).alias("fp"), F.count_if(low & ~hit).alias("fn"))
    return sampling.bootstrap_draws(r.select("product").distinct(), "product", 40, SEED), t


@query("smp_10_bootstrap_draws", f"WITH {BOOT} SELECT replicate, product, times FROM dr")
def smp_10_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _draws(spark, sf_dir)[0]


@query("smp_10_bootstrap_interval", f"WITH {BOOT}, m AS (SELECT replicate, 2 * sum(tp * times) / (2 * sum(tp * times) + sum(fp * times) + sum(fn * times)) - 0.45 AS f1 FROM dr JOIN t ON dr.product = t.product GROUP BY 1) SELECT count(f1) AS n_replicates, round(quantile_cont(f1, 0.025), 9) AS low, round(quantile_cont(f1, 0.975), 9) AS high, quantile_cont(f1, 0.025) <= 0 AND quantile_cont(f1, 0.975) >= 0 AS crosses_zero FROM m")
def smp_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws, t = _draws(spark, sf_dir)
    s = lambda c: F.sum(F.col(c) * F.col("times"))
    m = draws.join(t, "product").groupBy("replicate").agg((2 * s("tp") / (2 * s("tp") + s("fp") + s("fn")) - 0.45).alias("f1"))
    return sampling.bootstrap_interval(m, "f1").withColumns({c: F.round(c, 9) for c in ("low", "high")})


@query("srt_01_stable_sort", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS place FROM orders")
def srt_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return targets.ranked(o, [F.col("o_orderpriority"), F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_orderkey", "place")


@query("srt_02_top_bottom", "WITH r AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS t, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS b FROM customer) SELECT 'top' AS side, t AS rank, c_custkey, c_acctbal FROM r WHERE t <= 20 UNION ALL SELECT 'bottom', b, c_custkey, c_acctbal FROM r WHERE b <= 20")
def srt_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")

    def side(name: str, order: list) -> DataFrame:
        return c.orderBy(*order).limit(20).select(F.lit(name).alias("side"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "c_custkey", "c_acctbal")

    return side("top", [F.desc("c_acctbal"), F.col("c_custkey")]).unionByName(side("bottom", [F.col("c_acctbal"), F.col("c_custkey")]))


@query("win_10_sequential_ids", f"SELECT c_custkey, 'W-' || lpad(CAST(row_number() OVER (ORDER BY {_h('CAST(c_custkey AS VARCHAR)')}, c_custkey) AS VARCHAR), 6, '0') AS blind_id FROM customer")
def win_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", seeded_order(SEED, F.col("c_custkey")).alias("h"))
    return targets.ranked(c, ["h", "c_custkey"]).select("c_custkey", F.concat(F.lit("W-"), F.lpad(F.col("place").cast("string"), 6, "0")).alias("blind_id"))
