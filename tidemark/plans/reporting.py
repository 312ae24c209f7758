"""Reports, checks and an incremental load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import governance
from .facts import PRODUCTS_SQL, REVIEWS_SQL, products, reviews, table
from .registry import query


@query("rpt_01_funnel", f"WITH {REVIEWS_SQL} SELECT 'scanned' AS stage, domain, 'all' AS reason, count(*) AS n FROM reviews GROUP BY 2 UNION ALL SELECT 'rejected', domain, CASE WHEN NOT verified THEN 'unverified' ELSE 'cheap' END, count(*) FROM reviews WHERE NOT verified OR price < 5000 GROUP BY 2, 3 UNION ALL SELECT 'kept', domain, 'all', count(*) FROM reviews WHERE verified AND price >= 5000 GROUP BY 2")
def rpt_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir).select("domain", F.when(~F.col("verified"), "unverified").when(F.col("price") < 5000, "cheap").alias("reason"))
    end = F.struct(F.when(F.col("reason").isNull(), "kept").otherwise("rejected").alias("stage"), F.coalesce("reason", F.lit("all")).alias("reason"))
    steps = F.array(F.struct(F.lit("scanned").alias("stage"), F.lit("all").alias("reason")), end)
    return r.select("domain", F.explode(steps).alias("x")).groupBy("x.stage", "domain", "x.reason").agg(F.count("*").alias("n"))


@query("rpt_02_device_gate", f"WITH {REVIEWS_SQL}, e AS (SELECT device, count(*) AS eligible FROM products GROUP BY 1), a AS (SELECT device, count(*) AS reviewed, count(*) FILTER (WHERE rating >= 2) AS correct FROM reviews GROUP BY 1) SELECT e.device, eligible, coalesce(reviewed, 0) AS reviewed, coalesce(correct, 0) AS correct, round(correct / reviewed, 9) AS \"precision\", coalesce(correct / reviewed >= 0.8, false) AS passed FROM e LEFT JOIN a ON e.device = a.device")
def rpt_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = products(spark, sf_dir).groupBy("device").agg(F.count("*").alias("eligible"))
    a = reviews(spark, sf_dir).groupBy("device").agg(F.count("*").alias("reviewed"), F.count_if(F.col("rating") >= 2).alias("correct"))
    p = F.col("correct") / F.col("reviewed")
    d = e.join(a, "device", "left").withColumn("precision", F.round(p, 9)).withColumn("passed", F.coalesce(p >= 0.8, F.lit(False)))
    return d.fillna(0, ["reviewed", "correct"])


@query("rpt_04_recovery_flow", "SELECT p_type, count(*) AS n, count(*) FILTER (WHERE p_partkey % 5 = 0) AS n_positive, count(*) FILTER (WHERE p_partkey % 5 = 1) AS n_hold, count(*) FILTER (WHERE p_partkey % 5 > 1) AS n_excluded, round(count(*) FILTER (WHERE p_partkey % 10 = 0) / count(*) FILTER (WHERE p_partkey % 5 = 0), 9) AS \"precision\" FROM part GROUP BY 1")
def rpt_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pos = F.count_if(k % 5 == 0)
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"), pos.alias("n_positive"), F.count_if(k % 5 == 1).alias("n_hold"), F.count_if(k % 5 > 1).alias("n_excluded"), F.round(F.try_divide(F.count_if(k % 10 == 0), pos), 9).alias("precision"))


@query("rpt_05_version_comparison", "WITH a AS (SELECT p_type, count(*) AS n FROM part WHERE p_size <= 25 GROUP BY 1), b AS (SELECT p_type, count(*) AS n FROM part WHERE p_size >= 10 AND p_type <> 'PROMO' GROUP BY 1) SELECT coalesce(a.p_type, b.p_type) AS p_type, coalesce(a.n, 0) AS old_n, coalesce(b.n, 0) AS new_n, coalesce(b.n, 0) - coalesce(a.n, 0) AS net_change FROM a FULL JOIN b ON a.p_type = b.p_type")
def rpt_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = p.where("p_size <= 25").groupBy("p_type").agg(F.count("*").alias("old_n"))
    b = p.where("p_size >= 10 AND p_type <> 'PROMO'").groupBy("p_type").agg(F.count("*").alias("new_n"))
    return a.join(b, "p_type", "full").fillna(0).withColumn("net_change", F.col("new_n") - F.col("old_n"))


@query("rpt_08_split_support", f"WITH {REVIEWS_SQL}, r AS (SELECT device, CASE WHEN year(ts) <= 1999 THEN 'train' ELSE 'test' END AS split, rating <= 2 AS y FROM reviews), g AS (SELECT device, split FROM (SELECT DISTINCT device FROM products) CROSS JOIN (SELECT unnest(['train', 'validation', 'test']) AS split)) SELECT g.device, g.split, count(y) AS n, count(*) FILTER (WHERE y) AS n_positive, CASE WHEN count(y) = 0 THEN 'empty' WHEN count(*) FILTER (WHERE y) IN (0, count(y)) THEN 'one_class' ELSE 'ok' END AS status FROM g LEFT JOIN r ON g.device = r.device AND g.split = r.split GROUP BY 1, 2")
def rpt_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir).groupBy("device", F.when(F.year("ts") <= 1999, "train").otherwise("test").alias("split")).agg(F.count("*").alias("n"), F.count_if(F.col("rating") <= 2).alias("n_positive"))
    g = products(spark, sf_dir).select("device").distinct().withColumn("split", F.explode(F.array(*map(F.lit, ("train", "validation", "test")))))
    d = g.join(r, ["device", "split"], "left").fillna(0, ["n", "n_positive"])
    return d.withColumn("status", F.when(F.col("n") == 0, "empty").when((F.col("n_positive") == 0) | (F.col("n_positive") == F.col("n")), "one_class").otherwise("ok"))


@query("rpt_09_verdict", f"WITH {REVIEWS_SQL}, m AS (SELECT device, avg(CAST((rating <= 2) = (fp >= 0.5) AS INT)) AS a, avg(CAST((rating <= 2) = (pers >= 1) AS INT)) AS b, avg(CAST((rating <= 2) = (s2 >= 0.5) AS INT)) AS c FROM reviews GROUP BY 1) SELECT device, CASE WHEN b > a AND c > a THEN 'both' WHEN b > a OR c > a THEN 'mixed' ELSE 'none' END AS verdict FROM m")
def rpt_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = lambda c, t: F.avg(((F.col("rating") <= 2) == (F.col(c) >= t)).cast("int"))
    m = reviews(spark, sf_dir).groupBy("device").agg(same("fp", 0.5).alias("a"), same("pers", 1).alias("b"), same("s2", 0.5).alias("c"))
    x, y = F.col("b") > F.col("a"), F.col("c") > F.col("a")
    return m.select("device", F.when(x & y, "both").when(x | y, "mixed").otherwise("none").alias("verdict"))


@query("rpt_10_error_table", f"WITH {REVIEWS_SQL} SELECT order_id, line_no, part, ts, CASE WHEN rating <= 2 THEN 'FN' ELSE 'FP' END AS error FROM reviews WHERE (rating <= 2) <> (fp >= 0.5) AND product = 7")
def rpt_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("rating") <= 2
    return reviews(spark, sf_dir).where((low != (F.col("fp") >= 0.5)) & (F.col("product") == 7)).select("order_id", "line_no", "part", "ts", F.when(low, "FN").otherwise("FP").alias("error"))


TABLES = ("customer", "orders", "supplier")


@query("gov_01_manifest", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows, CAST((SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS INT) AS n_columns FROM {t}" for t in TABLES))
def gov_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.manifest({t: table(spark, sf_dir, t) for t in TABLES}).select("table", "n_rows", "n_columns")


@query("gov_01_data_dictionary")
def gov_01_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.data_dictionary({t: table(spark, sf_dir, t) for t in TABLES})


@query("gov_02_verifier", "SELECT 'orders_have_customers' AS \"check\", count(*) = 0 AS passed, CAST(count(*) AS VARCHAR) || ' outside' AS detail FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'order_keys_unique', count(*) = 0, CAST(count(*) AS VARCHAR) || ' repeated' FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'line_keys_unique', count(*) = 0, CAST(count(*) AS VARCHAR) || ' repeated' FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def gov_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, l = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))  # noqa: E741
    return governance.checks({
        "orders_have_customers": (o.join(c, o.o_custkey == c.c_custkey, "left_anti"), "outside"),
        "order_keys_unique": (o.groupBy("o_orderkey").count().where("count > 1"), "repeated"),
        "line_keys_unique": (l.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"), "repeated"),
    })


@query("gov_03_release", "SELECT event_id, event_type, value FROM events")
def gov_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.release(table(spark, sf_dir, "events"), private=["user_id", "ts", "props"])


@query("ext_incremental_append", f"WITH {PRODUCTS_SQL} SELECT count(*) AS n, count(DISTINCT product) AS n_keys FROM products")
def ext_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir).select("product", "device")
    old, new = p.where("product % 2 = 0"), p.where("product % 2 = 1 OR product % 10 = 0")
    return governance.append(old, new, ["product"]).agg(F.count("*").alias("n"), F.countDistinct("product").alias("n_keys"))
