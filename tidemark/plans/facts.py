"""The review facts that the queries draw from the star-schema tables, in DataFrame form and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import month_index, month_start


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# fixed values: device types and the role of each in the analysis
DEVICES = ("smart_plug", "smart_bulb", "smart_switch")
ROLES = {"smart_plug": "primary", "smart_bulb": "exploratory", "smart_switch": "case_study"}


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per product: product, device, role."""
    kind = F.element_at(F.array(*map(F.lit, DEVICES)), F.col("s_nationkey") % 3 + 1)
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), F.col("device"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("product"), kind.alias("device"), "s_name", "s_nationkey", "s_acctbal").withColumn("role", role)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per review: keys, month, rating 1 to 5 and model scores."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    r = l.select(
        F.col("l_suppkey").alias("product"), F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_shipdate").alias("ts"), month_start(F.col("l_shipdate")).alias("review_month"), month_index(F.col("l_shipdate")).alias("m"),
        (F.pmod(F.col("l_quantity").cast("int") - 1, F.lit(5)) + 1).alias("rating"), F.col("l_returnflag").alias("domain"), (F.col("l_linestatus") == "F").alias("verified"),
        (F.col("l_discount") * 10).alias("fp"), (F.col("l_tax") * 12.5).alias("s2"), F.least(F.col("l_tax") * 12.5, F.col("l_discount") * 10).alias("s3"), (F.col("l_quantity") / 25).alias("pers"), F.col("l_extendedprice").alias("price"),
    )
    return r.join(products(spark, sf_dir).select("product", "device", "role"), "product")


PRODUCTS_SQL = """products AS (SELECT s_suppkey AS product, CASE s_nationkey % 3 WHEN 0 THEN 'smart_plug' WHEN 1 THEN 'smart_bulb' ELSE 'smart_switch' END AS device,
  CASE s_nationkey % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'exploratory' ELSE 'case_study' END AS role, s_name, s_nationkey, s_acctbal FROM supplier)"""
REVIEWS_SQL = f"""{PRODUCTS_SQL}, reviews AS (SELECT l_suppkey AS product, l_partkey AS part, l_orderkey AS order_id, l_linenumber AS line_no, l_shipdate AS ts,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS review_month, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INT) AS m, 1 + (CAST(l_quantity AS INT) - 1) % 5 AS rating, l_returnflag AS domain, l_linestatus = 'F' AS verified,
  l_discount * 10 AS fp, l_tax * 12.5 AS s2, least(l_tax * 12.5, l_discount * 10) AS s3, l_quantity / 25 AS pers, l_extendedprice AS price, device, role
  FROM lineitem JOIN products ON l_suppkey = product)"""
