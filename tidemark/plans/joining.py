"""Scans, projections, joins, set algebra and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rating_stratum, time_stratum
from ..operators import audits
from .facts import PRODUCTS_SQL, REVIEWS_SQL, products, reviews, table
from .registry import query


@query("src_04_projection", "SELECT l_orderkey, l_quantity FROM lineitem")
def src_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")


@query("src_05_batches", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def src_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.batches import map_batches

    parts = map_batches(table(spark, sf_dir, "lineitem").select("l_linenumber"), lambda pdf: pdf.agg({"l_linenumber": ["count", "sum"]}).T.rename(columns={"count": "n", "sum": "total"}), "n long, total long")
    return parts.agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("src_06_pushed_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus = 'F'")
def src_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderdate < TIMESTAMP_NTZ '1997-01-01' AND o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("src_07_union_by_name", "SELECT o_orderkey, o_totalprice, NULL::VARCHAR AS note FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, NULL, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'")
def src_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a = o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    b = o.where("o_orderstatus <> 'F'").select(F.col("o_orderpriority").alias("note"), "o_orderkey")
    return a.unionByName(b, allowMissingColumns=True)


@query("prj_01_rename", "SELECT doc_id, lang AS language, n_chars FROM documents")
def prj_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("language"), "n_chars")


@query("prj_02_version_stamp", "SELECT s_suppkey, 'filter-v1' AS filter_version, CAST(7 AS INT) AS seed FROM supplier")
def prj_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("filter-v1").alias("filter_version"), F.lit(7).alias("seed"))


STRATA = f"{REVIEWS_SQL}, st AS (SELECT CASE WHEN rating <= 2 THEN 'low_1_2' WHEN rating = 3 THEN 'middle_3' ELSE 'high_4_5' END AS rs, CASE WHEN year(ts) + 20 <= 2017 THEN 'early_2011_2017' WHEN year(ts) + 20 <= 2020 THEN 'middle_2018_2020' ELSE 'recent_2021_2023' END AS tstr, fp >= 0.7 AS kw FROM reviews)"


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).select(rating_stratum(F.col("rating")).alias("rs"), time_stratum(F.add_months(F.col("ts").cast("date"), 240)).alias("tstr"), (F.col("fp") >= 0.7).alias("kw"))


@query("prj_04_strata", f"WITH {STRATA} SELECT rs, tstr, count(*) AS n FROM st GROUP BY 1, 2")
def prj_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir).groupBy("rs", "tstr").agg(F.count("*").alias("n"))


@query("prj_05_stratum_key", f"WITH {STRATA} SELECT rs || '|' || tstr || '|kw=' || CAST(kw AS INT) AS stratum, count(*) AS n FROM st GROUP BY 1")
def prj_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("|", "rs", "tstr", F.concat(F.lit("kw="), F.col("kw").cast("int").cast("string")))
    return _strata(spark, sf_dir).groupBy(key.alias("stratum")).agg(F.count("*").alias("n"))


@query("flt_01_masks", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount > 0.04 AND l_returnflag = 'A'")
def flt_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where(F.col("l_quantity").between(10, 12) & (F.col("l_discount") > 0.04) & (F.col("l_returnflag") == "A")).select("l_orderkey", "l_partkey", "l_suppkey")


@query("flt_02_boolean_mask", f"WITH {PRODUCTS_SQL} SELECT product FROM products WHERE role = 'primary' AND s_acctbal > 0")
def flt_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(spark, sf_dir).withColumn("keep", (F.col("role") == "primary") & (F.col("s_acctbal") > 0)).where("keep").select("product")


@query("flt_03_membership", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def flt_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).join(poor, "o_custkey", "left_semi").select("o_orderkey")


@query("jn_01_dimension_lookup", f"WITH {REVIEWS_SQL} SELECT device, role, count(*) AS n, CAST(sum(rating) AS BIGINT) AS stars FROM reviews GROUP BY 1, 2")
def jn_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).groupBy("device", "role").agg(F.count("*").alias("n"), F.sum("rating").alias("stars"))


@query("jn_02_reconciled_join", "WITH a AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT count(*) AS joined, (SELECT count(*) FROM a) AS n_left, (SELECT count(*) FROM orders) AS n_right FROM a JOIN orders ON l_orderkey = o_orderkey")
def jn_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    j = a.join(o, a.l_orderkey == o.o_orderkey).agg(F.count("*").alias("joined"))
    return j.crossJoin(a.agg(F.count("*").alias("n_left"))).crossJoin(o.agg(F.count("*").alias("n_right")))


@query("jn_03_left_many_to_one", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON o_custkey = c_custkey")
def jn_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").join(c, "o_custkey", "left").select("o_orderkey", "c_mktsegment")


@query("jn_04_left_with_gaps", "SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(t, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS t FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) o ON c_custkey = o_custkey")
def jn_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("t"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"), F.coalesce("t", F.lit(0.0)).alias("total"))


@query("jn_05_restricted_join", f"WITH {REVIEWS_SQL}, k AS (SELECT DISTINCT product, review_month FROM reviews WHERE product % 10 = 0 AND rating = 1) SELECT r.order_id, r.line_no, r.part, r.product, r.review_month FROM reviews r JOIN k ON r.product = k.product AND r.review_month = k.review_month")
def jn_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir)
    k = r.where("product % 10 = 0 AND rating = 1").select("product", "review_month").distinct()
    return r.join(k, ["product", "review_month"]).select("order_id", "line_no", "part", "product", "review_month")


@query("jn_06_column_equality", "SELECT count(*) AS n, count(*) FILTER (WHERE a.c_name IS DISTINCT FROM b.c_name) AS diff_c_name, count(*) FILTER (WHERE a.c_acctbal IS DISTINCT FROM b.c_acctbal) AS diff_c_acctbal FROM customer a JOIN (SELECT c_custkey, c_name, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer) b ON a.c_custkey = b.c_custkey")
def jn_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return audits.mismatches(c, c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal"))), ["c_custkey"], ["c_name", "c_acctbal"])


@query("jn_07_null_is_error", "SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL) AS n_missing FROM (SELECT doc_id + CASE WHEN doc_id % 50 = 0 THEN 1000000 ELSE 0 END AS doc_id FROM labels) l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def jn_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").select((F.col("doc_id") + F.when(F.col("doc_id") % 50 == 0, 1000000).otherwise(0)).alias("doc_id"))  # noqa: E741
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").isNotNull().alias("there"))
    return l.join(d, "doc_id", "left").agg(F.count("*").alias("n"), F.count_if(~F.coalesce("there", F.lit(False))).alias("n_missing"))


@query("jn_08_composite_key", "SELECT a.l_orderkey, a.l_partkey, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_returnflag = b.l_returnflag GROUP BY 1, 2")
def jn_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")  # noqa: E741
    return l.join(l.drop("l_partkey"), ["l_orderkey", "l_linenumber", "l_returnflag"]).groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))


@query("jn_09_index_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def jn_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("jn_10_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("jn_11_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def jn_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("jn_11_subset_check", "SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n_outside, NOT EXISTS (SELECT 1 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS is_subset")
def jn_11_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_anti")
    return out.agg(F.count("*").alias("n_outside")).withColumn("is_subset", F.col("n_outside") == 0)


@query("jn_12_cross_product", "WITH m AS (SELECT unnest(generate_series(1, 12)) AS k) SELECT n_nationkey, CAST(k AS INT) AS month FROM nation CROSS JOIN m")
def jn_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))


@query("set_01_intersection", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def set_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    part = lambda f: l.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    return part("A").intersect(part("R"))


@query("set_02_differences", "SELECT 'left' AS side, k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 3) UNION ALL SELECT 'right', k FROM (SELECT l_partkey AS k FROM lineitem WHERE l_quantity < 3 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def set_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    a, b = (l.where(w).select(F.col("l_partkey").alias("k")) for w in ("l_quantity > 49", "l_quantity < 3"))
    return a.subtract(b).select(F.lit("left").alias("side"), "k").unionByName(b.subtract(a).select(F.lit("right").alias("side"), "k"))


@query("set_03_union_all", "SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark")
def set_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    return d.unionByName(table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), "text"))


@query("set_04_extending_union", "SELECT s_suppkey AS id, s_name AS name, 'baseline' AS origin, NULL::VARCHAR AS promoted_by, false AS promoted FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, s_name, 'promoted', 'review', true FROM supplier WHERE s_suppkey % 3 = 0")
def set_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = s.where("id % 3 = 0").withColumns({"origin": F.lit("promoted"), "promoted_by": F.lit("review"), "promoted": F.lit(True)})
    return s.where("id % 3 <> 0").unionByName(new, allowMissingColumns=True).withColumns({"origin": F.coalesce("origin", F.lit("baseline")), "promoted": F.coalesce("promoted", F.lit(False))})


@query("set_05_append_check", """WITH b AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 7 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, row_number() OVER (ORDER BY o_orderstatus <> 'F', o_orderkey) AS place FROM orders)
 SELECT (SELECT count(*) FROM b) AS n_base, (SELECT count(*) FROM c) AS n_combined, (SELECT count(*) FROM b LEFT JOIN c ON b.place = c.place WHERE b.o_orderkey IS DISTINCT FROM c.o_orderkey OR b.o_totalprice IS DISTINCT FROM c.o_totalprice) AS n_changed""")
def set_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").eqNullSafe(F.lit("F")).cast("int").alias("old"), "o_orderkey", "o_totalprice")
    changed = F.when(F.col("o_orderkey") % 1000 == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))  # what the check is to find
    combined = o.withColumn("o_totalprice", changed)
    return audits.prefix_changes(o.where("old = 1").drop("old"), ["o_orderkey"], combined, [F.desc("old"), F.col("o_orderkey")])


@query("win_01_priority_dedup", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, length(l_returnflag || l_linestatus) DESC, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 999 END, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS k FROM lineitem) WHERE k = 1")
def win_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(999)
    order = [F.desc("l_quantity"), F.desc(F.length(F.concat("l_returnflag", "l_linestatus"))), rank, *(F.col(c) for c in ("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))]
    return audits.first_of_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")


MERGE = """r AS (SELECT l_orderkey AS k, l_partkey, l_quantity > 25 AS eligible, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE '' END AS title, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_linestatus END AS store, l_returnflag AS f, l_extendedprice, l_suppkey, l_linenumber, l_shipdate FROM lineitem),
 p AS (SELECT *, max(CAST(eligible AS INT)) OVER (PARTITION BY k) AS e FROM r), q AS (SELECT *, eligible OR e = 0 AS pool FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pool DESC, l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber, l_shipdate) AS n FROM q)"""


@query("win_09_ranked_merge", f"WITH {MERGE} SELECT k, arg_min(title, n) FILTER (WHERE pool AND title <> '') AS title, arg_min(store, n) FILTER (WHERE pool AND store IS NOT NULL) AS store, list_sort(list(DISTINCT f)) AS flags, count(*) AS n_records, count(*) FILTER (WHERE eligible) AS n_eligible, CASE WHEN count(*) = 1 THEN 'only_source_record' WHEN count(*) FILTER (WHERE eligible) BETWEEN 1 AND count(*) - 1 THEN 'eligible_record_preferred' ELSE 'ranked' END AS merge_rule FROM o GROUP BY k")
def win_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    r = l.select(F.col("l_orderkey").alias("k"), "l_partkey", (F.col("l_quantity") > 25).alias("eligible"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise("").alias("title"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_linestatus")).alias("store"), F.array("l_returnflag").alias("flags"), "l_extendedprice", "l_suppkey", "l_linenumber", "l_shipdate")
    return audits.merge_ranked(r, "k", [F.desc("l_extendedprice"), *(F.col(c) for c in ("l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"))], ["title", "store"], ["flags"], "eligible")


@query("jn_02_key_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.violations_of_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


