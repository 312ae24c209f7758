"""Features and models over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import learning, metrics, sentiment
from ..sources.batches import spread
from ..storage import shared_folder
from .facts import REVIEWS_SQL, reviews, table
from .registry import query

# words of part names: a plain alphabet, so both engines see the same tokens
TF = """w AS (SELECT p_partkey, p_brand, regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9_][a-z0-9_]+') AS w FROM part), t AS (SELECT p_partkey, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), tf AS (SELECT p_partkey, term, count(*) AS tf FROM t GROUP BY 1, 2),
 tr AS (SELECT * FROM tf WHERE p_partkey % 3 <> 0), v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tr GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 20000), idf AS (SELECT term, ln((1 + (SELECT count(DISTINCT p_partkey) FROM tr)) / (1 + df)) + 1 AS idf FROM v),
 x AS (SELECT p_partkey, tf.term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf ON tf.term = idf.term), y AS (SELECT p_partkey, term, w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)) AS w FROM x)"""


def _tfidf(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    tf = learning.terms(docs, "p_partkey", "text")
    vocab = learning.fit_vocabulary(tf.where("p_partkey % 3 <> 0"), "p_partkey")
    return docs, learning.tfidf(tf, vocab, "p_partkey")


@query("ml_01_tfidf", f"WITH {TF} SELECT p_partkey, term, round(w, 8) AS w FROM y")
def ml_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tfidf(spark, sf_dir)[1].withColumn("w", F.round("w", 8))


@query("ml_02_mean_vectors", f"WITH {TF}, n AS (SELECT p_brand, count(*) AS n FROM w GROUP BY 1) SELECT w.p_brand, term, round(sum(y.w) / any_value(n), 8) AS w FROM y JOIN w ON y.p_partkey = w.p_partkey JOIN n ON n.p_brand = w.p_brand GROUP BY 1, 2")
def ml_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, w = _tfidf(spark, sf_dir)
    return learning.mean_vectors(w, docs.select("p_partkey", "p_brand"), "p_partkey", ["p_brand"]).withColumn("w", F.round("w", 8))


FEATURES = ["fp", "s2", "pers"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).select("order_id", "line_no", "part", (F.col("rating") <= 2).cast("int").alias("y"), F.least(F.ceil(F.col("rating") / 2), F.lit(3)).cast("int").alias("level"), *FEATURES)


def _evaluated(rows: DataFrame, p, threshold: float = 0.5) -> DataFrame:
    d = rows.withColumn("p", p).withColumn("yhat", (F.col("p") >= threshold).cast("int"))
    return metrics.binary_metrics(d, "y", "yhat").crossJoin(metrics.roc_auc(d, "y", "p"))


@query("ml_03_logistic")
def ml_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rows(spark, sf_dir)
    return _evaluated(r, learning.logistic_score(FEATURES, learning.fit_logistic(r.where("order_id % 3 <> 0"), FEATURES, "y")))


@query("ml_03_logistic_penalised")
def ml_03_penalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rows(spark, sf_dir)
    return _evaluated(r, learning.logistic_score(FEATURES, learning.fit_logistic(r.where("order_id % 3 <> 0"), FEATURES, "y", penalise_intercept=True)))


@query("ml_04_svm")
def ml_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rows(spark, sf_dir)
    w, b = learning.fit_svm(r.where("order_id % 3 <> 0"), FEATURES, "y")
    z = sum((F.col(f) * float(x) for f, x in zip(FEATURES, w, strict=True)), F.lit(float(b)))
    return _evaluated(r, z, 0.0)


@query("ml_05_majority", f"WITH {REVIEWS_SQL}, m AS (SELECT rating FROM reviews GROUP BY 1 ORDER BY count(*) DESC, rating LIMIT 1) SELECT m.rating AS prediction, count(*) FILTER (WHERE r.rating = m.rating) AS n_right, count(*) AS n FROM reviews r CROSS JOIN m GROUP BY 1")
def ml_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir)
    return r.crossJoin(F.broadcast(learning.majority(r, "rating"))).groupBy("prediction").agg(F.count_if(F.col("rating") == F.col("prediction")).alias("n_right"), F.count("*").alias("n"))


@query("ml_06_ordinal")
def ml_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rows(spark, sf_dir)
    d = r.withColumns(learning.ordinal_score(FEATURES, learning.fit_ordinal(r.where("order_id % 3 <> 0"), FEATURES, "level", (1, 2, 3)), 1))
    return metrics.ordinal_metrics(d, "level", "predicted", (1, 2, 3))


_NUL = "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END"


@query("ml_07_impute_scale", f"WITH c AS (SELECT c_custkey, {_NUL} AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer), tr AS (SELECT * FROM c WHERE c_custkey % 3 <> 0), m AS (SELECT quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb FROM tr), s AS (SELECT avg(coalesce(a, ma)) AS ua, stddev_pop(coalesce(a, ma)) AS sa, avg(b) AS ub, stddev_pop(b) AS sb FROM tr CROSS JOIN m) SELECT c_custkey, round((coalesce(a, ma) - ua) / sa, 7) AS z_a, round((coalesce(b, mb) - ub) / sb, 7) AS z_b, CAST(a IS NULL AS INT) AS missing_a, CAST(NULL AS INT) AS missing_b FROM c CROSS JOIN m CROSS JOIN s")
def ml_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    d = learning.scale(c, learning.fit_scaler(c.where("c_custkey % 3 <> 0"), ["a", "b"]), ["a", "b"])
    return d.select("c_custkey", F.round("z_a", 7).alias("z_a"), F.round("z_b", 7).alias("z_b"), "missing_a", "missing_b")


@query("ml_08_fixed_rules", f"WITH {REVIEWS_SQL}, p AS (SELECT CAST(pers >= 1 AS INT) AS y, unnest([{{'rule': 'low_star', 'p': CAST(rating <= 2 AS INT)}}, {{'rule': 'keyword', 'p': CAST(fp >= 0.7 AS INT)}}]) AS x FROM reviews) SELECT x.rule AS rule, count(*) FILTER (WHERE y = 1 AND x.p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND x.p = 1) AS fp, count(*) FILTER (WHERE y = 1 AND x.p = 0) AS fn FROM p GROUP BY 1")
def ml_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir).select((F.col("pers") >= 1).cast("int").alias("y"), F.explode(F.array(F.struct(F.lit("low_star").alias("rule"), (F.col("rating") <= 2).cast("int").alias("p")), F.struct(F.lit("keyword").alias("rule"), (F.col("fp") >= 0.7).cast("int").alias("p")))).alias("x")).select("y", "x.*")
    return metrics.binary_metrics(r, "y", "p", ["rule"]).select("rule", "tp", "fp", "fn")


@query("ml_09_batch_scores")
def ml_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rows(spark, sf_dir)
    model = learning.fit_logistic(r.where("order_id % 3 <> 0"), FEATURES, "y")
    path = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    return learning.batch_inference(r, FEATURES, model, ["order_id", "line_no", "part"], path, 4)


LEX = {"idiot": -2.5, "scum": -2.0, "worthless": -1.5, "the": 0.1, "with": 0.2}


@query("ml_10_sentiment")
def ml_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", sentiment.sentiment(F.col("text"), LEX).alias("s")).select("doc_id", "s.*")


@query("ml_11_modelling_keys", f"WITH {REVIEWS_SQL}, k AS (SELECT product, review_month, unnest([{{'horizon': 1, 'y': CAST(avg(rating) < 3 AS INT)}}, {{'horizon': 2, 'y': CAST(min(rating) = 1 AS INT)}}, {{'horizon': 3, 'y': 1}}]) AS x FROM reviews GROUP BY 1, 2) SELECT CAST(x.horizon AS INT) AS horizon, count(*) AS n, count(DISTINCT x.y) = 2 AS both_classes FROM k GROUP BY 1")
def ml_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = reviews(spark, sf_dir).groupBy("product", "review_month").agg((F.avg("rating") < 3).cast("int").alias("y1"), (F.min("rating") == 1).cast("int").alias("y2"))
    long = g.select(F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), y.alias("y")) for h, y in ((1, F.col("y1")), (2, F.col("y2")), (3, F.lit(1)))))).alias("x")).select("x.*")
    return long.groupBy("horizon").agg(F.count("*").alias("n"), (F.countDistinct("y") == 2).alias("both_classes"))


@query("ml_12_sealed_test", f"WITH {REVIEWS_SQL}, s AS (SELECT CASE WHEN year(ts) >= 2001 THEN 'test' ELSE 'dev' END AS split FROM reviews) SELECT split, count(*) AS n, split = 'dev' AS has_label FROM s GROUP BY 1")
def ml_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviews(spark, sf_dir).withColumn("y", (F.col("rating") <= 2).cast("int")).withColumn("split", F.when(F.year("ts") >= 2001, "test").otherwise("dev"))
    dev, test = learning.sealed(r, "split", "y", FEATURES, ["order_id", "line_no"])
    one = lambda d: d.groupBy("split").agg(F.count("*").alias("n")).withColumn("has_label", F.lit("y" in d.columns))
    return one(dev).unionByName(one(test))
