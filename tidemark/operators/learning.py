"""Features and models: TF-IDF in long form, train-only scaling, logistic regression, ordinal models, fixed rules."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import expected_value, hard_class, monotone


def terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): words of two characters or more and pairs of them, with their counts in each text."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), 0)
    w = docs.select(key, words.alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return w.select(key, F.explode(F.concat("w", pairs)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def fit_vocabulary(tf: DataFrame, key: str, min_df: int = 2, max_terms: int = 20_000) -> DataFrame:
    """(term, idf) of the most frequent terms of the training texts: idf = ln((1 + n) / (1 + df)) + 1."""
    n = tf.agg(F.countDistinct(key).alias("n"))
    v = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df).orderBy(F.desc("total"), "term").limit(max_terms)
    return v.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(tf: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, term, w): (1 + ln tf) * idf, each text scaled to length 1.  The vocabulary has a bounded number of rows."""
    d = tf.join(F.broadcast(vocabulary), "term").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    return d.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).select(key, "term", "w")


def mean_vectors(weights: DataFrame, members: DataFrame, key: str, group: Sequence[str]) -> DataFrame:
    """(group, term, w): the mean of a group's text vectors, also over texts without any known term."""
    n = members.groupBy(*group).agg(F.count("*").alias("__n"))
    return weights.join(members, key).groupBy(*group, "term").agg(F.sum("w").alias("s")).join(n, list(group)).select(*group, "term", (F.col("s") / F.col("__n")).alias("w"))


def fit_scaler(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: median, mean and population deviation (1 where it is 0) of each column after imputing its median."""
    med = train.agg(*(F.percentile(c, 0.5).alias(f"median_{c}") for c in columns), *(F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns))
    filled = train.crossJoin(F.broadcast(med)).select(*(F.coalesce(c, f"median_{c}").alias(c) for c in columns))
    sd = lambda c: F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0)
    return med.crossJoin(filled.agg(*(F.avg(c).alias(f"mean_{c}") for c in columns), *(sd(c).alias(f"sd_{c}") for c in columns)))


def scale(rows: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with z_<column>, and missing_<column> (null where training had no missing values)."""
    d = rows.crossJoin(F.broadcast(scaler))
    z = {f"z_{c}": (F.coalesce(c, f"median_{c}") - F.col(f"mean_{c}")) / F.col(f"sd_{c}") for c in columns}
    miss = {f"missing_{c}": F.when(F.col(f"nulls_{c}") > 0, F.col(c).isNull().cast("int")) for c in columns}
    return d.withColumns(z | miss).drop(*scaler.columns)


def majority(train: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent label, the smaller of equally frequent ones."""
    return train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label).limit(1).select(F.col(label).alias("prediction"))


def _weighted(train: DataFrame, label: str) -> tuple[DataFrame, float]:
    n = {r[0]: r[1] for r in train.groupBy(label).count().collect()}  # two classes
    if len(n) != 2:
        raise ValueError("training rows need both classes")
    total = sum(n.values())
    w = F.when(F.col(label) == 1, total / (2 * n[1])).otherwise(total / (2 * n[0]))
    return train.withColumn("__w", w), float(total)


def fit_logistic(train: DataFrame, features: Sequence[str], label: str, c: float = 1.0, penalise_intercept: bool = False):
    """L2 logistic regression with balanced classes; 1/(c * total weight) is Spark's regularisation.

    With penalise_intercept the intercept is one more penalised weight: a column of ones, kept from being constant (Spark
    would drop it) by turning every other row about the origin, which leaves the loss without intercept as it is.
    """
    d, total = _weighted(train, label)
    cols = list(features)
    if penalise_intercept:
        turn = F.when(F.pmod(F.xxhash64(*cols), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        d = d.withColumn("__t", turn).withColumns({f"__x{i}": F.col(f) * F.col("__t") for i, f in enumerate(cols)}).withColumn("__one", F.col("__t"))
        d = d.withColumn("__y", F.when(F.col("__t") > 0, F.col(label)).otherwise(1 - F.col(label)).cast("double"))
        cols = [f"__x{i}" for i in range(len(features))] + ["__one"]
    else:
        d = d.withColumn("__y", F.col(label).cast("double"))
    d = VectorAssembler(inputCols=cols, outputCol="__v").transform(d)
    m = LogisticRegression(featuresCol="__v", labelCol="__y", weightCol="__w", regParam=1 / (c * total), elasticNetParam=0.0, standardization=False, fitIntercept=not penalise_intercept, maxIter=200, tol=1e-9).fit(d)
    w = list(m.coefficients)
    return (w[:-1], w[-1]) if penalise_intercept else (w, m.intercept)


def logistic_score(features: Sequence[str], model: tuple[Sequence[float], float]) -> Column:
    """P(1) as a column expression: scoring needs no Python."""
    z = F.lit(float(model[1]))
    for f, w in zip(features, model[0], strict=True):
        z = z + F.col(f) * float(w)
    return 1 / (1 + F.exp(-z))


def fit_svm(train: DataFrame, features: Sequence[str], label: str, c: float = 1.0, steps: int = 50, tol: float = 1e-10):
    """A linear support vector machine with squared hinge loss and balanced classes: weights and intercept.

    The intercept is one more penalised weight; score 0 and above is class 1.  Newton's method on the rows inside the
    margin: a step is one aggregation of their gradient and second derivatives, halved while the loss would rise.
    """
    import numpy as np

    d, _ = _weighted(train, label)
    x = [F.col(f).cast("double") for f in features] + [F.lit(1.0)]
    y, n = F.when(F.col(label) == 1, 1.0).otherwise(-1.0), len(features) + 1

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        gap = 1 - y * sum((a * float(b) for a, b in zip(x, w, strict=True)), F.lit(0.0))
        inside = F.col("__gap") > 0
        of = lambda v: F.coalesce(F.sum(F.when(inside, F.col("__w") * v)), F.lit(0.0))
        firsts = [of(F.col("__gap") * y * a) for a in x]
        seconds = [of(x[i] * x[j]) for i in range(n) for j in range(i, n)]
        r = list(d.withColumn("__gap", gap).agg(of(F.col("__gap") * F.col("__gap")), *firsts, *seconds).first())
        h = np.zeros((n, n))
        h[np.triu_indices(n)] = r[n + 1 :]
        h = np.eye(n) + 2 * c * (h + np.triu(h, 1).T)
        return w @ w / 2 + c * r[0], w - 2 * c * np.array(r[1 : n + 1]), h

    w = np.zeros(n)
    loss, g, h = sums(w)
    for _ in range(steps):
        step = np.linalg.solve(h, g)
        for _ in range(30):
            after = sums(w - step)
            if after[0] <= loss + 1e-12 * abs(loss):
                break
            step = step / 2
        done = loss - after[0] <= tol * max(1.0, abs(loss))
        w, (loss, g, h) = w - step, after
        if done:
            break
    return w[:-1].tolist(), float(w[-1])


def fit_ordinal(train: DataFrame, features: Sequence[str], label: str, levels: Sequence[int]) -> list[tuple[Sequence[float], float]]:
    """One logistic model for each P(label >= level), from the second level on."""
    return [fit_logistic(train.withColumn("__o", (F.col(label) >= v).cast("int")), features, "__o") for v in levels[1:]]


def ordinal_score(features: Sequence[str], models: Sequence[tuple[Sequence[float], float]], base: int) -> dict[str, Column]:
    ps = monotone([logistic_score(features, m) for m in models])
    return {"expected": expected_value(ps, base), "predicted": hard_class(ps, base)}


class FrozenModelError(ValueError):
    """Scores were begun with another model."""


def model_fingerprint(features: Sequence[str], model: tuple[Sequence[float], float]) -> str:
    exact = [[f, float(w).hex()] for f, w in zip(features, model[0], strict=True)]
    return hashlib.sha256(json.dumps([exact, float(model[1]).hex()]).encode()).hexdigest()


def batch_inference(df: DataFrame, features: Sequence[str], model: tuple[Sequence[float], float], keys: Sequence[str], path: str, chunks: int = 8) -> DataFrame:
    """(keys, score) of every row, written in chunks under path; a run that is begun again writes only missing chunks.

    A chunk is the rows whose keys' hash falls to it, and is there when its folder is committed.  The fingerprint of the
    model is written first; a later run with another model or another number of chunks is refused.
    """
    spark = df.sparkSession
    mark = model_fingerprint(features, model)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path
    fs = folder(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(folder(f"{path}/model/_SUCCESS")):
        held = spark.read.json(f"{path}/model").first()
        if (held["fingerprint"], held["chunks"]) != (mark, chunks):
            raise FrozenModelError(f"{path} holds scores of another model or split")
    else:
        spark.createDataFrame([(mark, chunks)], "fingerprint string, chunks int").coalesce(1).write.mode("overwrite").json(f"{path}/model")
    scored = df.select(*keys, logistic_score(features, model).alias("score"), F.pmod(F.xxhash64(*keys), F.lit(chunks)).alias("__chunk"))
    parts = []
    for k in range(chunks):
        part = f"{path}/scores/chunk={k}"
        if not fs.exists(folder(f"{part}/_SUCCESS")):
            scored.where(F.col("__chunk") == k).drop("__chunk").write.mode("overwrite").option("compression", "zstd").parquet(part)
        parts.append(part)
    return spark.read.schema(scored.drop("__chunk").schema).parquet(*parts)


def sealed(rows: DataFrame, split: str, label: str, features: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Development rows with the label, and test rows whose label is never read."""
    dev = rows.where(F.col(split) != "test").select(*keys, split, *features, label)
    return dev, rows.where(F.col(split) == "test").select(*keys, split, *features)


