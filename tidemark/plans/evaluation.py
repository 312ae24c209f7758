"""Labels, agreement and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits, labels, metrics
from .facts import REVIEWS_SQL, reviews, table
from .registry import query

# predictions: the label is a low rating, the score has eleven levels, so ties are many
PRED = f"{REVIEWS_SQL}, p AS (SELECT product, device, CAST(rating <= 2 AS INT) AS y, fp AS s, CAST(fp >= 0.5 AS INT) AS yhat, round(fp * 10) AS lvl FROM reviews)"


def _pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).select("product", "device", (F.col("rating") <= 2).cast("int").alias("y"), F.col("fp").alias("s"), (F.col("fp") >= 0.5).cast("int").alias("yhat"))


def _binary_sql(keys: str, source: str, label: str = "y", predicted: str = "yhat") -> str:
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    r = lambda n, d: f"CASE WHEN {d} = 0 THEN 0.0 ELSE ({n}) / ({d}) END"
    return f"""c AS (SELECT {k}count(*) FILTER (WHERE {label} = 0 AND {predicted} = 0) AS tn, count(*) FILTER (WHERE {label} = 0 AND {predicted} = 1) AS fp, count(*) FILTER (WHERE {label} = 1 AND {predicted} = 0) AS fn, count(*) FILTER (WHERE {label} = 1 AND {predicted} = 1) AS tp FROM {source} {g}),
 b AS (SELECT *, {r('tp', 'tp + fp')} AS pr, {r('tp', 'tp + fn')} AS re, {r('tn', 'tn + fp')} AS sp FROM c),
 bm AS (SELECT {k}tn, fp, fn, tp, round((tp + tn) / (tn + fp + fn + tp), 9) AS accuracy, round((re + sp) / 2, 9) AS balanced_accuracy, round(pr, 9) AS "precision", round(re, 9) AS recall, round({r('2 * tp', '2 * tp + fp + fn')}, 9) AS f1, round(sp, 9) AS specificity FROM b)"""


RATIOS = ("accuracy", "balanced_accuracy", "precision", "recall", "f1", "specificity")


def _rounded(d: DataFrame, columns: tuple[str, ...] = RATIOS, digits: int = 9) -> DataFrame:
    return d.withColumns({c: F.round(c, digits) for c in columns})


@query("met_01_binary_metrics", f"WITH {PRED}, {_binary_sql('device', 'p')} SELECT * FROM bm")
def met_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.binary_metrics(_pred(spark, sf_dir), "y", "yhat", ["device"]))


AUC = """g AS (SELECT device, s, sum(y) AS pos, count(*) - sum(y) AS neg FROM p GROUP BY 1, 2), h AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY device ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)"""


@query("met_02_roc_auc", f"WITH {PRED}, {AUC} SELECT device, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / (2 * CAST(sum(pos) AS DOUBLE) * sum(neg)) END, 9) AS roc_auc FROM h GROUP BY 1")
def met_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.roc_auc(_pred(spark, sf_dir), "y", "s", ["device"]), ("roc_auc",))


@query("met_03_average_precision", f"""WITH {PRED}, g AS (SELECT device, s, CAST(sum(y) AS BIGINT) AS pos, count(*) AS n FROM p GROUP BY 1, 2), h AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS al FROM g WINDOW w AS (PARTITION BY device ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT device, round(CASE WHEN sum(pos) > 0 THEN sum(pos * (CAST(tp AS DOUBLE) / al)) / sum(pos) END, 9) AS average_precision FROM h GROUP BY 1""")
def met_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.average_precision(_pred(spark, sf_dir), "y", "s", ["device"]), ("average_precision",))


@query("met_04_brier", f"WITH {PRED} SELECT device, round(avg((s - y) * (s - y)), 8) AS brier FROM p GROUP BY 1")
def met_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.brier(_pred(spark, sf_dir), "y", "s", ["device"]), ("brier",), 8)


def _calibration_sql(expr: str) -> str:
    return f"""WITH {PRED}, b AS (SELECT least(9, greatest(0, CAST({expr} AS INT))) AS bin, s, y FROM (SELECT *, l_tax_s FROM (SELECT y, l_tax * 12.5 AS l_tax_s, l_tax * 12.5 AS s FROM (SELECT l_tax, CAST(1 + (CAST(l_quantity AS INT) - 1) % 5 <= 2 AS INT) AS y FROM lineitem) q) r) t),
 g AS (SELECT bin, count(*) AS n, avg(s) AS ms, avg(y) AS ob FROM b GROUP BY 1) SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n, round(ms, 8) AS mean_score, round(ob, 8) AS observed, round(abs(ms - ob), 8) AS gap FROM range(10) r(i) LEFT JOIN g ON g.bin = i"""


def _calibrated(spark: SparkSession, sf_dir: str, closed: bool) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    y = (F.pmod(F.col("l_quantity").cast("int") - 1, F.lit(5)) + 1 <= 2).cast("int")
    return metrics.calibration(l.select((F.col("l_tax") * 12.5).alias("s"), y.alias("y")), "y", "s", 10, closed)


@query("met_05_calibration_right", _calibration_sql("ceil(s * 10) - 1"))
def met_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_calibrated(spark, sf_dir, True), ("mean_score", "observed", "gap"), 8)


@query("met_05_calibration_left", _calibration_sql("floor(s * 10)"))
def met_05_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_calibrated(spark, sf_dir, False), ("mean_score", "observed", "gap"), 8)


@query("met_05_calibration_error", _calibration_sql("ceil(s * 10) - 1").replace("SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS n, round(ms, 8) AS mean_score, round(ob, 8) AS observed, round(abs(ms - ob), 8) AS gap FROM range(10) r(i) LEFT JOIN g ON g.bin = i", "SELECT round(sum(abs(ms - ob) * n) / sum(n), 8) AS ece FROM g"))
def met_05_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.expected_calibration_error(_calibrated(spark, sf_dir, True)), ("ece",), 8)


ORD = f"{REVIEWS_SQL}, o AS (SELECT device, CAST(ceil(rating / 2.0) AS INT) AS a, 1 + CAST(s2 >= 0.5 AS INT) + CAST(s3 >= 0.5 AS INT) AS b FROM reviews)"


def _ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).select("device", F.ceil(F.col("rating") / 2.0).cast("int").alias("a"), (1 + (F.col("s2") >= 0.5).cast("int") + (F.col("s3") >= 0.5).cast("int")).alias("b"))


_F1 = " + ".join(f"CASE WHEN count(*) FILTER (WHERE a = {v}) + count(*) FILTER (WHERE b = {v}) = 0 THEN 0.0 ELSE 2 * count(*) FILTER (WHERE a = {v} AND b = {v}) / (count(*) FILTER (WHERE a = {v}) + count(*) FILTER (WHERE b = {v})) END" for v in (1, 2, 3))


@query("met_06_ordinal_metrics", f"WITH {ORD} SELECT device, count(*) AS n, round(avg(CAST(a = b AS INT)), 9) AS accuracy, round(avg(abs(a - b)), 9) AS mae, round(({_F1}) / 3, 9) AS macro_f1 FROM o GROUP BY 1")
def met_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.ordinal_metrics(_ord(spark, sf_dir), "a", "b", (1, 2, 3), ["device"]), ("accuracy", "mae", "macro_f1"))


@query("met_07_gated_metrics", f"WITH {PRED}, q AS (SELECT CAST(product AS VARCHAR) AS device, y, yhat FROM p), {_binary_sql('device', 'q')} SELECT device, tn + fp + fn + tp AS n, tn + fp + fn + tp >= 600 AND least(tn + fp, fn + tp) >= 230 AS supported, CASE WHEN tn + fp + fn + tp >= 600 AND least(tn + fp, fn + tp) >= 230 THEN f1 END AS f1 FROM bm")
def met_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.binary_metrics(_pred(spark, sf_dir).withColumn("device", F.col("product").cast("string")), "y", "yhat", ["device"])
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    ok = (n >= 600) & (F.least(F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")) >= 230)
    return d.select("device", n.alias("n"), ok.alias("supported"), F.when(ok, F.round("f1", 9)).alias("f1"))


ROUTES = f"{PRED}, rt AS (SELECT 'score' AS route, y, yhat FROM p UNION ALL SELECT 'strict', y, CAST(s >= 0.8 AS INT) FROM p UNION ALL SELECT 'never', y, 0 FROM p), {_binary_sql('route', 'rt')}"


def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pred(spark, sf_dir)
    long = p.select("y", F.explode(F.array(F.struct(F.lit("score").alias("route"), F.col("yhat")), F.struct(F.lit("strict").alias("route"), (F.col("s") >= 0.8).cast("int").alias("yhat")), F.struct(F.lit("never").alias("route"), F.lit(0).alias("yhat")))).alias("x")).select("y", "x.*")
    return metrics.binary_metrics(long, "y", "yhat", ["route"])


@query("met_08_route_deltas", f"WITH {ROUTES} SELECT a.route AS route, b.route AS against, round(a.f1 - b.f1, 8) AS delta_f1, round(a.accuracy - b.accuracy, 8) AS delta_accuracy FROM bm a JOIN bm b ON a.route < b.route")
def met_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _rounded(_routes(spark, sf_dir))
    return labels.deltas(m, "route", ["f1", "accuracy"]).withColumns({c: F.round(c, 8) for c in ("delta_f1", "delta_accuracy")})


@query("met_09_overfit_gap", f"WITH {PRED}, q AS (SELECT CASE WHEN product % 2 = 0 THEN 'train' ELSE 'validation' END AS split, y, yhat FROM p), {_binary_sql('split', 'q')} SELECT round(max(f1) FILTER (WHERE split = 'train') - max(f1) FILTER (WHERE split = 'validation'), 8) AS gap, max(f1) FILTER (WHERE split = 'train') - max(f1) FILTER (WHERE split = 'validation') >= 0.15 AS overfit FROM bm")
def met_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _rounded(metrics.binary_metrics(_pred(spark, sf_dir).withColumn("split", F.when(F.col("product") % 2 == 0, "train").otherwise("validation")), "y", "yhat", ["split"]))
    return labels.overfit_gap(d).withColumn("gap", F.round("gap", 8))


@query("met_10_reproduction", "SELECT count(*) AS n, count(*) FILTER (WHERE (o_totalprice >= 100000) <> (o_totalprice * (1 + CASE WHEN o_orderkey % 50 = 0 THEN 0.001 ELSE 0 END) >= 100000)) AS prediction_mismatches, count(*) FILTER (WHERE abs(o_totalprice - o_totalprice * (1 + CASE WHEN o_orderkey % 50 = 0 THEN 0.001 ELSE 0 END)) > 1e-8 + 1e-5 * abs(o_totalprice * (1 + CASE WHEN o_orderkey % 50 = 0 THEN 0.001 ELSE 0 END))) AS score_mismatches, round(max(abs(o_totalprice - o_totalprice * (1 + CASE WHEN o_orderkey % 50 = 0 THEN 0.001 ELSE 0 END))), 6) AS max_diff, round(avg(abs(o_totalprice - o_totalprice * (1 + CASE WHEN o_orderkey % 50 = 0 THEN 0.001 ELSE 0 END))), 6) AS mean_diff FROM orders")
def met_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    a = o.select("o_orderkey", F.col("o_totalprice").alias("score"), (F.col("o_totalprice") >= 100000).cast("int").alias("yhat"))
    x = F.col("o_totalprice") * (1 + F.when(F.col("o_orderkey") % 50 == 0, 0.001).otherwise(0.0))
    b = o.select("o_orderkey", x.alias("score"), (x >= 100000).cast("int").alias("yhat"))
    return _rounded(metrics.closeness(a, b, ["o_orderkey"], "score", "yhat"), ("max_diff", "mean_diff"), 6)


@query("met_11_error_types", f"WITH {PRED} SELECT device, CASE WHEN y = 1 THEN 'FN' ELSE 'FP' END AS error, count(*) AS n FROM p WHERE y <> yhat GROUP BY 1, 2")
def met_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.error_rows(_pred(spark, sf_dir), "y", "yhat").groupBy("device", "error").agg(F.count("*").alias("n"))


@query("ext_precision_at_k", "WITH o AS (SELECT o_orderkey, CAST(o_orderpriority LIKE '1%' AS INT) AS y, o_totalprice AS s FROM orders), t AS (SELECT *, row_number() OVER (ORDER BY s DESC, o_orderkey) AS k FROM o), a AS (SELECT unnest([10, 100, 1000]) AS cut) SELECT CAST(cut AS INT) AS cut, round(sum(y) / count(*), 9) AS \"precision\", round(sum(y) / (SELECT sum(y) FROM o), 9) AS recall FROM t JOIN a ON k <= cut GROUP BY 1")
def ext_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").like("1%").cast("int").alias("y"), F.col("o_totalprice").alias("s"))
    return _rounded(metrics.precision_at(o, "y", "s", ["o_orderkey"], [10, 100, 1000]), ("precision", "recall"))


def _kappa_sql(levels: tuple[int, ...], source: str, w: str, key: str = "") -> str:
    k = f"{key}, " if key else ""
    by = f"PARTITION BY {key}, " if key else "PARTITION BY "
    keys = f"(SELECT DISTINCT {key} FROM {source}) ks CROSS JOIN " if key else ""
    on = f"AND {source}.{key} = ks.{key} " if key else ""
    ksel = f"ks.{key}, " if key else ""
    return f"""lv AS (SELECT unnest({list(levels)}) AS v), gr AS (SELECT {ksel}l1.v AS a, l2.v AS b, count({source}.a) AS n FROM {keys}lv l1 CROSS JOIN lv l2 LEFT JOIN {source} ON {source}.a = l1.v AND {source}.b = l2.v {on}GROUP BY ALL),
 ge AS (SELECT *, sum(n) OVER ({by}a) * sum(n) OVER ({by}b) AS e, {w} AS w FROM gr),
 kp AS (SELECT {k}CAST(sum(n) AS BIGINT) AS n, round(sum(n) FILTER (WHERE a = b) / sum(n), 9) AS agreement, round(CASE WHEN sum(w * e) > 0 THEN 1 - CAST(sum(w * n) AS DOUBLE) * sum(n) / sum(w * e) END, 9) AS kappa FROM ge {f'GROUP BY {key}' if key else ''})"""


@query("sta_01_kappa", f"WITH src AS (SELECT quality AS a, toxic AS b FROM labels), {_kappa_sql((0, 1), 'src', 'CAST(a <> b AS DOUBLE)')} SELECT * FROM kp")
def sta_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.kappa(table(spark, sf_dir, "labels"), "quality", "toxic", (0, 1)), ("agreement", "kappa"))


@query("sta_01_kappa_linear", f"WITH {ORD}, src AS (SELECT device, a, b FROM o), {_kappa_sql((1, 2, 3), 'src', 'abs(a - b)', 'device')} SELECT * FROM kp")
def sta_01_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.kappa(_ord(spark, sf_dir), "a", "b", (1, 2, 3), "linear", ["device"]), ("agreement", "kappa"))


@query("sta_01_kappa_quadratic", f"WITH {ORD}, src AS (SELECT device, a, b FROM o), {_kappa_sql((1, 2, 3), 'src', '(a - b) * (a - b)', 'device')} SELECT * FROM kp")
def sta_01_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.kappa(_ord(spark, sf_dir), "a", "b", (1, 2, 3), "quadratic", ["device"]), ("agreement", "kappa"))


@query("sta_02_raw_agreement", f"WITH {ORD}, u AS (SELECT CASE WHEN a = 2 THEN 'uncertain' ELSE CAST(a AS VARCHAR) END AS x, CASE WHEN b = 2 THEN 'uncertain' ELSE CAST(b AS VARCHAR) END AS y FROM o) SELECT count(*) AS n, round(avg(CAST(x = y AS INT)), 9) AS agreement, count(*) FILTER (WHERE x <> 'uncertain' AND y <> 'uncertain') AS n_certain, round(avg(CAST(x = y AS INT)) FILTER (WHERE x <> 'uncertain' AND y <> 'uncertain'), 9) AS agreement_certain FROM u")
def sta_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.when(F.col(c) == 2, "uncertain").otherwise(F.col(c).cast("string"))
    return _rounded(labels.raw_agreement(_ord(spark, sf_dir).select(name("a").alias("a"), name("b").alias("b")), "a", "b"), ("agreement", "agreement_certain"))


CODE = ("F1", "F2", "F3", "F4")
MULTI = "m AS (SELECT l_orderkey, list_filter(['F1','F2','F3','F4'], lambda c: CASE c WHEN 'F1' THEN l_partkey % 2 = 0 WHEN 'F2' THEN l_partkey % 3 = 0 WHEN 'F3' THEN l_linenumber > 3 ELSE l_quantity > 40 END) AS a, list_filter(['F1','F2','F3','F4'], lambda c: CASE c WHEN 'F1' THEN l_partkey % 2 = 0 WHEN 'F2' THEN l_partkey % 6 = 0 WHEN 'F3' THEN l_linenumber > 2 ELSE l_suppkey % 7 = 0 END) AS b FROM lineitem)"


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    pick = lambda *cs: F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in zip(CODE, cs, strict=True))))
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    return l.select(pick(p % 2 == 0, p % 3 == 0, n > 3, F.col("l_quantity") > 40).alias("a"), pick(p % 2 == 0, p % 6 == 0, n > 2, F.col("l_suppkey") % 7 == 0).alias("b"))


@query("sta_03_multilabel", f"""WITH {MULTI}, c AS (SELECT unnest({list(CODE)}) AS code), g AS (SELECT code, count(*) FILTER (WHERE list_contains(a, code) AND list_contains(b, code)) AS tp, count(*) FILTER (WHERE NOT list_contains(a, code) AND list_contains(b, code)) AS fp, count(*) FILTER (WHERE list_contains(a, code) AND NOT list_contains(b, code)) AS fn, count(*) AS n FROM m CROSS JOIN c GROUP BY 1)
 SELECT code, tp, fp, fn, round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round((n - fp - fn) / n, 9) AS presence_agreement FROM g""")
def sta_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(labels.multilabel_by_code(_multi(spark, sf_dir), "a", "b", CODE), ("precision", "recall", "f1", "presence_agreement"))


@query("sta_03_multilabel_summary", f"""WITH {MULTI}, j AS (SELECT CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS j FROM m), c AS (SELECT unnest({list(CODE)}) AS code), g AS (SELECT code, count(*) FILTER (WHERE list_contains(a, code) AND list_contains(b, code)) AS tp, count(*) FILTER (WHERE NOT list_contains(a, code) AND list_contains(b, code)) AS fp, count(*) FILTER (WHERE list_contains(a, code) AND NOT list_contains(b, code)) AS fn FROM m CROSS JOIN c GROUP BY 1),
 s AS (SELECT 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro, avg(2 * tp / (2 * tp + fp + fn)) AS macro FROM g) SELECT round(avg(j), 8) AS mean_jaccard, round(quantile_cont(j, 0.5), 8) AS median_jaccard, round(avg(CAST(j = 1 AS INT)), 9) AS exact_share, round(any_value(micro), 9) AS micro_f1, round(any_value(macro), 9) AS macro_f1 FROM j CROSS JOIN s""")
def sta_03_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _multi(spark, sf_dir).withColumn("j", audits.jaccard(F.col("a"), F.col("b")))
    a = m.agg(F.round(F.avg("j"), 8).alias("mean_jaccard"), F.round(F.percentile("j", 0.5), 8).alias("median_jaccard"), F.round(F.avg((F.col("j") == 1).cast("int")), 9).alias("exact_share"))
    c = labels.multilabel_by_code(m, "a", "b", CODE)
    b = c.agg(F.round(2 * F.sum("tp") / (2 * F.sum("tp") + F.sum("fp") + F.sum("fn")), 9).alias("micro_f1"), F.round(F.avg("f1"), 9).alias("macro_f1"))
    return a.crossJoin(b)


@query("sta_04_agreement_by_cohort", f"WITH {ORD}, src AS (SELECT cohort, a, b FROM o CROSS JOIN LATERAL (SELECT unnest([CASE WHEN device = 'smart_plug' THEN 'original' ELSE 'new' END, 'combined']) AS cohort) x), {_kappa_sql((1, 2, 3), 'src', 'CAST(a <> b AS DOUBLE)', 'cohort')} SELECT * FROM kp")
def sta_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _ord(spark, sf_dir).withColumn("cohort", F.explode(F.array(F.when(F.col("device") == "smart_plug", "original").otherwise("new"), F.lit("combined"))))
    return _rounded(metrics.kappa(d, "a", "b", (1, 2, 3), None, ["cohort"]), ("agreement", "kappa"))


LAB = """r1 AS (SELECT doc_id, quality AS label FROM labels), r2 AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 1 - quality ELSE quality END AS label FROM labels WHERE doc_id % 5 = 0), ad AS (SELECT doc_id, toxic AS label FROM labels WHERE doc_id % 10 = 0)"""


def _raters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    l = table(spark, sf_dir, "labels")  # noqa: E741
    r1 = l.select("doc_id", F.col("quality").alias("label"))
    r2 = l.where("doc_id % 5 = 0").select("doc_id", F.when(F.col("doc_id") % 10 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("label"))
    return r1, r2, l.where("doc_id % 10 = 0").select("doc_id", F.col("toxic").alias("label"))


@query("lbl_01_final_labels", f"WITH {LAB} SELECT r1.doc_id, CASE WHEN r2.doc_id IS NULL THEN r1.label WHEN r1.label = r2.label THEN r1.label ELSE ad.label END AS final_label, CASE WHEN r2.doc_id IS NULL THEN 'reviewer_1' WHEN r1.label = r2.label THEN 'agreed' WHEN ad.doc_id IS NOT NULL THEN 'adjudicated' ELSE 'open' END AS origin FROM r1 LEFT JOIN r2 ON r1.doc_id = r2.doc_id LEFT JOIN ad ON r1.doc_id = ad.doc_id")
def lbl_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.final_labels(*_raters(spark, sf_dir), "doc_id")


@query("lbl_02_adjudication_needed", f"WITH {LAB} SELECT r1.doc_id, r1.label AS label_1, r2.label AS label_2, r1.label IS NOT DISTINCT FROM r2.label AS agree FROM r1 JOIN r2 ON r1.doc_id = r2.doc_id")
def lbl_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    r1, r2, _ = _raters(spark, sf_dir)
    return labels.double_review(r1, r2, "doc_id")


@query("lbl_03_agreed_must_survive", f"WITH {LAB} SELECT r1.doc_id, r1.label AS agreed, ad.label AS adjudicated FROM r1 JOIN r2 ON r1.doc_id = r2.doc_id AND r1.label = r2.label JOIN (SELECT doc_id, toxic AS label FROM labels) ad ON ad.doc_id = r1.doc_id WHERE ad.label <> r1.label")
def lbl_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    r1, r2, _ = _raters(spark, sf_dir)
    return labels.broken_agreements(r1, r2, table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id")
