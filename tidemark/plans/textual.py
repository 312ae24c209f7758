"""Text, hash, date, array and JSON functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, hashing, text
from ..operators import audits, languages
from ..sources.batches import spread
from .facts import REVIEWS_SQL, reviews, table
from .registry import query

CLEAN = "trim(regexp_replace(regexp_replace({c}, '</?[A-Za-z][^>]*>', ' ', 'g'), '[\\s\\p{Z}\\x0B\\x{85}]+', ' ', 'g'))"


def _clean_sql(c: str) -> str:
    x = c
    for k, v in text.ENTITIES.items():
        x = "replace({}, '{}', '{}')".format(x, k, v.replace("'", "''"))
    return CLEAN.replace("{c}", x)


@query("str_01_clean_text_simple", f"SELECT page_id, md5({_clean_sql('html')}) AS clean_md5, CAST(length({_clean_sql('html')}) AS INT) AS n FROM pages")
def str_01s(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.clean_text_simple(F.col("html"))
    return spread(table(spark, sf_dir, "pages")).select("page_id", F.md5(c.cast("binary")).alias("clean_md5"), F.length(c).alias("n"))


@query("str_01_clean_text")
def str_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages")).withColumn("c", text.clean_text(F.col("html"))).select("page_id", "c.*")


@query("str_02_normalize_dedup")
def str_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", text.normalize_for_dedup(F.col("text")).alias("normalized"))


LOW = "trim(regexp_replace(lower({c}), '[\\s\\p{Z}\\x0B\\x{85}]+', ' ', 'g'))"


@query("str_05_normalize_simple", f"SELECT doc_id, md5({LOW.replace('{c}', 'text')}) AS text_md5 FROM documents")
def str_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.md5(text.normalize_simple(F.col("text")).cast("binary")).alias("text_md5"))


@query("str_03_normalize_rule", "SELECT p_partkey, trim(regexp_replace(replace(lower(p_name || ' & ' || p_type), '&', ' and '), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS name FROM part")
def str_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_rule(F.concat_ws(" & ", "p_name", "p_type")).alias("name"))


@query("str_04_normalize_protocol", "SELECT p_partkey, trim(regexp_replace(replace(replace(replace(replace(lower('Wi-Fi ' || p_name || ' Z wave'), 'wi-fi', 'wifi'), 'wi fi', 'wifi'), 'z-wave', 'zwave'), 'z wave', 'zwave'), '[^a-z0-9]+', ' ', 'g')) AS name FROM part")
def str_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_protocol(F.concat(F.lit("Wi-Fi "), F.col("p_name"), F.lit(" Z wave"))).alias("name"))


TERMS = ("the", "and the", "of", "that", "with", "de la")


@query("str_06_matching_terms", f"SELECT doc_id, list_sort(list_filter({list(TERMS)}, lambda t: contains(' ' || {LOW.replace('{c}', 'text')} || ' ', ' ' || t || ' '))) AS terms FROM documents")
def str_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.array_sort(text.matching_terms(text.normalize_simple(F.col("text")), TERMS)).alias("terms"))


@query("str_08_within_tokens", """WITH w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS t, generate_subscripts(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), 1) AS i FROM documents),
 h AS (SELECT DISTINCT a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND abs(a.i - b.i) <= 2 WHERE a.t IN ('that') AND b.t IN ('with', 'from')) SELECT d.doc_id, h.doc_id IS NOT NULL AS near FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id""")
def str_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", text.within_tokens(text.normalize_protocol(F.col("text")), ["that"], ["with", "from"], 2).alias("near"))


@query("str_09_truncate", f"SELECT doc_id, CASE WHEN length(t) <= 60 THEN t ELSE substr(t, 1, 59) || '…' END AS short FROM (SELECT doc_id, {LOW.replace('{c}', 'text').replace('lower(text)', 'text')} AS t FROM documents)")
def str_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", text.truncate(F.col("text"), 60).alias("short"))


@query("str_09_snippet")
def str_09s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", text.snippet(F.col("text"), ["idiot", "licensed"], 90).alias("snippet"))


@query("str_10_flatten_json")
def str_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.flatten_json(F.col("props")).alias("flat"))


RULES = {"F1": ["idiot", "moron"], "F2": [r"\bscum\b", "worthless"], "F3": ["licensed under", "http"]}
KW = f"lower({LOW.replace('{c}', 'text')})"


@query("str_11_keyword_codes", f"""WITH t AS (SELECT doc_id, {LOW.replace('{c}', 'text')} AS t FROM documents), c AS (SELECT doc_id, t, list_filter([CASE WHEN regexp_matches(t, 'idiot|moron') THEN 'F1' END, CASE WHEN regexp_matches(t, '\\bscum\\b|worthless') THEN 'F2' END, CASE WHEN regexp_matches(t, 'licensed under|http') THEN 'F3' END], lambda x: x IS NOT NULL) AS c FROM t)
 SELECT doc_id, CASE WHEN t = '' THEN '' WHEN len(c) > 0 THEN array_to_string(c, ';') WHEN regexp_matches(t, '\\bthat\\b') AND regexp_matches(t, '\\bwith\\b') AND NOT regexp_matches(t, '\\bfrom\\b') THEN 'F1' ELSE '' END AS codes FROM c""")
def str_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = text.keyword_codes(text.normalize_simple(F.col("text")), RULES, [r"\bthat\b"], [r"\bwith\b"], [r"\bfrom\b"])
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.array_join(codes, ";").alias("codes"))


@query("str_12_star_header", "SELECT conv_id, turn, md5(regexp_replace(CASE WHEN turn % 2 = 0 THEN 'One Star' || chr(10) ELSE 'I gave one star ' END || text, '^\\s*(?i:one|two|three|four|five)\\s+(?i:stars?)\\s*(?:[.!:;\\-–—]+\\s*)?(?:(?:\\r?\\n)+|$)', '')) AS text_md5 FROM conversations")
def str_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.concat(F.when(F.col("turn") % 2 == 0, "One Star\n").otherwise("I gave one star "), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.strip_star_header(c).cast("binary")).alias("text_md5"))


@query("str_13_join_nonempty", "SELECT conv_id, turn, md5(concat_ws(chr(10) || chr(10), nullif(trim(CASE WHEN role = 'user' THEN role ELSE ' ' END), ''), nullif(trim(text), ''))) AS text_md5 FROM conversations")
def str_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.join_nonempty(F.when(F.col("role") == "user", F.col("role")).otherwise(" "), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(c.cast("binary")).alias("text_md5"))


@query("str_14_language_gate", "SELECT doc_id, CASE WHEN length(text) < 12 OR length(regexp_replace(text, '[^\\p{L}]', '', 'g')) < 10 THEN 'undetermined_short' WHEN lang IS NULL THEN 'undetermined_other' WHEN lang = 'en' AND (doc_id % 10) / 10.0 >= 0.7 THEN 'English' ELSE 'non-English' END AS status FROM documents")
def str_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", text.language_gate(F.col("text"), F.col("lang"), (F.col("doc_id") % 10) / 10.0).alias("status"))


@query("str_14_language_detection")
def str_14_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang")
    found = languages.detect(d, "doc_id", "text", languages.fit_profiles(d, "text", "lang"))
    return found.select("doc_id", text.language_gate(F.col("text"), F.col("detected"), F.col("confidence")).alias("status"), "detected", F.round("confidence", 6).alias("confidence"))


@query("str_07_word_boundary", "SELECT p_partkey, array_to_string(list_filter(['blue ring', 'bolt', 'red'], lambda t: regexp_matches(lower(p_name), '(^|[^a-z0-9])' || t || '($|[^a-z0-9])')), ';') AS terms FROM part")
def str_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.word_boundary_terms(text.normalize_protocol(F.col("p_name")), ["bolt", "red", "blue ring"]), ";").alias("terms"))


@query("str_15_pii_scan")
def str_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = {k: F.regexp_like("text", F.lit(p)) for k, p in text.PII_PATTERNS.items()}
    any_ = F.lit(False)
    for h in hits.values():
        any_ = any_ | h
    return spread(table(spark, sf_dir, "documents")).agg(F.count("*").alias("n"), *(F.count_if(h).alias(f"n_{k}") for k, h in hits.items()), F.count_if(any_).alias("n_any"))


@query("str_16_label_codes", """WITH c AS (SELECT o_orderkey, ['N0','F1','F2','F3','F4','F5','F6','F7','F8'] AS legal, list_filter(regexp_split_to_array(upper('f' || (o_orderkey % 8 + 1) || ' ;F' || (o_custkey % 9) || CASE WHEN o_orderkey % 3 = 0 THEN '/n0' ELSE '' END), '[;,|/\\s]+'), lambda x: x <> '') AS have FROM orders)
 SELECT o_orderkey, CASE WHEN len(list_filter(have, lambda x: NOT list_contains(legal, x))) = 0 THEN array_to_string(list_filter(legal, lambda x: list_contains(have, x)), ';') END AS codes FROM c""")
def str_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("f"), (F.col("o_orderkey") % 8 + 1).cast("string"), F.lit(" ;F"), (F.col("o_custkey") % 9).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "/n0").otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.normalize_codes(raw).alias("codes"))


VIOL = """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate, CASE l_orderkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN 'uncertain' ELSE 'x' END AS b, CASE l_partkey % 3 WHEN 0 THEN 'N0' WHEN 1 THEN 'F1;F2' ELSE '' END AS c, CASE WHEN l_suppkey % 5 < 4 THEN l_suppkey % 5 END AS s, CASE WHEN l_linenumber % 4 < 3 THEN l_linenumber % 4 END AS p FROM lineitem)"""


@query("str_17_label_legality", VIOL + """, v AS (SELECT CASE WHEN b NOT IN ('0', '1', 'uncertain') THEN 'illegal_binary' WHEN b = '0' AND NOT (c = 'N0' AND s IS NOT DISTINCT FROM 0 AND p IS NOT DISTINCT FROM 0) THEN 'non_failure_must_be_blank' WHEN b = '1' AND (c = '' OR contains(c, 'N0')) THEN 'failure_needs_codes'
 WHEN b = '1' AND NOT coalesce(s BETWEEN 1 AND 3 AND p BETWEEN 0 AND 2, false) THEN 'failure_incomplete' WHEN b = 'uncertain' AND (c <> '' OR s IS NOT NULL OR p IS NOT NULL) THEN 'uncertain_must_be_blank' END AS violation FROM l) SELECT violation, count(*) AS n FROM v GROUP BY 1""")
def str_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_orderkey") % 4
    b = F.when(k == 0, "0").when(k == 1, "1").when(k == 2, "uncertain").otherwise("x")
    c = F.when(F.col("l_partkey") % 3 == 0, "N0").when(F.col("l_partkey") % 3 == 1, "F1;F2").otherwise("")
    s, p = F.when(F.col("l_suppkey") % 5 < 4, F.col("l_suppkey") % 5), F.when(F.col("l_linenumber") % 4 < 3, F.col("l_linenumber") % 4)
    return table(spark, sf_dir, "lineitem").groupBy(text.label_violation(b, c, s, p).alias("violation")).agg(F.count("*").alias("n"))


@query("str_18_slug", "SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS slug FROM pages")
def str_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages")).select("page_id", text.slug(F.col("url")).alias("slug"))


SALT = bytes([0x11] * 32)


@query("hsh_01_hmac")
def hsh_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", hashing.hmac_sha256(SALT, F.col("user_id").cast("string")).alias("user_hash"))


def _part(x: str) -> str:
    return f"length({x}) || ':' || {x}"


@query("hsh_02_duplicate_key", f"SELECT sha256({' || '.join(map(_part, ['CAST(l_orderkey AS VARCHAR)', 'CAST(l_partkey AS VARCHAR)', 'CAST(l_linenumber AS VARCHAR)', 'CAST(CAST(l_quantity AS INT) AS VARCHAR)', 'l_returnflag']))}) AS duplicate_key, count(*) AS n FROM lineitem GROUP BY 1")
def hsh_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = hashing.duplicate_key(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").groupBy(k.alias("duplicate_key")).agg(F.count("*").alias("n"))


@query("hsh_03_fingerprint", "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || ',\"note\":null}') AS fingerprint FROM nation")
def hsh_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").withColumn("note", F.lit(None).cast("string")).select("n_nationkey", hashing.fingerprint(["n_regionkey", "n_name", "note"]).alias("fingerprint"))


@query("hsh_04_rows_fingerprint")
def hsh_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashing.rows_fingerprint(table(spark, sf_dir, "orders"))


@query("dt_01_epoch_millis", """WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(epoch_us(ts) // 1000 AS VARCHAR) WHEN 1 THEN CAST(epoch_us(ts) // 1000 AS VARCHAR) || '.5' WHEN 2 THEN '-1' WHEN 3 THEN CAST(epoch_us(ts) // 1000 AS VARCHAR) END AS raw FROM events), m AS (SELECT event_id, CASE WHEN regexp_full_match(raw, '[0-9]{1,18}') THEN CAST(raw AS BIGINT) END AS ms FROM r)
 SELECT event_id, ms, strftime(make_timestamp_ms(ms), '%Y-%m-%dT%H:%M:%S') AS utc, CAST(date_trunc('month', make_timestamp_ms(ms)) AS DATE) AS review_month FROM m""")
def dt_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    k = F.col("event_id") % 5
    raw = F.when(k == 0, ms).when(k == 1, F.concat(ms, F.lit(".5"))).when(k == 2, "-1").when(k == 3, ms)
    e = table(spark, sf_dir, "events").select("event_id", dates.epoch_millis(raw).alias("ms"))
    ts, month = dates.timestamp_fields(F.col("ms"))
    return e.select("event_id", "ms", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("utc"), month.alias("review_month"))


@query("dt_02_months", f"WITH {REVIEWS_SQL} SELECT DISTINCT review_month, m, CAST(review_month + INTERVAL 3 MONTH AS DATE) AS three_on FROM reviews")
def dt_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = reviews(spark, sf_dir).select("m").distinct()
    return d.select(dates.month_of_index(F.col("m")).alias("review_month"), "m", F.add_months(dates.month_of_index(F.col("m")), 3).alias("three_on"))


@query("dt_03_span", "SELECT strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last FROM events")
def dt_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return table(spark, sf_dir, "events").agg(F.date_format(F.min("ts"), iso).alias("first"), F.date_format(F.max("ts"), iso).alias("last"))


@query("mth_06_uncertainty", f"WITH {REVIEWS_SQL} SELECT order_id, line_no, part, ts, round(abs(fp - 0.5), 7) AS uncertainty, (rating <= 2) <> (pers >= 1) AS disagreement FROM reviews")
def mth_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).select("order_id", "line_no", "part", "ts", F.round(F.abs(F.col("fp") - 0.5), 7).alias("uncertainty"), ((F.col("rating") <= 2) != (F.col("pers") >= 1)).alias("disagreement"))


@query("arr_01_sorted_union", "WITH p AS (SELECT l_orderkey, unnest([l_returnflag, l_linestatus]) AS x FROM lineitem) SELECT l_orderkey, list_sort(list(DISTINCT x)) AS flags FROM p GROUP BY 1")
def arr_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").withColumn("a", F.array("l_returnflag", "l_linestatus"))  # noqa: E741
    return l.groupBy("l_orderkey").agg(audits.sorted_union("a").alias("flags"))


@query("arr_02_jaccard", "SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS jaccard, list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS same FROM (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(p_type || ' ' || p_name), ' ') AS b FROM part)")
def arr_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(audits.jaccard(a, b), 9).alias("jaccard"), (F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))).alias("same"))
