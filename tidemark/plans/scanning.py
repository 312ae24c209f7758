"""JSON-lines scans and profiles, readers and writers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts
from ..sources import files, jsonl
from ..sources.batches import spread
from ..storage import shared_folder
from .facts import table
from .registry import query

LINES = """lines AS (SELECT event_id, CASE WHEN event_id % 101 = 0 THEN '' WHEN event_id % 97 = 0 THEN '{bad' WHEN event_id % 89 = 0 THEN '[1, 2]' ELSE
 '{"id": ' || event_id || ', "type": "' || event_type || '", "n": ' || CASE WHEN event_id % 5 = 0 THEN 'null' WHEN event_id % 7 = 0 THEN '1.5' ELSE '3' END || CASE WHEN event_id % 3 = 0 THEN ', "tags": ["a", "b"]' ELSE '' END || ', "ok": ' || CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END || ', "note": "' || CASE WHEN event_id % 4 = 0 THEN '' ELSE 'x' END || '", "ts": ' || (epoch_us(ts) // 1000) || ', "props": ' || props || '}' END AS line FROM events)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    s = lambda x: F.lit(x)
    obj = F.concat(s('{"id": '), e.cast("string"), s(', "type": "'), F.col("event_type"), s('", "n": '), F.when(e % 5 == 0, "null").when(e % 7 == 0, "1.5").otherwise("3"), F.when(e % 3 == 0, ', "tags": ["a", "b"]').otherwise(""), s(', "ok": '), F.when(F.col("user_id") % 2 == 0, "true").otherwise("false"), s(', "note": "'), F.when(e % 4 == 0, "").otherwise("x"), s('", "ts": '), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), s(', "props": '), F.col("props"), s("}"))
    # dealt out as finished lines, so that no reader of them makes a line again for each of its uses
    return spread(table(spark, sf_dir, "events").select("event_id", F.when(e % 101 == 0, "").when(e % 97 == 0, "{bad").when(e % 89 == 0, "[1, 2]").otherwise(obj).alias("line")))


KIND = LINES + ", k AS (SELECT *, CASE WHEN line = '' THEN 'empty' WHEN NOT json_valid(line) THEN 'error' WHEN json_type(line) = 'OBJECT' THEN 'object' ELSE 'non_object' END AS kind FROM lines)"


@query("src_01_scan_counts", f"WITH {KIND} SELECT count(*) AS physical, {', '.join(f'count(*) FILTER (WHERE kind = {chr(39)}{k}{chr(39)}) AS {k}' for k in ('empty', 'error', 'object', 'non_object'))} FROM k")
def src_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.scan_counts(_lines(spark, sf_dir))


@query("src_02_error_lines", f"WITH {KIND}, o AS (SELECT *, row_number() OVER (ORDER BY event_id) AS line_no, CAST(coalesce(sum(octet_length(encode(line)) + 1) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM k) SELECT event_id, line_no, byte_offset, CAST(length(line) AS INT) AS length, substr(line, 1, 80) AS start, CASE WHEN line LIKE '{{%' AND line NOT LIKE '%}}' THEN 'unclosed_object' WHEN line LIKE '{{%' THEN 'malformed_object' ELSE 'malformed_value' END AS category FROM o WHERE kind = 'error'")
def src_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.error_lines(_lines(spark, sf_dir), "event_id")


@query("src_03_position_sample", f"WITH {LINES}, r AS (SELECT *, row_number() OVER (ORDER BY event_id) AS p, count(*) OVER () AS t FROM lines), q AS (SELECT *, CASE WHEN p <= 25 THEN 'start' WHEN p > t - 25 THEN 'end' WHEN p > (t - 25) // 2 AND p <= (t - 25) // 2 + 25 THEN 'middle' END AS position FROM r) SELECT event_id, line, position, p AS place FROM q WHERE position IS NOT NULL")
def src_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.position_sample(_lines(spark, sf_dir), "event_id", 25).select("event_id", "line", "position", "place")


FIELDS = KIND + """, f AS (SELECT event_id, field, CASE json_type(line, '$.' || field) WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' ELSE 'object' END AS type, json_extract_string(line, '$.' || field) AS text FROM (SELECT event_id, line, unnest(json_keys(line)) AS field FROM k WHERE kind = 'object'))"""
TYPES = ("null", "boolean", "integer", "number", "string", "array", "object")
PROFILE = FIELDS + f""", n AS (SELECT count(*) AS objects FROM k WHERE kind = 'object'), pr AS (SELECT field, count(*) AS present, {', '.join(f"count(*) FILTER (WHERE type = '{t}') AS n_{t}" for t in TYPES)}, count(*) FILTER (WHERE type = 'string' AND text = '') AS n_empty FROM f GROUP BY 1),
 prof AS (SELECT pr.*, objects, objects - present + n_null + n_empty AS effective_missing, round((objects - present + n_null + n_empty) / objects, 9) AS missing_rate FROM pr CROSS JOIN n)"""


@query("jsn_01_type_tags", f"WITH {FIELDS} SELECT field, type, count(*) AS n FROM f GROUP BY 1, 2")
def jsn_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.fields(_lines(spark, sf_dir), "event_id").groupBy("field", "type").agg(F.count("*").alias("n"))


@query("agg_17_field_profile", f"WITH {PROFILE} SELECT * FROM prof")
def agg_17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.field_profile(_lines(spark, sf_dir), "event_id").withColumn("missing_rate", F.round("missing_rate", 9))


@query("agg_18_field_counts", f"WITH {KIND} SELECT CAST(min(len(json_keys(line))) AS INT) AS min_fields, CAST(max(len(json_keys(line))) AS INT) AS max_fields, round(avg(len(json_keys(line))), 9) AS mean_fields FROM k WHERE kind = 'object'")
def agg_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.field_counts(_lines(spark, sf_dir)).withColumn("mean_fields", F.round("mean_fields", 9))


@query("agg_19_timestamp_audit", f"WITH {FIELDS}, n AS (SELECT count(*) AS objects FROM k WHERE kind = 'object'), x AS (SELECT type, CASE WHEN type IN ('integer', 'number') THEN CAST(text AS DOUBLE) END AS x FROM f WHERE field = 'ts'), g AS (SELECT count(*) AS present, count(*) FILTER (WHERE type = 'null') AS n_null, count(x) AS \"numeric\", count(*) FILTER (WHERE x < 0) AS negative, count(*) FILTER (WHERE x >= 1e8 AND x < 1e11) AS seconds, count(*) FILTER (WHERE x >= 1e11 AND x < 1e14) AS milliseconds, count(*) FILTER (WHERE x >= 1e14 AND x < 1e17) AS microseconds, count(*) FILTER (WHERE x >= 0 AND x < 1e8 OR x >= 1e17) AS other, min(x) AS lo, max(x) AS hi FROM x) SELECT objects - present AS missing, present, n_null, present - n_null - \"numeric\" AS non_numeric, \"numeric\", negative, seconds, milliseconds, microseconds, other, 'CONFIRMED_MILLISECONDS' AS unit_status, strftime(make_timestamp_ms(CAST(lo AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS min_utc, strftime(make_timestamp_ms(CAST(hi AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS max_utc FROM g CROSS JOIN n")
def agg_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.timestamp_audit(_lines(spark, sf_dir), "event_id", "ts")


@query("agg_20_schema_comparison")
def agg_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    one = jsonl.field_profile(lines.where("event_id % 2 = 0"), "event_id")
    two = jsonl.field_profile(lines.where("event_id % 2 <> 0 OR event_id IS NULL").withColumn("line", F.replace("line", F.lit('"note"'), F.lit('"remark"'))), "event_id")
    return jsonl.compare_profiles(one, two)


@query("jsn_02_stringify", "SELECT s_suppkey, '{\"a\":null,\"nation\":' || s_nationkey || ',\"supplier\":\"' || s_name || '\"}' AS js, s_nationkey = 0 AS empty FROM supplier")
def jsn_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(None).cast("string").alias("a"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("supplier"))
    js = F.to_json(F.struct("a", "nation", "supplier"), {"ignoreNullFields": "false"})
    part = F.when(F.col("nation") == 0, "[]").otherwise(F.to_json(F.array("nation")))
    return s.select("s_suppkey", js.alias("js"), part.isin("null", "[]", "{}", "").alias("empty"))


def _out(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("snk_01_parquet_sink", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def snk_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    back = files.write_parquet(o, _out(spark, "orders"), o.schema)
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("snk_04_combine_chunks", "SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus FROM orders")
def snk_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderstatus")
    parts = [o.where(F.col("o_orderkey") % 3 == k) for k in range(3)]
    parts[1] = parts[1].select("o_orderstatus", F.col("o_custkey").cast("int").alias("o_custkey"), "o_orderkey")
    return files.combine(parts, o.schema)


@query("snk_05_csv_round_trip", "SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'a, \"b\"' END AS note FROM (SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey_s, s_suppkey, s_name FROM supplier)")
def snk_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _out(spark, "csv")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 4 == 0, "").otherwise('a, "b"').alias("note"))
    s.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return back.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.coalesce("note", F.lit("")).alias("note"))


@query("snk_06_readback", "SELECT count(*) AS n_written, count(*) AS n_wanted, CAST(0 AS BIGINT) AS n_extra, CAST(0 AS BIGINT) AS n_lost FROM customer")
def snk_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return files.readback(files.write_parquet(c, _out(spark, "customer")), c)


def _local(name: str) -> str:
    """A path in a folder of the driver's own, for files that are small and read on the driver alone."""
    return f"{tempfile.mkdtemp(prefix='tidemark-')}/{name}"


def _workbook(rows: list[tuple]) -> str:
    """An .xlsx file with one worksheet: shared strings, whole numbers, fractions, booleans and empty cells."""
    names = sorted({x for r in rows for x in r if isinstance(x, str)})

    def cell(ref: str, x: object) -> str:
        if x is None:
            return ""
        kind, v = (' t="s"', names.index(x)) if isinstance(x, str) else (' t="b"', int(x)) if isinstance(x, bool) else ("", x)
        return f'<c r="{ref}"{kind}><v>{v}</v></c>'

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = "".join(f'<row r="{i}">' + "".join(cell(f"{chr(65 + k)}{i}", x) for k, x in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    path = _local("book.xlsx")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{office}"><sheets><sheet name="suppliers" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{x}</t></si>" for x in names) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return path


@query("src_08_workbook", "SELECT n_nationkey AS id, n_name AS name, n_nationkey % 2 = 0 AS even, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey + 0.5 END AS half FROM nation")
def src_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect()  # a worksheet is a driver's file
    rows = [("id", "name", "even", "half"), *((r[0], r[1], r[0] % 2 == 0, r[0] + 0.5 if r[0] % 3 else None) for r in n)]
    got = files.read_workbook(_workbook(rows), "suppliers")
    return spark.createDataFrame([(r["id"], r["name"], r["even"], r["half"]) for r in got], "id long, name string, even boolean, half double")


@query("src_09_csv_strings", "SELECT CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN 'NA' ELSE '007' END AS code FROM supplier")
def src_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    path = _out(spark, "csv")
    head = F.lit(chr(0xFEFF))  # a byte-order mark before the header
    s = table(spark, sf_dir, "supplier").select(k.cast("string").alias("key"), F.when(k % 3 == 0, "").when(k % 3 == 1, "NA").otherwise("007").alias("code"))
    lines = s.select(F.concat_ws(",", "key", "code").alias("value"))
    header = spark.range(1).select(F.concat(head, F.lit("key,code")).alias("value"))
    header.unionByName(lines).coalesce(1).write.text(path)  # one file, as a CSV from elsewhere is
    return files.read_csv(spark, path)


@query("src_10_toml_rules", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'bolt') THEN 'smart_plug' WHEN contains(lower(p_name), 'ring') THEN 'smart_bulb' END AS kind FROM part")
def src_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _local("rules.toml")
    Path(path).write_text('[devices.smart_plug]\nterms = ["bolt"]\n[devices.smart_bulb]\nterms = ["ring"]\n', encoding="utf-8")
    rules = files.load_toml(path)["devices"]
    kind = F.coalesce(*(F.when(F.contains(F.lower("p_name"), F.lit(t)), k) for k, r in rules.items() for t in r["terms"]))
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


@query("snk_02_atomic_write", "SELECT n_regionkey, count(*) AS n, false AS overwritten FROM nation GROUP BY 1")
def snk_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _out(spark, "nation")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    back = files.write_parquet(n, path)
    try:
        files.write_parquet(n.limit(1), path)  # a path that exists is refused
        overwritten = True
    except AnalysisException:
        overwritten = False
    return back.groupBy("n_regionkey").agg(F.count("*").alias("n")).withColumn("overwritten", F.lit(overwritten))


@query("snk_03_copy_query", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY 1, 2")
def snk_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _out(spark, "copied")
    rows = spark.sql("SELECT l_returnflag, l_linestatus, l_quantity FROM {l} ORDER BY l_returnflag", l=table(spark, sf_dir, "lineitem"))
    back = files.write_parquet(rows, path, row_group_bytes=8 << 20)
    return back.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


@query("prj_07_schema_contract", "SELECT * FROM (VALUES ('exact', true), ('other_order', false), ('other_type', false), ('forbidden', false)) AS t(contract, kept)")
def prj_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    tries = {"exact": lambda: contracts.exact_schema(n, n.schema), "other_order": lambda: contracts.exact_schema(n.select("n_name", "n_nationkey"), n.schema), "other_type": lambda: contracts.exact_schema(n.withColumn("n_nationkey", F.col("n_nationkey").cast("string")), n.schema), "forbidden": lambda: contracts.forbid(n, ["N_NAME"])}
    out = []
    for name, check in tries.items():
        try:
            check()
            out.append((name, True))
        except contracts.ContractError:
            out.append((name, False))
    return spark.createDataFrame(out, "contract string, kept boolean")
