"""Schemaless JSON lines: counts, type profiles, timestamp audits and comparisons of sources.

Lines are parsed once into VARIANT values, so types are those in the file and nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): the raw lines of text files, also compressed ones."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with v (VARIANT, null if the line is blank or broken) and kind: empty, error, object or non_object."""
    v = F.try_parse_json(F.col(line))
    blank = F.trim(F.coalesce(F.col(line), F.lit(""))) == ""
    d = lines.withColumn("v", F.when(~blank, v))
    kind = F.when(blank, "empty").when(F.col("v").isNull(), "error").when(json_type(F.schema_of_variant("v")) == "object", "object").otherwise("non_object")
    return d.withColumn("kind", kind)


def json_type(schema: Column) -> Column:
    """null, boolean, integer, number, string, array or object, from schema_of_variant()."""
    return F.when(schema.like("OBJECT%"), "object").when(schema.like("ARRAY%"), "array").when(schema == "VOID", "null").when(schema == "BOOLEAN", "boolean").when(schema == "STRING", "string").when(schema == "BIGINT", "integer").when(schema.like("DECIMAL(%,0)"), "integer").otherwise("number")


def scan_counts(lines: DataFrame) -> DataFrame:
    p = parsed(lines)
    return p.agg(F.count("*").alias("physical"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("empty", "error", "object", "non_object")))


def error_lines(lines: DataFrame, key: str) -> DataFrame:
    """Every broken line: key, line_no and byte_offset in the order of key, length, start and category.

    The offset counts a line feed after each line before it.
    """
    from ..operators.targets import ranked

    placed = ranked(lines, [key], "line_no", {"byte_offset": F.octet_length(F.coalesce("line", F.lit(""))) + 1})
    bad = parsed(placed).where("kind = 'error'")
    text = F.trim("line")
    category = F.when(text.startswith("{") & ~text.endswith("}"), "unclosed_object").when(text.startswith("{"), "malformed_object").when(text.startswith("["), "malformed_array").otherwise("malformed_value")
    return bad.select(key, "line_no", "byte_offset", F.length("line").alias("length"), F.substring("line", 1, 80).alias("start"), category.alias("category"))


def fields(lines: DataFrame, key: str) -> DataFrame:
    """(key, field, type, text, place): a row per field of each object, place from 0 in it."""
    objects = parsed(lines).where("kind = 'object'").select(key, "v")
    spark = lines.sparkSession
    d = spark.sql(f"SELECT d.{key}, e.pos AS place, e.key AS field, schema_of_variant(e.value) AS s, try_variant_get(e.value, '$', 'string') AS text FROM {{d}} d, LATERAL variant_explode_outer(d.v) e", d=objects)
    return d.select(key, "field", json_type(F.col("s")).alias("type"), "text", F.coalesce("place", F.lit(0)).alias("place"))


def field_profile(lines: DataFrame, key: str) -> DataFrame:
    """Per field: occurrences, types, nulls, empty strings, and how many objects in effect lack it."""
    # lines are parsed once: an object is counted by its first field (an empty one by its row without a field)
    spark = lines.sparkSession
    objects = parsed(lines).where("kind = 'object'").select("v")
    f = spark.sql("SELECT e.key AS field, e.pos AS place, schema_of_variant(e.value) AS s, try_variant_get(e.value, '$', 'string') = '' AS blank FROM {d} d, LATERAL variant_explode_outer(d.v) e", d=objects)
    # few schemas occur, so types are named after counting
    by = f.groupBy("field", "s").agg(F.count("*").alias("n"), F.count_if(F.coalesce("place", F.lit(0)) == 0).alias("firsts"), F.count_if("blank").alias("blank"))
    by = by.withColumn("type", json_type(F.col("s")))
    kinds = ("null", "boolean", "integer", "number", "string", "array", "object")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("type") == k, F.col("n"))), F.lit(0))
    g = by.groupBy("field").agg(F.sum("n").alias("present"), *(of(k).alias(f"n_{k}") for k in kinds), F.coalesce(F.sum(F.when(F.col("type") == "string", F.col("blank"))), F.lit(0)).alias("n_empty"), F.sum("firsts").alias("firsts"))
    # one row a field: a table as wide as the records
    g = g.withColumn("objects", F.sum("firsts").over(Window.partitionBy())).drop("firsts").where("field IS NOT NULL")
    missing = F.col("objects") - F.col("present") + F.col("n_null") + F.col("n_empty")
    return g.withColumn("effective_missing", missing).withColumn("missing_rate", missing / F.col("objects"))


def field_counts(lines: DataFrame) -> DataFrame:
    p = parsed(lines).where("kind = 'object'").select(F.size(F.json_object_keys("line")).alias("n"))
    return p.agg(F.min("n").alias("min_fields"), F.max("n").alias("max_fields"), F.avg("n").alias("mean_fields"))


def timestamp_audit(lines: DataFrame, key: str, field: str) -> DataFrame:
    """Presence, magnitude classes and the unit of a numeric timestamp: confirmed only if every value >= 0 is in ms."""
    n = parsed(lines).agg(F.count_if(F.col("kind") == "object").alias("objects"))
    f = fields(lines, key).where(F.col("field") == field)  # a second pass, over one field
    x = F.when(F.col("type").isin("integer", "number"), F.expr("try_cast(text AS double)"))
    cls = F.when(x < 0, "negative").when((x >= 1e8) & (x < 1e11), "seconds").when((x >= 1e11) & (x < 1e14), "milliseconds").when((x >= 1e14) & (x < 1e17), "microseconds").when(x.isNotNull(), "other")
    g = f.withColumn("x", x).withColumn("c", cls).agg(F.count("*").alias("present"), F.count_if(F.col("type") == "null").alias("n_null"), F.count("x").alias("numeric"), *(F.count_if(F.col("c") == k).alias(k) for k in ("negative", "seconds", "milliseconds", "microseconds", "other")), F.min("x").alias("lo"), F.max("x").alias("hi"))
    sure = (F.col("numeric") - F.col("negative") > 0) & (F.col("milliseconds") == F.col("numeric") - F.col("negative"))
    utc = lambda c: F.when(sure, F.date_format(F.timestamp_millis(F.col(c).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss"))
    d = g.crossJoin(F.broadcast(n))
    return d.select((F.col("objects") - F.col("present")).alias("missing"), "present", "n_null", (F.col("present") - F.col("n_null") - F.col("numeric")).alias("non_numeric"), "numeric", "negative", "seconds", "milliseconds", "microseconds", "other", F.when(sure, "CONFIRMED_MILLISECONDS").otherwise("TIMESTAMP_UNIT_UNCERTAIN").alias("unit_status"), utc("lo").alias("min_utc"), utc("hi").alias("max_utc"))


def compare_profiles(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per field of two profiles: shared or of one side only, whether the types differ, and both missing rates."""
    kinds = [c for c in left.columns if c.startswith("n_") and c not in ("n_empty",)]
    types = lambda p: F.concat_ws(",", *(F.when(F.col(f"{p}.{c}") > 0, c[2:]) for c in kinds))
    j = left.alias("l").join(right.alias("r"), "field", "full")
    side = F.when(F.col("r.present").isNull(), "only_left").when(F.col("l.present").isNull(), "only_right").otherwise("shared")
    return j.select("field", side.alias("side"), types("l").alias("left_types"), types("r").alias("right_types"), (types("l") != types("r")).alias("types_differ"), F.col("l.missing_rate").alias("left_missing"), F.col("r.missing_rate").alias("right_missing"))


def position_sample(lines: DataFrame, key: str, n: int) -> DataFrame:
    """The first n, middle n and last n lines by key."""
    from ..operators.targets import ranked

    d = ranked(lines, [key])
    total = lines.agg(F.count("*").alias("total"))
    mid = F.floor((F.col("total") - n) / 2)
    where = F.when(F.col("place") <= n, "start").when(F.col("place") > F.col("total") - n, "end").when((F.col("place") > mid) & (F.col("place") <= mid + n), "middle")
    return d.crossJoin(F.broadcast(total)).withColumn("position", where).where("position IS NOT NULL").drop("total")
