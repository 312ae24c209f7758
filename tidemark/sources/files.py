"""Small files on the driver (TOML, workbooks, checksums) and readers and writers with checks."""

from __future__ import annotations

import hashlib
import re
import tomllib
import zipfile
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def load_toml(path: str | Path) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)


def file_sha256(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, nothing inferred; empty fields are empty strings; a byte-order mark is skipped."""
    df = spark.read.option("header", True).option("inferSchema", False).option("emptyValue", "").option("nullValue", "\u0000").option("multiLine", True).csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns)).na.fill("")


def read_workbook(path: str | Path, sheet: str) -> list[dict[str, object]]:
    """Rows of a worksheet of an .xlsx file, by the header row: strings, booleans, whole numbers and floats."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

    def text(e: ElementTree.Element) -> str:
        return "".join(t.text or "" for t in e.iter(f"{{{ns['m']}}}t"))

    with zipfile.ZipFile(path) as z:
        tree = lambda name: ElementTree.fromstring(z.read(name))
        shared = [text(e) for e in tree("xl/sharedStrings.xml").findall("m:si", ns)] if "xl/sharedStrings.xml" in z.namelist() else []
        ids = {s.get("name"): s.get(rel) for s in tree("xl/workbook.xml").iter(f"{{{ns['m']}}}sheet")}
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        if sheet not in ids:
            raise KeyError(f"no worksheet {sheet}")
        target = targets[ids[sheet]]
        data = tree(target.lstrip("/") if target.startswith("/") else f"xl/{target}")

    def value(c: ElementTree.Element) -> object:
        kind, v = c.get("t"), c.find("m:v", ns)
        if kind == "inlineStr":
            return text(c)
        if v is None or v.text is None:
            return None
        if kind == "s":
            return shared[int(v.text)]
        if kind == "b":
            return v.text == "1"
        if kind in ("str", "e"):
            return v.text
        x = float(v.text)
        return int(x) if x.is_integer() else x

    def column(ref: str) -> int:
        n = 0
        for ch in re.match("[A-Z]+", ref)[0]:
            n = n * 26 + ord(ch) - 64
        return n - 1

    rows = [{column(c.get("r")): value(c) for c in r.findall("m:c", ns)} for r in data.iter(f"{{{ns['m']}}}row")]
    if not rows:
        return []
    header = {k: str(v) for k, v in rows[0].items() if v is not None}
    return [{name: r.get(k) for k, name in header.items()} for r in rows[1:] if any(v is not None for v in r.values())]


def write_parquet(df: DataFrame, path: str, schema: StructType | None = None, row_group_bytes: int | None = None) -> DataFrame:
    """Writes zstd Parquet to a path that must not exist, and reads it back; returns what was read.

    Spark's commit protocol makes the files appear together; counts and schema are compared after reading.
    """
    if schema is not None:
        df = df.to(schema)
    w = df.write.mode("errorifexists").option("compression", "zstd")
    (w.option("parquet.block.size", row_group_bytes) if row_group_bytes else w).parquet(path)
    back = df.sparkSession.read.parquet(path)
    if [(f.name, f.dataType) for f in back.schema] != [(f.name, f.dataType) for f in df.schema]:
        raise ValueError(f"{path}: schema differs after reading back")
    return back


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).option("emptyValue", "").csv(path)


def combine(parts: list[DataFrame], schema: StructType) -> DataFrame:
    """Parts of differing column order and types as one frame of the schema."""
    out = parts[0].to(schema)
    for p in parts[1:]:
        out = out.unionByName(p.to(schema))
    return out


def readback(written: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: rows written, wanted, and how many of each the other lacks."""
    a = written.agg(F.count("*").alias("n_written")).crossJoin(wanted.agg(F.count("*").alias("n_wanted")))
    b = written.exceptAll(wanted).agg(F.count("*").alias("n_extra")).crossJoin(wanted.exceptAll(written).agg(F.count("*").alias("n_lost")))
    return a.crossJoin(b)
