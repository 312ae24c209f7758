"""Manifests, package checks, releases and appends."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import require


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A row per table: rows, columns, and a fingerprint that does not depend on the order of rows."""
    def one(name: str, df: DataFrame) -> DataFrame:
        h = F.xxhash64(*sorted(df.columns))
        return df.agg(F.count("*").alias("n_rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum")).select(F.lit(name).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "hash_sum")

    return reduce(DataFrame.unionByName, (one(n, d) for n, d in tables.items()))


def data_dictionary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A row per column, from the schemas alone."""
    rows = [(n, i, f.name, f.dataType.simpleString(), f.nullable) for n, d in tables.items() for i, f in enumerate(d.schema)]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table string, position int, column string, type string, nullable boolean")


def checks(violations: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """A row per check: it passes if its frame of violations is empty."""
    def one(name: str, df: DataFrame, what: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), (F.col("n") == 0).alias("passed"), F.concat_ws(" ", F.col("n").cast("string"), F.lit(what)).alias("detail"))

    return reduce(DataFrame.unionByName, (one(n, d, w) for n, (d, w) in violations.items()))


def release(df: DataFrame, private: Sequence[str]) -> DataFrame:
    require(df, private)
    return df.drop(*private)


def append(base: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """base and the rows of new whose key it does not have; base stays as it is, columns must be the same."""
    if base.columns != new.columns:
        raise ValueError("columns differ")
    return base.unionByName(new.join(base.select(*key), list(key), "left_anti").dropDuplicates(list(key)))
