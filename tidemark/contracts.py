"""Schema contracts: checked on the plan, before any data is read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ContractError(ValueError):
    """A DataFrame breaks a schema contract."""


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def forbid(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Refuses columns that would leak identities or the future (compared without case)."""
    found = sorted({c.lower() for c in columns} & {c.lower() for c in df.columns})
    if found:
        raise ContractError(f"forbidden columns: {found}")
    return df


def exact_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Same names, order and types; nullability is not compared."""
    have = [(f.name, f.dataType.simpleString()) for f in df.schema]
    want = [(f.name, f.dataType.simpleString()) for f in schema]
    if have != want:
        raise ContractError(f"schema is {have}, not {want}")
    return df


def namespaces(df: DataFrame, keys: Iterable[str], features: str = "feature_", targets: str = "target_", managed: Iterable[str] = ()) -> dict[str, list[str]]:
    """Sorts the columns into keys, features, targets and managed ones; a column of no group is refused."""
    keys, managed = list(keys), list(managed)
    out: dict[str, list[str]] = {"keys": [], "features": [], "targets": [], "managed": []}
    for c in df.columns:
        group = "keys" if c in keys else "managed" if c in managed else "features" if c.startswith(features) else "targets" if c.startswith(targets) else None
        if group is None:
            raise ContractError(f"column of no namespace: {c}")
        out[group].append(c)
    return out


def bounds_check(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """A row per column: values below, above, not a number and null, and whether all is well; one pass over df."""
    aggs: list[Column] = []
    for c, (lo, hi) in bounds.items():
        x = F.col(c).cast("double")
        aggs += [F.count_if(x < lo).alias(f"{c}|low"), F.count_if((x > hi) & ~F.isnan(x)).alias(f"{c}|high"), F.count_if(F.isnan(x)).alias(f"{c}|nan"), F.count_if(x.isNull()).alias(f"{c}|null")]
    row = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column"), *(F.col(f"`{c}|{k}`").alias(f"n_{k}") for k in ("low", "high", "nan", "null"))) for c in bounds]
    out = row.select(F.explode(F.array(*items)).alias("x")).select("x.*")
    return out.withColumn("passed", F.col("n_low") + F.col("n_high") + F.col("n_nan") + F.col("n_null") == 0)
