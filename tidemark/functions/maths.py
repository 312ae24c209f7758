"""Scores: composite indices, cumulative probabilities, signals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: weights of failure, severity and persistence in the composite index
INDEX_WEIGHTS = {"main": (0.50, 0.25, 0.25), "equal": (1 / 3, 1 / 3, 1 / 3), "emphasis": (0.60, 0.20, 0.20)}
NEGATIVE_SENTIMENT = -0.05


def clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def monotone(ps: Sequence[Column]) -> list[Column]:
    """Cumulative probabilities P(y>=k), each at most the one before."""
    out = [ps[0]]
    for p in ps[1:]:
        out.append(F.least(p, out[-1]))
    return out


def expected_value(ps: Sequence[Column], base: int = 0) -> Column:
    return reduce(lambda a, b: a + b, ps, F.lit(float(base)))


def hard_class(ps: Sequence[Column], base: int = 0, threshold: float = 0.5) -> Column:
    return reduce(lambda a, b: a + b, [(p >= threshold).cast("int") for p in ps], F.lit(base))


def composite_index(failure: Column, severity2: Column, severity3: Column, persistence: Column) -> dict[str, Column]:
    """Five variants of an index in [0, 1]: failure times a weighted mean of 1, severity and persistence given failure.

    severity2 and severity3 are P(severity >= 2) and P(severity >= 3); persistence is its expected value, 0 to 2.
    """
    f, s, s3, p = clip(failure), clip(severity2), clip(severity3), clip(persistence / 2.0)
    full = clip((s + s3) / 2.0)
    mixed = lambda kind, sev: f * (INDEX_WEIGHTS[kind][0] + INDEX_WEIGHTS[kind][1] * sev + INDEX_WEIGHTS[kind][2] * p)
    return {"index_main": mixed("main", s), "index_failure_only": f, "index_equal": mixed("equal", s), "index_emphasis": mixed("emphasis", s), "index_full_severity": mixed("main", full)}


def negative_sentiment(compound: Column) -> Column:
    return (compound <= NEGATIVE_SENTIMENT).cast("int")


def mapped(c: Column, values: Mapping[str, str]) -> Column:
    """The value that a dictionary has for c; a row with another key, or none, is an error."""
    known = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.when(c.isin(*values), F.element_at(known, c)).otherwise(F.raise_error(F.concat(F.lit("no value for "), F.coalesce(c, F.lit("null")))))
