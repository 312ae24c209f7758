"""Batch-wise access to a DataFrame's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as the session has cores, for work that costs more than moving the rows.

    Small inputs come as one split; an input that has as many splits already stays as it is.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def map_batches(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f over Arrow batches of rows, partition by partition; f must not depend on where batches are cut."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield f(pdf)

    return df.mapInPandas(run, schema)
