"""Extensions: the append and the monthly aggregates as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(stream: DataFrame, key: Sequence[str], time: str, delay: str) -> DataFrame:
    """The first row of each key, remembered as long as rows may be late."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def windowed_counts(stream: DataFrame, time: str, window: str, delay: str, keys: Sequence[str]) -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"))


def append_batches(stream: DataFrame, path: str, checkpoint: str, key: Sequence[str]) -> StreamingQuery:
    """Appends each micro-batch's new keys to a Parquet table; a batch that runs again adds nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(list(key))
        files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*.parquet")
        # a write that was cut off leaves only its temporary folder
        if files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(files):
            # only the keys of the table are read, with the batch's schema
            new = new.join(spark.read.schema(batch.schema).parquet(path).select(*key), list(key), "left_anti")
        new.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
