"""Tables between stages, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one that the context has.

    Where neither is set, a temporary folder serves a session whose executors are this machine's threads; on a cluster it
    is an error, since executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    Ends the lineage, survives lost executors, and makes what is not repeatable in df the same for all that use it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete a table made by cut() that no later plan reads."""
    drop_cuts_of(df.sparkSession, df.inputFiles()[:1])


def drop_cuts_of(spark: SparkSession, files: list[str]) -> None:
    """Delete the tables made by cut() that the files belong to; other files stay."""
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in files}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("cut-"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
