"""Folders of files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.job_state import shared_folder


def list_files(spark: SparkSession, path: str, hashed: bool = False) -> DataFrame:
    """(path, bytes, mtime) of the files at path (a folder, file or pattern), with sha256 only if asked for: without it no
    content is read. Paths are as Spark names them, with a scheme. With it a file is read whole by one task,
    so this is for files of at most 2 GB, the limit of a binary value."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    columns = ["path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime")]
    return rows.select(*columns, *([F.sha2("content", 256).alias("sha256")] if hashed else []))


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: what several branches of a plan read is computed once."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
