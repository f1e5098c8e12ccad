"""Files of folders as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def discover_files(spark: SparkSession, folder: str, suffix: str = ".pdf", deep: bool = True) -> DataFrame:
    """path, size and modified of the files of a suffix, of any case, below a folder or directly in it; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(deep).lower()).load(folder)
    return found.where(F.lower("path").endswith(suffix.lower())).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
