"""Tables in the shared folder of the cluster; they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; a fresh local one only where that is unset and all runs in one process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _OWN.setdefault(app, "") or _OWN.update({app: "file://" + tempfile.mkdtemp(prefix="docbatch-")}) or _OWN[app]
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/docbatch/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
