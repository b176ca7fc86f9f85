"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under spark.checkpoint.dir, gone when the application ends. Without that setting a single-machine session uses
    its temporary folder and any other raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = f"file://{tempfile.gettempdir()}/roadloom-shared"
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, so that a lost executor costs one step at most."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
