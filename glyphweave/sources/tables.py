"""Tables that are written between the passes of a plan: what is computed once is read afterwards."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Without the setting a temporary folder stands in, on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(spark, "_text_tables"):
        spark._text_tables = "file://" + tempfile.mkdtemp(prefix="glyphweave-text-")
    return spark._text_tables


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again; its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
