"""Input tables and the shared scratch folder of the queries."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from habitus import session
from habitus.session import bounded_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors see.

    Only a local session may go without that setting.
    """
    base = re.sub("^file:/+", "file:///", session.shared_folder(spark))
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends there."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
