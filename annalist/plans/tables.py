"""Table access for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, whether one file or a folder of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt_out(rows: DataFrame, *by: str, n: int, per_task: int = 1 << 19) -> DataFrame:
    """``rows`` dealt out by ``by`` into as many parts as ``n`` rows ask for, so that a task's share is the same at any size."""
    return rows.repartition(max(1, -(-n // per_task)), *by)
