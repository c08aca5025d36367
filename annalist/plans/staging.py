"""Written intermediate tables.

A staged table cuts lineage the way a reliable checkpoint does: it is a Parquet folder below ``spark.checkpoint.dir``,
which all executors share, so a lost executor costs a re-read and never a recomputation from the source. Where that setting
is absent a local session (unit tests, notebooks) uses a temporary folder; on a cluster, whose executors would not see it,
staging is refused.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: ``spark.checkpoint.dir`` of the session, else, if it is local, one temporary folder of this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named.rstrip('/')}/annalist"
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError(f"on {master} staged tables need a shared folder: set spark.checkpoint.dir")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="annalist-"))
        atexit.register(shutil.rmtree, _fallback[0], ignore_errors=True)
    return f"file://{_fallback[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path below :func:`shared_dir` that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(staged: DataFrame) -> None:
    """Delete what :func:`stage` wrote, through Hadoop's file system API; for tables that no later result reads."""
    spark = staged.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(staged._staged_at)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
