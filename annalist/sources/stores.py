"""Vector caches in .npy files and bookkeeping tables in SQLite files, as DataFrames."""

from __future__ import annotations

import io
import sqlite3
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def binary_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Whole files below ``path``: ``path``, ``content``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")


def parse_npy(files: DataFrame) -> DataFrame:
    """Rows of the matrices in .npy files (``path``, ``content``): ``path``, ``row``, ``v``. Pickled objects are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                m = np.atleast_2d(np.load(io.BytesIO(content.as_py()), allow_pickle=False)).astype(float)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(m), pa.string()), pa.array(np.arange(len(m))), rows], ["path", "row", "v"])

    return files.select("path", "content").mapInArrow(run, "path string, row long, v array<double>")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """All .npy files below ``path``, see :func:`parse_npy`."""
    return parse_npy(binary_files(spark, path, "*.npy"))


def parse_sqlite(files: DataFrame, table: str, schema: str) -> DataFrame:
    """Rows of a table in SQLite files (``path``, ``content``): ``path`` and the columns of ``schema``; columns that a file's
    table lacks are null, a file without the table has no rows."""
    kinds = StructType.fromDDL(f"path string, {schema}")
    arrow, names = to_arrow_schema(kinds), kinds.names[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                db = sqlite3.connect(":memory:")
                db.deserialize(content.as_py())
                held = [r[1] for r in db.execute(f'PRAGMA table_info("{table}")')]
                if not held:
                    continue
                rows = db.execute(f'SELECT {", ".join(f"{chr(34)}{n}{chr(34)}" if n in held else "NULL" for n in names)} FROM "{table}"')
                while part := rows.fetchmany(10_000):
                    yield pa.RecordBatch.from_pylist([{"path": path.as_py(), **dict(zip(names, r, strict=True))} for r in part], arrow)
                db.close()

    return files.select("path", "content").mapInArrow(run, kinds)


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, pattern: str = "*.db") -> DataFrame:
    """A table of all SQLite files below ``path``, see :func:`parse_sqlite`."""
    return parse_sqlite(binary_files(spark, path, pattern), table, schema)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their key, others added."""
    return old.join(new.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti").unionByName(new)
