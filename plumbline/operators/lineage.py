"""Results that several steps read, kept where every executor can read them."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where that is unset, a temporary one in local mode, as in tests; on a cluster it is refused, since its other machines could not read it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that every executor can reach")
            shared = tempfile.mkdtemp()
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows as written by a checkpoint."""
    folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in that folder: for wide rows of which later steps read some columns and some values.

    The table goes when the driver ends, as nothing of the session can read it after that.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    if not _tables:
        atexit.register(_drop, spark)
    _tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    _delete(df.sparkSession, df._stored_at)
    _tables.remove(df._stored_at)


_tables: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _drop(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have been stopped before
        for path in _tables:
            _delete(spark, path)


def collect_bounded(df: DataFrame, most: int, what: str) -> list[Row]:
    """The rows, for the driver, of a table that is small by its nature; more than ``most`` are refused, never cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows
