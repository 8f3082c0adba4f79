"""Tables that a run keeps: written once to the folder that all executors share, so that a lost executor loses nothing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that are still there, those of each open ``scratch`` apart.
_paths: list[dict[str, SparkSession]] = [{}]


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only a local session without that setting, as in tests, gets a temporary folder."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="glyphsieve-")
        sc.setCheckpointDir(where)
    return where


def kept(df: DataFrame) -> DataFrame:
    """The same rows, from a table in the shared folder; lineage ends there. The table is deleted when ``scratch`` or the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    _paths[-1][path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(paths: dict[str, SparkSession]) -> None:
    for path, spark in paths.items():
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001, PERF203  # the session is over; what is left belongs to the folder's owner
            pass
    paths.clear()


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes the tables kept inside when it is left. What comes out of it must be kept outside, or again."""
    _paths.append({})
    try:
        yield
    finally:
        _delete(_paths.pop())


def outside(df: DataFrame) -> DataFrame:
    """``kept`` in a table that outlives the innermost ``scratch``."""
    inner = _paths.pop()
    try:
        return kept(df)
    finally:
        _paths.append(inner)


@atexit.register
def _at_end() -> None:
    for paths in _paths:
        _delete(paths)
