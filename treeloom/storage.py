"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only where that is unset and the session is
    local, as in tests, one is made; it goes with the process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="treeloom-")
        atexit.register(shutil.rmtree, made, True)
        found = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's own folder."""
    folder = f"{shared_dir(spark)}/treeloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(folder)
    return f"{folder}/{name}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost
    executors and gives later joins true sizes."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a path, whatever store it is in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard_all(spark: SparkSession) -> None:
    """Remove every intermediate table of this application; results that are not
    written elsewhere yet can no longer be read."""
    discard(spark, f"{shared_dir(spark)}/treeloom/{spark.sparkContext.applicationId}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are removed at the end; what is to stay must be
    written inside, to a path made before."""
    _made.append([])
    try:
        yield
    finally:
        for folder in _made.pop():
            discard(spark, folder)
