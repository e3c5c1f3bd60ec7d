"""Stages written to shared storage, so that a retry never repeats a paid call."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, in local mode alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return root or f"{tempfile.gettempdir()}/checkpoints"


def partitions(spark: SparkSession) -> int:
    """Tasks of a stage whose work isn't told by its bytes, so that they are not merged by size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_remove_all)
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that its path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_all() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have gone first
            return


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a stage's rows as Parquet in shared storage and read them back.

    This cuts the lineage: a lost executor costs no more than the running stage, and later
    plans prune columns and push filters down.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """How many scratch folders there are, for ``release``."""
    return len(_made)


def release(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Delete the scratch folders made after the first ``since`` ones, but for the last ``keep``, which hold what they led to."""
    for made in _made[since : len(_made) - keep]:
        _made.remove(made)
        remove(spark, made[1])


@contextmanager
def released(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder that is gone behind the block: what is read from it must be stored elsewhere inside."""
    try:
        yield path
    finally:
        remove(spark, path)
