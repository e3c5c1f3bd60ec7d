"""Scratch tables in shared storage, complete key groups, and connected components."""

from __future__ import annotations

import atexit
import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.plans.storage import partitions, release, remove, scratch_mark, scratch_path, shared_folder, stored

__all__ = ["bucketed", "complete_groups", "connected_components", "lean", "partitions", "release", "remove", "scratch_mark", "scratch_path", "settings", "shared_folder", "stored", "written"]

_tables: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """A stage's rows, stored in the shared folder and read back."""
    return stored(df, name, "zstd")


def _drop_all() -> None:
    for spark, name in _tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # noqa: BLE001  the JVM may have gone first
            return


def bucketed(df: DataFrame, name: str, n: int, by: str) -> DataFrame:
    """Write rows that are dealt by hash of ``by`` into ``n`` partitions as as many buckets, and read them back.

    Joins and groupings on ``by`` find the rows where they lie, without a shuffle. The table is external, below
    the shared folder; its catalogue entry goes, too, when the driver ends.
    """
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(_drop_all)
    _tables.append((spark, table))
    df.write.format("parquet").bucketBy(n, by).option("path", path).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Plan what is written inside under other settings (``spark.sql.`` and the name); they go back behind it."""
    names = {f"spark.sql.{k}": v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep_words: bool = False) -> Callable:
    """A mapInArrow function whose worker gives freed memory back to the system when its task ends.

    Workers outlive their tasks and idle beside the JVM stages that follow. One that
    turns from tokenizing to other work also forgets the words it remembers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep_words and (tokens := sys.modules.get("spanloom.llm.tokens")):
            tokens.word_tokenizer.cache_clear()
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # other C libraries have no such call
                pass

    return run


def complete_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold only whole groups of the sorted integer column ``key``.

    Yields each table with the positions where its groups start, ending with the
    row count. At most one group and one batch are held at a time.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys == keys[-1], True))
        if last:
            yield _grouped([*held, batch.slice(0, last)], key)
            held = [batch.slice(last)]
        elif held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield _grouped(held, key)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield _grouped(held, key)


def _grouped(parts: list[pa.RecordBatch], key: str) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(parts).combine_chunks()
    keys = table.column(key).to_numpy()
    return table, np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id of every node that has an edge: columns ``node`` and ``component``.

    Alternates large-star and small-star rewiring until the edges form stars, so
    rounds grow with the logarithm of a component's width. Every round is a
    map-side combined minimum and one join, written to shared storage; nothing
    but a row count and a checksum reaches the driver. Null ends and loops are
    ignored.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if (digest := _digest(now)) == seen:
            break
        seen = digest
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _digest(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(hashed), F.sum(F.col("v") % 1000003)).first())
