"""Contiguous shards of nearly equal byte size, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import partitions, written

#: Partitions whose totals one task sums; the sums of these runs are summed again.
RUN = 1000


def with_prefix(df: DataFrame, order: list[str], totals: dict[str, str]) -> DataFrame:
    """Global exclusive prefix sums of columns, in partition order and then by ``order``.

    ``df`` has a column ``_p``: partitions that are ordered among themselves.
    ``totals`` maps new names to the columns to sum. A task sorts one partition;
    totals of partitions are summed in runs, so no task reads all of them.
    """
    before = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumns({f"_in_{k}": F.coalesce(F.sum(c).over(before), F.lit(0)) for k, c in totals.items()})
    per = df.groupBy("_p").agg(*[F.sum(c).alias(k) for k, c in totals.items()]).withColumn("_g", F.expr(f"_p div {RUN}"))
    run = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    inside = per.select("_p", "_g", *[F.coalesce(F.sum(k).over(run), F.lit(0)).alias(f"_run_{k}") for k in totals])
    all_runs = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    runs = per.groupBy("_g").agg(*[F.sum(k).alias(k) for k in totals])
    runs = runs.select("_g", *[F.coalesce(F.sum(k).over(all_runs), F.lit(0)).alias(f"_all_{k}") for k in totals])
    base = inside.join(runs, "_g").select("_p", *[(F.col(f"_run_{k}") + F.col(f"_all_{k}")).alias(f"_base_{k}") for k in totals])
    summed = local.join(base, "_p").withColumns({k: F.col(f"_in_{k}") + F.col(f"_base_{k}") for k in totals})
    return summed.select(*df.columns, *totals)


def shard_by_bytes(df: DataFrame, size: Column, shards: int, order: list[str], keep: list[Column]) -> DataFrame:
    """Cut the rows, ordered by ``order``, into ``shards`` contiguous runs of nearly equal total size.

    Returns ``keep``, then size, shard (from 0) and slot (gapless from 0 in its shard).
    A row belongs to the shard that holds its middle byte, so a shard's size misses
    the mean by at most one row's size at either end.

    The kept columns are dealt by range once and written; only they are sorted,
    never a text that is not kept. Rows with an equal key are told apart by their
    place in the input, so a key with many rows spreads over partitions; rows equal
    in all kept columns are interchangeable. Nulls in the order come first. A null
    size counts as 0; negative sizes are not allowed. If all sizes are 0, all rows
    go to shard 0; an empty table gives no rows. ``keep`` must hold the columns of
    ``order`` and no column named size, shard or slot; names starting with ``_`` are taken.
    """
    spark = df.sparkSession
    rows = df.select(*keep, F.coalesce(size, F.lit(0)).cast("long").alias("size"), F.monotonically_increasing_id().alias("_at"))
    dealt = rows.repartitionByRange(partitions(spark), *order, "size", "_at").withColumns({"_p": F.spark_partition_id(), "_one": F.lit(1).cast("long")})
    dealt = written(dealt, "dealt")
    placed = with_prefix(dealt, [*order, "size", "_at"], {"_start": "size", "_row": "_one"})
    total = dealt.agg(F.sum("size")).first()[0] or 0
    middle = ((2 * F.col("_start") + F.col("size")) * F.lit(shards)).cast("long")
    cut = F.least(F.lit(shards - 1), F.expr(f"_middle div {2 * total}L")) if total else F.lit(0)
    placed = placed.withColumn("_middle", middle).withColumn("shard", cut.cast("int"))
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # as many rows as shards
    out = placed.join(F.broadcast(first), "shard")
    return out.select(*[c for c in dealt.columns if c[0] != "_"], "shard", (F.col("_row") - F.col("_first")).cast("long").alias("slot"))


def op5(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 contiguous shards of nearly equal bytes (law ``bytes``), in order of doc_id.

    A null text counts as empty. Equal texts stay apart where their ids do: the law
    balances bytes, and one group of copies may be larger than a shard.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 8
    made = shard_by_bytes(docs, size, 24, ["doc_id", "text_crc32"], [F.col("doc_id"), F.crc32(text).alias("text_crc32")])
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP5_SQL = """
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (
  SELECT doc_id, n + 8 AS size,
         xor(list_reduce(list_transform(range(1, n + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32
  FROM d, t),
p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, sum(size) OVER ()::BIGINT AS total FROM s),
c AS (SELECT *, least(23, (2 * start + size) * 24 // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY start) - 1 AS slot, NULL::INT AS grown_shard FROM c
"""
