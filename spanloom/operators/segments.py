"""Segments: clipping of overlaps, role texts, warnings, metadata ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Valid segments (start, end) with overlaps cut from the later one; covered ones go. Adds ``overlapped``.

    Order is by start and then by ``position``.
    """
    order = Window.partitionBy(*keys).orderBy("start", position).rowsBetween(Window.unboundedPreceding, -1)
    fine = df.where("start >= 0 AND end > start").withColumn("_seen", F.max("end").over(order))
    cut = fine.withColumn("overlapped", F.coalesce(F.col("_seen") > F.col("start"), F.lit(False)))
    return cut.withColumn("start", F.greatest("start", F.coalesce("_seen", F.col("start")))).where("end > start").drop("_seen")


def next_starts(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Adds ``next_start``: the start of the first later item, in item order, that starts behind this one."""
    def folded(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            made = [next_greater(x) for x in batch.column("_starts").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.int64()))], [*batch.schema.names, "_next"])

    # one narrow array a key, in item order; of equal positions the greatest start first, as they are not behind each other
    item = F.struct(F.col(position).alias("p"), (-F.col("start").cast("long")).alias("s"))
    listed = df.where("start IS NOT NULL").groupBy(*keys).agg(F.array_distinct(F.array_sort(F.collect_list(item))).alias("_l"))
    listed = listed.select(*keys, F.transform("_l", lambda x: x["p"]).alias("_at"), F.transform("_l", lambda x: -x["s"]).alias("_starts"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema.fields)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = listed.repartition(n, *keys).mapInArrow(folded, f"{fields}, _next array<long>")
    told = told.select(*keys, F.inline(F.arrays_zip(F.col("_at").alias(position), F.col("_starts").alias("start"), F.col("_next").alias("next_start"))))
    return df.join(told, [*keys, position, "start"], "left").select(*df.columns, "next_start")


def next_greater(starts: list[int]) -> list[int | None]:
    """For each start, the first later one that is greater; none for unresolved ones. One pass with a stack."""
    out: list[int | None] = [None] * len(starts)
    waiting: list[int] = []
    for i, s in enumerate(starts):
        while s is not None and waiting and starts[waiting[-1]] < s:
            out[waiting.pop()] = s
        if s is not None and s >= 0:
            waiting.append(i)
    return out


def warnings(unit: dict[str, Column]) -> Column:
    """A unit's warnings, in their fixed order. ``unit`` has the columns it is judged by."""
    tests = [
        (unit["start"] < 0, "start_unresolved"), (~unit["end_resolved"], "end_unresolved"), (F.coalesce(unit["text"], F.lit("")) == "", "empty_text"),
        (unit["ambiguous"], "ambiguous_quote"), (unit["start_via_fallback"], "resolved_via_prefix_fallback"), (unit["segments_partial"], "segments_partial"),
        (unit["n_segments"] > 1, "multi_span"), (F.size(unit["chunk_ids"]) > 1, "spans_multiple_chunks"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for t, name in tests]))


def source_id(metadata: Column) -> Column:
    """The first non-blank string under req_id or subcategory_id of JSON objects in order; other types don't count."""

    def own(m: Column, key: str) -> Column:
        value = F.try_variant_get(F.try_parse_json(m), f"$.{key}", "variant")
        text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.try_parse_json(m), f"$.{key}", "string"))
        return F.nullif(F.trim(text), F.lit(""))

    ids = F.transform(F.coalesce(metadata, F.array().cast("array<string>")), lambda m: F.coalesce(own(m, "req_id"), own(m, "subcategory_id")))
    return F.get(F.filter(ids, lambda x: x.isNotNull()), F.lit(0))


def source_id_lists(units: DataFrame, keys: list[str], order: str = "k", metadata: str = "metadata") -> DataFrame:
    """Per key, the source ids of its units in order, each as often as it occurs, and the distinct ones sorted."""
    rows = units.withColumn("_id", source_id(F.col(metadata)))
    listed = F.array_sort(F.collect_list(F.when(F.col("_id").isNotNull(), F.struct(F.col(order).alias("o"), F.col("_id").alias("i")))))
    made = rows.groupBy(*keys).agg(F.transform(listed, lambda x: x["i"]).alias("ids_in_order"))
    return made.withColumn("ids", F.sort_array(F.array_distinct("ids_in_order")))


def coverage(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: ids expected and found, those missing and those extra, sorted. Both sides have a column ``id``."""
    a = found.select(*keys, F.trim(F.col("id").cast("string")).alias("id"), F.lit(1).alias("f"))
    b = expected.select(*keys, F.trim(F.col("id").cast("string")).alias("id"), F.lit(1).alias("e"))
    sides = a.distinct().join(b.distinct(), [*keys, "id"], "full")
    listed = lambda on: F.sort_array(F.collect_list(F.when(on, F.col("id"))))
    return sides.groupBy(*keys).agg(
        F.count("e").alias("n_expected"), F.count("f").alias("n_found"), listed(F.col("f").isNull()).alias("missing"), listed(F.col("e").isNull()).alias("extra"),
    )
