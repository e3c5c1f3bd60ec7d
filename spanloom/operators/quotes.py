"""Search for quotes in normalized text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import find
from spanloom.operators.occurrences import Occurrences

def find_shortened(quotes: DataFrame, texts: DataFrame, keys: list[str], from_front: bool = False) -> DataFrame:
    """Position and length of the longest shortened quote that occurs, if it occurs just once; else -1 and 0.

    ``quotes`` has doc_id, ``keys`` and quote, ``texts`` doc_id and norm; returns doc_id, ``keys``, at and chars.
    Words are dropped from the end, or from the front; the longest that occurs at all decides. A document's
    quotes meet its text once, however many there are, and the text is indexed once.
    """

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, wanted in zip(batch.column("norm").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                index = Occurrences(text)
                hits = (index.shortened(q or "", 0, len(text)) if not from_front else index.shortened(q or "", 0, len(text), True) for q in wanted)
                found.append([{"at": h[0], "chars": h[1] - h[0]} if h else {"at": -1, "chars": 0} for h in hits])
            hit = pa.array(found, pa.list_(pa.struct([("at", pa.int64()), ("chars", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("told"), hit], ["doc_id", "told", "hit"])

    per = quotes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*keys, "quote"))).alias("q")).join(texts, "doc_id")
    rows = per.select("doc_id", "norm", F.transform("q", lambda x: x["quote"]).alias("wanted"), F.transform("q", lambda x: F.struct(*[x[k].alias(k) for k in keys])).alias("told"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("doc_id", "told")}
    made = rows.repartition(int(quotes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    made = made.mapInArrow(searched, f"doc_id {kinds['doc_id']}, told {kinds['told']}, hit array<struct<at:bigint,chars:int>>")
    return made.select("doc_id", F.inline(F.arrays_zip("told", "hit"))).select("doc_id", *[f"told.{k}" for k in keys], "hit.at", "hit.chars")


def ordered_starts(text: Column, quotes: Column) -> Column:
    """Positions of quotes searched one after another, each from just behind the last hit; -1 for a miss."""
    zero = F.struct(F.array().cast("array<long>").alias("at"), F.lit(0).cast("long").alias("since"))

    def step(a: Column, quote: Column) -> Column:
        at = find(text, quote, a["since"])
        return F.struct(F.concat(a["at"], F.array(at)).alias("at"), F.when(at >= 0, at + 1).otherwise(a["since"]).cast("long").alias("since"))

    return F.aggregate(quotes, zero, step)["at"]
