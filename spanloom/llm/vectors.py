"""Vectors that can be compared, and their packing into binary blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def comparable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (id, vec) that take part, one for each distinct non-null id.

    Left out are vectors that are null, empty or zero, or that hold null or non-finite
    components; lengths may differ. Of rows that repeat an id, the smallest vector stands.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")).where("id IS NOT NULL AND size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def element_type(df: DataFrame, vector_col: str = "vec") -> str:
    """numpy's name for the components; doubles for all but floats."""
    return "<f4" if df.schema[vector_col].dataType.elementType.simpleString() == "float" else "<f8"


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Rows of equal-length lists, in their own precision."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def sequential_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of matching rows, in double precision, summed from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d].astype(np.float64) * b[:, d].astype(np.float64)
    return total


def by_length(batch: pa.RecordBatch, column: str = "vec") -> Iterator[tuple[int, pa.RecordBatch]]:
    """A batch's rows apart by the length of their vectors."""
    lengths = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        yield int(n), batch if (lengths == n).all() else batch.filter(pa.array(lengths == n))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def blocks_of(size: int, kind: str, wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> Callable:
    """A mapInArrow function that packs rows (id, vec) into rows (dims, ids, vecs) of binary blocks, each of one length."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, part in by_length(batch):
                ids, vecs = part.column("id").to_numpy(), matrix(part.column("vec")).astype(kind)
                if wanted is not None:
                    ids, vecs = ids[wanted(ids)], vecs[wanted(ids)]
                parts = [(dims, ids[i : i + size].tobytes(), vecs[i : i + size].tobytes()) for i in range(0, len(ids), size)]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*parts, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["dims", "ids", "vecs"])

    return packed
