"""Nearest neighbours by inner product: a block matrix join of int8 tiles, verified in double precision."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import complete_groups, partitions, written
from spanloom.llm.vectors import blocks_of, comparable, element_type, rows_of, sequential_dot

K = 20
#: Vectors of a block, queries of a group, candidates of a group, and groups of candidates that a larger table has at first.
BLOCK, QUERY_GROUP, CANDIDATE_GROUP, GROUPS = 1024, 16384, 8192, 64
#: Components whose int8 products float32 sums exactly (127 * 127 * 1024 < 2**24), queries compared at once, and pairs recomputed at once.
EXACT, ROWS, PAIRS = 1024, 2048, 1 << 16


class Quantised:
    """int8 rows with a scale each, and the norms that bound the error of their products."""

    def __init__(self, vecs: np.ndarray):
        exact = vecs.astype(np.float64)
        self.scale = np.maximum(np.abs(exact).max(axis=1), 1e-300) / 127
        codes = np.rint(exact / self.scale[:, None])
        self.codes = codes.astype(np.int8)
        back = codes * self.scale[:, None]
        self.norm, self.back, self.error = (self._length(x) for x in (exact, back, exact - back))

    @staticmethod
    def _length(rows: np.ndarray) -> np.ndarray:
        """Lengths of rows, without squares that are too large or too small for a double."""
        most = np.abs(rows).max(axis=1)
        return most * np.linalg.norm(rows / np.maximum(most, 5e-324)[:, None], axis=1)

    def tile(self, rows: slice, other: Quantised) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of inner products of some rows with another block's; none where a double can't hold them."""
        mine, whole = self.codes[rows], np.zeros((0, 0))
        for d in range(0, mine.shape[1], EXACT):  # integers below 2**24 are exact in float32, their sums in float64
            part = mine[:, d : d + EXACT].astype(np.float32) @ other.codes[:, d : d + EXACT].T.astype(np.float32)
            whole = whole + part if d else part.astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            near = whole * self.scale[rows, None] * other.scale[None, :]
            off = self.norm[rows, None] * other.error[None, :] + self.error[rows, None] * other.back[None, :]
            off = off + 1e-9 * self.norm[rows, None] * other.norm[None, :] + 1e-300
            low, high = near - off, near + off
        return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best, by descending score and then by id."""
    order = np.lexsort((ids, -score, query))
    first = np.r_[True, query[order][1:] != query[order][:-1]]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return order[rank < k]


def _searched(batches: Iterator[pa.RecordBatch], kind: str, k: int) -> Iterator[pa.RecordBatch]:
    """Each cell: its queries' blocks come first, then candidate blocks stream by, one held at a time."""
    cell, queries, state = None, [], None

    def opened() -> dict:
        ids = np.concatenate([x for x, _ in queries])
        vecs = np.concatenate([v for _, v in queries])
        none = np.zeros(0, dtype=np.int64)
        return {"ids": ids, "vecs": vecs, "low": Quantised(vecs), "at": none, "near": none, "score": np.zeros(0), "floor": np.full(len(ids), -np.inf)}

    def found(s: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(s["ids"][s["at"]]), pa.array(s["near"]), pa.array(s["score"])], ["query_id", "vec_id", "score"])

    for row in rows_of(batches):
        if (row["dims"], row["cell"]) != cell:
            if state is not None:
                yield found(state)
            cell, queries, state = (row["dims"], row["cell"]), [], None
        block = (np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["vecs"], dtype=kind).reshape(-1, row["dims"]))
        if row["side"] == 0:
            queries.append(block)
            continue
        if not queries:
            continue
        state = state or opened()
        ids, vecs = block
        their, pairs = Quantised(vecs), []
        for first in range(0, len(state["ids"]), ROWS):
            rows = slice(first, min(first + ROWS, len(state["ids"])))
            low, high = state["low"].tile(rows, their)
            own = state["ids"][rows, None] == ids[None, :]
            low = np.where(own, -np.inf, low)
            if len(ids) > k:
                state["floor"][rows] = np.maximum(state["floor"][rows], np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k])
            at, c = np.nonzero((high >= state["floor"][rows, None]) & ~own)
            for a in range(0, len(at), PAIRS):
                some, few = at[a : a + PAIRS] + first, c[a : a + PAIRS]
                score = sequential_dot(state["vecs"][some], vecs[few])
                best = _best(some, ids[few], score, k)
                pairs.append((some[best], ids[few][best], score[best]))
        if not pairs:
            continue
        at, near, score = (np.concatenate([state[name], *x]) for name, x in zip(("at", "near", "score"), zip(*pairs, strict=True), strict=True))
        keep = _best(at, near, score, k)
        state["at"], state["near"], state["score"] = at[keep], near[keep], score[keep]
        full = np.bincount(state["at"], minlength=len(state["ids"])) >= k
        least = np.full(len(full), np.inf)
        np.minimum.at(least, state["at"], state["score"])
        state["floor"] = np.where(full, np.maximum(state["floor"], least), state["floor"])
    if state is not None:
        yield found(state)


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A bounded heap a query over the lists of its cells."""
    for table, bound in complete_groups(batches, "query_id"):
        query, vec, score = (table.column(c).to_numpy() for c in ("query_id", "vec_id", "score"))
        keep, rank = [], []
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            best = heapq.nsmallest(k, range(a, b), key=lambda i: (-score[i], vec[i]))
            keep += best
            rank += range(1, len(best) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(query[keep]), pa.array(rank, pa.int32()), pa.array(vec[keep]), pa.array(score[keep])], ["query_id", "rank", "vec_id", "score"])


def nearest(df: DataFrame, every: int = 20, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` candidates with the largest inner product with each query, nearest first.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows
    but the query's own whose vectors are as long as the query's. Returns query_id, rank (from 1), vec_id and score (the inner
    product of the original vectors in double precision). Ties go to the smaller
    vec_id. A query with fewer candidates has them all; exact, nothing is missed.

    Vectors that are null, empty, zero or hold null or non-finite components take no part; nor do null ids. Of rows that repeat an id
    the smallest vector stands. An empty table gives no rows. Other columns don't matter.

    Blocks of queries meet blocks of candidates in a grid of cells, one for each length. In a cell, int8
    products with error bounds give each pair's range; pairs whose upper end reaches
    the query's k-th lower end are recomputed exactly. A cell emits k rows a query,
    and a query's cells grow with the square root of the table beyond 64, so the merge
    stays small; no task holds more than its queries and one block of candidates.
    """
    spark = df.sparkSession
    rows = written(comparable(df, id_col, vector_col), "vectors")
    groups = lambda n, of: F.greatest(F.lit(1), F.ceil(n / of)).cast("long")
    whole = groups(F.count(F.lit(1)), CANDIDATE_GROUP)
    across = F.least(whole, F.greatest(F.lit(GROUPS), F.ceil(F.sqrt(whole)))).cast("long")
    asked = groups(F.count_if(F.col("id") % every == 0), QUERY_GROUP)
    sizes = rows.groupBy(F.size("vec").alias("dims")).agg(across.alias("across"), asked.alias("down"))
    sizes = F.broadcast(written(sizes, "lengths"))  # a row for each length
    n_cells = sizes.agg(F.coalesce(F.sum(F.col("across") * F.col("down")), F.lit(1))).first()[0]
    kind = element_type(rows)
    fields = "dims int, ids binary, vecs binary"
    packed = rows.mapInArrow(blocks_of(BLOCK, kind), fields).join(sizes, "dims")
    queries = rows.where(F.col("id") % every == 0).mapInArrow(blocks_of(BLOCK, kind), fields).join(sizes, "dims")
    spread = lambda of: F.pmod(F.xxhash64("ids"), of)
    left = queries.withColumn("g", spread("down")).select("dims", F.explode(F.expr("sequence(g * across, g * across + across - 1)")).alias("cell"), F.lit(0).alias("side"), "ids", "vecs")
    right = packed.withColumn("g", spread("across")).select("dims", F.explode(F.expr("sequence(g, g + across * (down - 1), across)")).alias("cell"), F.lit(1).alias("side"), "ids", "vecs")
    cells = left.unionByName(right).repartition(min(partitions(spark), n_cells), "dims", "cell").sortWithinPartitions("dims", "cell", "side")
    lists = cells.mapInArrow(lambda batches: _searched(batches, kind, k), "query_id long, vec_id long, score double")
    by_query = lists.repartition(partitions(spark), "query_id").sortWithinPartitions("query_id")
    return by_query.mapInArrow(lambda batches: _merged(batches, k), "query_id long, rank int, vec_id long, score double")


def op8(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings to every one whose id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
