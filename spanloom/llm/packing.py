"""Packing of token sequences by non-negative least squares on their length histogram."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import lean, written
from spanloom.llm.sharding import with_prefix
from spanloom.llm.tokens import word_tokenizer

WINDOW, END, PARTS = 2048, 1, 3
#: Lengths are planned in units of so many tokens, rounded up.
UNIT = 16
#: Pieces of at most window / SHORT tokens are planned by the token, in bundles of at most window / one of these.
SHORT, BUNDLES = 16, (4, 16, 1)
SLICE_BYTES = 1 << 21


def combinations(units: int, parts: int) -> list[tuple[int, ...]]:
    """All sets of at most ``parts`` lengths, largest first, that fill ``units`` exactly."""
    if parts == 1:
        return [(units,)]
    found = [(units,)]

    def grow(chosen: tuple[int, ...], left: int) -> None:
        if left == 0:
            found.append(chosen)
        elif len(chosen) < parts:
            for x in range(min(chosen[-1], left), 0, -1):
                grow((*chosen, x), left - x)

    for x in range(units - 1, 0, -1):
        grow((x,), units - x)
    return found


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Least squares with non-negative unknowns, by an active set of columns."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, dtype=bool)
    slope = a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(slope).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0] + 10):
        if free.all() or slope[~free].max() <= tolerance:
            break
        free[np.argmax(np.where(free, -np.inf, slope))] = True
        while True:
            s = np.zeros(n)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            bad = free & (s <= 0)
            if not bad.any():
                break
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x += step * (s - x)
            free &= x > 1e-12
            x[~free] = 0
        x = s
        slope = a.T @ (b - a @ x)
    return x


def greedy(lengths: Counter, room: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns that hold exactly the lengths, each at most ``room`` in all, with how often each is used.

    The longest length opens a pattern, the longest that still fits joins it, and the
    pattern repeats as long as the lengths last: some two patterns a length, whatever the counts.
    """
    left, made = Counter(lengths), []
    while left:
        shape, free = [], room
        rest = Counter(left)
        keys = sorted(rest)
        while free and (at := bisect_right(keys, free)):
            k = keys[at - 1]
            take = min(rest[k], free // k)
            shape += [k] * take
            free -= take * k
            keys.pop(at - 1)
        need = Counter(shape)
        times = min(left[k] // v for k, v in need.items())
        made.append((tuple(shape), times))
        left -= Counter({k: v * times for k, v in need.items()})
    return made


def plan(histogram: Counter, units: int, parts: int = PARTS) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, with how often each is used; together they hold exactly the histogram.

    Repeat counts solve the non-negative least-squares problem, rounded and held to
    what there is; what is left is packed greedily. Work depends on ``units`` alone,
    not on the counts.
    """
    left = Counter({k: v for k, v in histogram.items() if v > 0})
    made: list[tuple[tuple[int, ...], int]] = []
    if left:
        shapes = combinations(units, parts)
        a = np.zeros((units, len(shapes)))
        for j, shape in enumerate(shapes):
            for x in shape:
                a[x - 1, j] += 1
        b = np.array([left[k + 1] for k in range(units)], dtype=float)
        # rows with long lengths weigh more: what is left over of them wastes most
        weight = np.sqrt(np.arange(1, units + 1) / units)
        repeats = nnls(a * weight[:, None], b * weight)
        for j in np.argsort(-repeats, kind="stable"):
            need = Counter(shapes[j])
            times = min([int(repeats[j] + 0.5), *(left[k] // v for k, v in need.items())])
            if times > 0:
                made.append((shapes[j], times))
                left -= Counter({k: v * times for k, v in need.items()})
    return made + greedy(left, units)


def slots(patterns: list[tuple[tuple[int, ...], int]], units: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks of its runs, pieces a sequence, first sequence, and first place in it."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in range(1, units + 1)}
    used: Counter = Counter()
    sequence = 0
    for shape, times in patterns:
        at = 0
        for k, each in sorted(Counter(shape).items(), reverse=True):
            runs[k].append((used[k], each, sequence, at))
            used[k] += each * times
            at += each
        sequence += times
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in runs.items() if v}


@dataclass
class Layout:
    """Where the pieces of each length go, by their rank among pieces of that length."""

    short: dict[int, tuple[np.ndarray, ...]]  # exact lengths: first ranks of runs, pieces a bundle, its bin, first rank in it, first place
    runs: dict[int, tuple[np.ndarray, ...]]  # bins: see ``slots``
    sequences: int


def layout(short: Counter, bins: Counter, window: int, unit: int, parts: int = PARTS) -> Layout:
    """Plan pieces of exact ``short`` lengths and of ``bins``, lengths in units rounded up.

    Short pieces would waste much by rounding up. They are first put together, by the
    token, in bundles, and a bundle is planned like a piece. How large bundles serve best
    depends on what else there is, so each size in ``BUNDLES`` is planned and the plan of
    the fewest sequences is taken.
    """
    tried = []
    for share in BUNDLES if short else BUNDLES[:1]:
        taken, used = Counter(bins), Counter()
        inner: dict[int, list[tuple[int, ...]]] = {}
        for shape, times in greedy(short, window // share):
            at, k = 0, -(-sum(shape) // unit)
            for n, each in sorted(Counter(shape).items(), reverse=True):
                inner.setdefault(n, []).append((used[n], each, k, taken[k], at))
                used[n] += each * times
                at += each
            taken[k] += times
        patterns = plan(taken, window // unit, parts)
        lists = {n: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for n, v in inner.items()}
        tried.append(Layout(lists, slots(patterns, window // unit), sum(times for _, times in patterns)))
    return min(tried, key=lambda x: x.sequences)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, window: int, end: int) -> Iterator[pa.RecordBatch]:
    encoder = word_tokenizer(path)
    for batch in batches:
        texts = batch.column("text")
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        for rows in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(size // SLICE_BYTES)) + 1) if len(texts) else []:
            low, n = int(rows[0]), len(rows)
            ids, first = encoder.lists(texts.slice(low, n))
            flat = np.insert(ids.astype(np.int32), first[1:], end)
            total = np.diff(first) + 1
            many = -(-total // window)
            owner = np.repeat(np.arange(n), many)
            start = window * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
            length = np.minimum(window, total[owner] - start)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(flat))
            columns = [batch.column("id").slice(low, n).take(pa.array(owner)), *(pa.array(x, pa.int64()) for x in (start, length, total[owner])), lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "doc_tokens", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A checksum of each piece's ids (unsigned, of little-endian unsigned 32-bit ids) in their place."""
    for batch in batches:
        lists = batch.column("ids")
        flat, at = lists.flatten().to_numpy().astype("<u4"), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
        sums = pa.array([zlib.crc32(memoryview(flat[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())
        names = [c for c in batch.schema.names if c != "ids"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), sums], [*names, "ids_crc32"])


#: What becomes of a piece's ids: a function of Arrow batches, and the column that it makes.
Shown = tuple[Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], str]
WHOLE: Shown = (lambda batches: batches, "ids array<int>")
DIGEST: Shown = (_digested, "ids_crc32 long")


def _placed(batches: Iterator[pa.RecordBatch], found: Layout, full: int, short: int) -> Iterator[pa.RecordBatch]:
    """Sequence, place and place in a bundle of each piece, from its rank among the pieces of its kind."""
    for batch in batches:
        kind, rank = batch.column("kind").to_numpy(), batch.column("rank").to_numpy().copy()
        bins, inside = np.maximum(kind - short, 0), np.zeros(len(rank), dtype=np.int64)
        for n in np.unique(kind[(kind > 0) & (kind <= short)]):  # from a place in a bundle to the bundle's rank
            at = np.flatnonzero(kind == n)
            first, each, k, base, where = found.short[int(n)]
            j = np.searchsorted(first, rank[at], side="right") - 1
            turn, slot = np.divmod(rank[at] - first[j], each[j])
            bins[at], rank[at], inside[at] = k[j], base[j] + turn, where[j] + slot
        sequence, place = rank.copy(), np.zeros(len(rank), dtype=np.int64)  # bin 0: pieces as long as a window
        for k in np.unique(bins[bins > 0]):
            at = np.flatnonzero(bins == k)
            first, each, base, where = found.runs[int(k)]
            j = np.searchsorted(first, rank[at], side="right") - 1
            turn, slot = np.divmod(rank[at] - first[j], each[j])
            sequence[at], place[at] = full + base[j] + turn, where[j] + slot
        columns = {"piece": batch.column("piece"), "length": batch.column("length"), "sequence_id": sequence, "place": place, "inside": inside}
        yield pa.RecordBatch.from_pydict(columns)


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, shown: Shown = WHOLE) -> DataFrame:
    """Every document's token ids, followed by ``end``, cut into whole windows and a remainder; written once.

    Columns: piece (a key), part, ``id_col``, start, length, doc_tokens and what ``shown`` makes of the ids.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    made, column = shown
    work = lean(lambda batches: made(_pieces(batches, tokenizer, window, end)), keep_words=True)
    cut = rows.mapInArrow(work, f"id {kind}, start long, length long, doc_tokens long, {column}")
    rest = [c for c in cut.columns if c != "id"]
    cut = cut.select(F.monotonically_increasing_id().alias("piece"), F.spark_partition_id().alias("part"), F.col("id").alias(id_col), *rest)
    return written(cut, "pieces")


def places(cut: DataFrame, window: int = WINDOW, parts: int = PARTS, unit: int = UNIT) -> DataFrame:
    """Sequence and offset of each of the written ``pieces``: piece, sequence_id, offset.

    Only the histogram of remainders, at most window / unit + window / SHORT counts,
    reaches the driver; its plan is as bounded. A piece finds its place by its rank
    among pieces of its length, a prefix sum over partitions, so neither a common
    length nor a long document gathers in one task.
    """
    if window % unit:
        raise ValueError("window must be a multiple of unit")
    # kinds of pieces: whole windows 0, short ones their length, others their units behind those
    short, length = window // SHORT, F.col("length")
    kind = F.when(length == window, 0).when(length <= short, length).otherwise(short + F.ceil(length / unit)).cast("long")
    narrow = cut.select("part", "piece", "length", kind.alias("kind"))
    counts = {int(k): n for k, n in narrow.groupBy("kind").agg(F.count(F.lit(1))).collect()}  # one row a kind
    full = counts.get(0, 0)
    few = Counter({k: n for k, n in counts.items() if 0 < k <= short})
    found = layout(few, Counter({k - short: n for k, n in counts.items() if k > short}), window, unit, parts)
    # partitions within each kind, so that a prefix sum over them gives ranks in kinds one after another
    keys = {"_p": F.col("kind") * (1 << 40) + F.col("part"), "_one": F.lit(1).cast("long")}
    rank = with_prefix(narrow.withColumns(keys), ["piece"], {"at": "_one"})
    before, passed = {}, 0
    for k in sorted({0, *counts}):
        before[k] = passed
        passed += counts.get(k, 0)
    first = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv])
    ranked = rank.select("piece", "length", "kind", (F.col("at") - F.element_at(first, F.col("kind"))).alias("rank"))
    work = lean(lambda batches: _placed(batches, found, full, short), keep_words=True)
    placed = ranked.mapInArrow(work, "piece long, length long, sequence_id long, place long, inside long")
    ahead = Window.partitionBy("sequence_id").orderBy("place", "inside").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("piece", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long").alias("offset"))


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, parts: int = PARTS, unit: int = UNIT, shown: Shown = WHOLE) -> DataFrame:
    """Pack every document's token ids, followed by ``end``, into sequences of at most ``window``.

    Returns one row a piece: ``id_col``, start (ids of its document before it), ids
    (array), length, doc_tokens, sequence_id and offset (gapless from 0 in its
    sequence). Each id lies in exactly one piece; only documents longer than a
    window are cut, into whole windows and a remainder. ``window`` is a multiple of
    ``unit``; rounding wastes less than ``unit`` tokens for each piece of a sequence that
    is longer than window / SHORT, and for each bundle of shorter ones.
    ``shown`` may turn the ids into what is wanted of them (``DIGEST``: a checksum)
    as they are made, so that whole ids are neither written nor shuffled.

    A null or empty text has just the end id. Null ids pass through; rows that repeat
    an id are separate documents. An empty table gives no rows. Other columns of
    ``df`` don't matter. Texts are tokenized once.
    """
    cut = pieces(df, tokenizer, id_col, text_col, window, end, shown)
    return cut.drop("part").join(places(cut, window, parts, unit), "piece").drop("piece")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids, with checksums of the pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizer_path(), shown=DIGEST)
