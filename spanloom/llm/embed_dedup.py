"""Near-duplicate embeddings: spherical k-means cells, and blocked cosine products within them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import complete_groups, connected_components, lean, partitions, written
from spanloom.llm.vectors import by_length, comparable, element_type, matrix, rows_of, sequential_dot

THRESHOLD = 0.95
#: Vectors that k-means learns from for each cell and at least, the fewest vectors a cell has on average, rounds, vectors a block, and rows compared at once.
PER_CENTRE, SAMPLE, PER_CELL, ROUNDS, BLOCK, ROWS = 64, 8192, 4096, 12, 6144, 512
#: Beyond as many vectors, cells grow with the square root of their number.
ROOT = 1 << 20


def unit(vecs: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; the largest component goes first, against overflow."""
    vecs = vecs.astype(np.float64)
    vecs = vecs / np.abs(vecs).max(axis=1, keepdims=True)
    return vecs / np.linalg.norm(vecs, axis=1, keepdims=True)


def spherical_kmeans(vecs: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Unit centroids; started far apart, then moved to the mean direction of their members."""
    rng = np.random.default_rng(seed)
    chosen = [vecs[rng.integers(len(vecs))]]
    far = 1 - vecs @ chosen[0]
    while len(chosen) < min(cells, len(vecs)):
        weight = np.maximum(far, 0) ** 2
        if weight.sum() <= 1e-18:
            break
        chosen.append(vecs[rng.choice(len(vecs), p=weight / weight.sum())])
        far = np.minimum(far, 1 - vecs @ chosen[-1])
    centres = np.array(chosen)
    for _ in range(rounds):
        home = (vecs @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, vecs)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centres)
    return centres


def cells_for(n: int) -> int:
    """Cells of n vectors: two, or one for every PER_CELL, later in proportion to the square root."""
    return max(2, int(min(n, np.sqrt(n * ROOT)) // PER_CELL))


def _assigned(batches: Iterator[pa.RecordBatch], centres: dict[int, np.ndarray], reach: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Each vector's home cell, and lower-numbered cells that may hold vectors within ``reach`` of it.

    A length without centroids is one cell. Cells are parted by the planes midway between centroids. A vector closer than
    ``reach`` to another cell's vector is at most that far from their plane.
    """
    gaps = {}
    for dims, c in centres.items():
        gap = gaps[dims] = np.linalg.norm(c[:, None] - c[None, :], axis=2)
        np.fill_diagonal(gap, np.inf)
        gap[gap < 1e-12] = np.inf
    for dims, batch in (part for whole in batches for part in by_length(whole)):
        vecs = matrix(batch.column("vec")).astype(kind)
        if dims in centres:
            near = unit(vecs) @ centres[dims].T
            home = near.argmax(axis=1)
            beyond = (near[np.arange(len(home)), home][:, None] - near) / gaps[dims][home]
            visits = (beyond <= reach) & (np.arange(len(centres[dims]))[None, :] < home[:, None])
        else:
            home, visits = np.zeros(len(vecs), dtype=np.int64), np.zeros((len(vecs), 0), dtype=bool)
        row, cell = np.nonzero(visits)
        rows = np.r_[np.arange(len(home)), row]
        width = vecs.shape[1] * vecs.itemsize
        # a vector travels as its bytes
        packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(vecs[rows]))])
        took = [*(batch.column(c).take(pa.array(rows)) for c in ("rep", "copies")), packed]
        side = np.r_[np.zeros(len(home), dtype=np.int32), np.ones(len(row), dtype=np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[home, cell].astype(np.int64)), pa.array(side), *took, pa.array(np.full(len(rows), dims, dtype=np.int32))], ["cell", "side", "rep", "copies", "vec", "dims"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, bound in complete_groups(batches, "block"):
        vecs = table.column("vec").combine_chunks()
        data, at = vecs.buffers()[2], np.frombuffer(vecs.buffers()[1], np.int32)[vecs.offset : vecs.offset + len(vecs) + 1]
        plain = {c: table.column(c).to_numpy() for c in ("cell", "side", "chunk", "rep", "copies", "dims")}
        made = [(int(plain["cell"][a]), int(plain["side"][a]), int(plain["chunk"][a]), plain["rep"][a:b].tobytes(), plain["copies"][a:b].tobytes(), data[int(at[a]) : int(at[b])].to_pybytes(), int(plain["dims"][a])) for a, b in zip(bound[:-1], bound[1:], strict=True)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), kinds, strict=True)], ["cell", "side", "chunk", "reps", "copies", "vecs", "dims"])


def _near(a: np.ndarray, ua: np.ndarray, b: np.ndarray, ub: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two blocks have a cosine of at least ``threshold``; close cases are decided in double precision."""
    cosine = ua @ ub.T
    near = cosine >= threshold
    x, y = np.nonzero(np.abs(cosine - threshold) < 1e-5)
    near[x, y] = sequential_dot(a[x], b[y]) / (np.sqrt(sequential_dot(a[x], a[x])) * np.sqrt(sequential_dot(b[y], b[y]))) >= threshold
    return near


def _linked(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...] | None, threshold: float) -> list[np.ndarray] | None:
    """Links of a block with itself or with another: ids, sums of their partners' copies, and a small id that each is tied to.

    Each row is tied to its smallest partner, its hub, and each partner to the
    smallest hub of its rows; a row with a partner that went to a smaller hub ties the two
    hubs. So the ties join all that the links join.
    """
    ids, copies, vecs = one
    other, more, theirs = two or one
    ua, ub = unit(vecs).astype(np.float32), unit(theirs).astype(np.float32)
    top = np.iinfo(np.int64).max
    links, back = np.zeros(len(ids), np.int64), np.zeros(len(other), np.int64)
    edges: list[np.ndarray] = []
    for low in range(0, len(ids), ROWS):
        rows = slice(low, min(low + ROWS, len(ids)))
        near = _near(vecs[rows], ua[rows], theirs, ub, threshold)
        if two is None:
            near[np.arange(near.shape[0]), np.arange(low, low + near.shape[0])] = False
        some, few = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(some):
            continue
        near = near[np.ix_(some, few)]
        mine, partners = ids[rows][some], other[few]
        links[rows][some] += near @ more[few]
        back[few] += copies[rows][some] @ near
        hub = np.where(near, partners[None, :], top).min(axis=1)  # each row is tied to its smallest partner
        least = np.where(near, hub[:, None], top).min(axis=0)  # and each partner to the smallest of its rows' hubs
        edges += [np.stack([mine, hub]), np.stack([partners, least])]
        loose = np.where(near, least[None, :], top).min(axis=1) != hub  # rows with a partner that went to a smaller hub
        for r in np.flatnonzero(loose):
            own = np.unique(least[near[r]])
            edges.append(np.stack([np.full(len(own), hub[r]), own]))
    if not edges:
        return None
    pairs = np.unique(np.concatenate(edges, axis=1), axis=1)
    sums = [(ids, links)] if two is None else [(ids, links), (other, back)]
    who, total = (np.concatenate(x) for x in zip(*sums, strict=True))
    kept = total > 0
    return [np.r_[who[kept], pairs[0]], np.r_[total[kept], np.zeros(pairs.shape[1], np.int64)], np.r_[who[kept], pairs[1]]]


def _compared(batches: Iterator[pa.RecordBatch], kind: str, threshold: float) -> Iterator[pa.RecordBatch]:
    """Each task: one block with itself, or two blocks with each other."""
    held: dict | None = None

    def decoded(row: dict) -> tuple[np.ndarray, ...]:
        return np.frombuffer(row["reps"], np.int64), np.frombuffer(row["copies"], np.int64), np.frombuffer(row["vecs"], kind).reshape(-1, row["dims"])

    for row in rows_of(batches):
        if row["alone"]:
            out = _linked(decoded(row), None, threshold)
        elif held is not None and held["task"] == row["task"]:
            out, held = _linked(decoded(held), decoded(row), threshold), None
        else:
            held = row
            continue
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["rep", "links", "root"])


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Link all vectors with a cosine of at least ``threshold``, whatever their other columns say.

    Returns one row for each distinct id: ``id_col``, n_links (other vectors linked
    directly, equal ones included), component_id (smallest id reachable by links, its
    own included) and kept (it is its component's smallest).

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, and vectors link only with others of their length. Null ids give one row, linked with
    nothing. Of rows that repeat an id the smallest vector stands. An empty table
    gives no rows. Other columns don't matter.

    Equal vectors collapse first, by an aggregate that combines on the map side.
    Spherical k-means learns the cells of each length from ``SAMPLE`` of its vectors, or
    ``PER_CENTRE`` a cell if that is more, those with the smallest hash of their id; all vectors are assigned. A vector also
    visits the cells whose plane it is close to, so no pair is lost at a border.
    A cell's vectors are split into blocks; each pair of blocks is a task, so a
    large cell spreads over the cluster. Tasks give sums and stars, never pairs.
    """
    spark = df.sparkSession
    n_parts = partitions(spark)
    rows = written(comparable(df, id_col, vector_col), "vectors")
    kind = element_type(rows)
    classes = written(rows.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    centres = {}
    for dims, n in classes.groupBy(F.size("vec").alias("dims")).agg(F.count(F.lit(1)).alias("n")).collect():
        learned = max(SAMPLE, PER_CENTRE * cells_for(n))  # 8,192 vectors, or 64 a cell
        sample = classes.where(F.size("vec") == dims).orderBy(F.xxhash64("rep"), "rep").limit(learned).select("vec").toPandas()["vec"]
        centres[dims] = spherical_kmeans(unit(np.array(sample.tolist())), cells_for(n))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6

    placed = classes.select("rep", "copies", "vec").mapInArrow(lean(lambda b: _assigned(b, centres, reach, kind)), "cell long, side int, rep long, copies long, vec binary, dims int")
    placed = written(placed, "placed")
    sizes = placed.groupBy("dims", "cell", "side").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("of"))  # two rows a cell
    placed = placed.join(F.broadcast(sizes), ["dims", "cell", "side"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), "of").cast("int"))
    placed = placed.withColumn("block", F.xxhash64("dims", "cell", "side", "chunk")).repartition(n_parts, "block").sortWithinPartitions("block")
    blocks = placed.select("block", "cell", "side", "chunk", "rep", "copies", "vec", "dims").mapInArrow(lean(_packed), "cell long, side int, chunk int, reps binary, copies binary, vecs binary, dims int")
    blocks = written(blocks, "blocks")

    counts = sizes.groupBy("dims", "cell").agg(F.sum(F.when(F.col("side") == 0, F.col("of"))).cast("int").alias("homes"), F.coalesce(F.sum(F.when(F.col("side") == 1, F.col("of"))), F.lit(0)).cast("int").alias("visitors"))
    joined = blocks.join(F.broadcast(counts), ["dims", "cell"])
    data = ["reps", "copies", "vecs", "dims"]
    home, visitor = joined.where("side = 0 AND homes > 0"), joined.where("side = 1 AND homes > 0")
    tasks = [
        home.select(F.xxhash64("dims", "cell", F.lit("h"), "chunk", "chunk").alias("task"), F.lit(True).alias("alone"), *data),
        home.withColumn("with", F.explode(F.expr("filter(sequence(0, homes - 1), x -> x <> chunk)"))).select(F.xxhash64("dims", "cell", F.lit("h"), F.least("chunk", "with"), F.greatest("chunk", "with")).alias("task"), F.lit(False).alias("alone"), *data),
        home.where("visitors > 0").withColumn("with", F.explode(F.expr("sequence(0, visitors - 1)"))).select(F.xxhash64("dims", "cell", F.lit("v"), "with", "chunk").alias("task"), F.lit(False).alias("alone"), *data),
        visitor.withColumn("with", F.explode(F.expr("sequence(0, homes - 1)"))).select(F.xxhash64("dims", "cell", F.lit("v"), "chunk", "with").alias("task"), F.lit(False).alias("alone"), *data),
    ]
    all_tasks = tasks[0].unionByName(tasks[1]).unionByName(tasks[2]).unionByName(tasks[3]).repartition(n_parts, "task").sortWithinPartitions("task")
    links = written(all_tasks.mapInArrow(lean(lambda b: _compared(b, kind, threshold)), "rep long, links long, root long"), "links")
    components = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    summed = links.groupBy("rep").agg(F.sum("links").alias("links"))
    told = classes.join(summed, "rep", "left").join(components, F.col("rep") == F.col("node"), "left").select("vec", "rep", "copies", "links", "component")
    # a hash of the vector is the key, so only equal hashes compare vectors
    key = F.xxhash64("vec")
    by_id = rows.withColumn("h", key).join(told.withColumn("h", key), ["h", "vec"]).select("id", "rep", "copies", "links", "component")

    everyone = df.select(F.col(id_col).cast("long").alias("id")).distinct()
    root = F.coalesce("component", "rep", "id")
    return everyone.join(by_id, "id", "left").select(
        F.col("id").alias(id_col), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        root.alias("component_id"), F.coalesce(root == F.col("id"), F.lit(True)).alias("kept"),
    )


def op9(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT roots.a AS vec_id, coalesce(n, 0)::BIGINT AS n_links, root AS component_id, root = roots.a AS kept FROM roots LEFT JOIN links ON links.a = roots.a
"""
