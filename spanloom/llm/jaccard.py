"""Jaccard join of texts on word shingles, by an LSH forest of MinHash signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import complete_groups, connected_components, lean, partitions, written
from spanloom.llm.shingles import digests, minhashes, normalized, slices, words_of

WIDTH, THRESHOLD = 5, 0.8
#: Tries of the forest, steps of a path, and the recall wanted for two texts at the threshold.
TREES, DEPTH, RECALL = 20, 6, 0.9998
#: A path's step has 16 bits, four steps are a long: the order of paths is the order of a trie's leaves.
STEPS = 4
#: A task compares at most two blocks of about so many texts and bytes; a prefix with more members is crowded.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Rounds in which members of crowded prefixes are measured against a representative.
ROUNDS = 3
#: Distances from a representative are told apart in so many steps.
BINS = 64
SEED = 90210
#: Ids of texts to be compared, up to this many, are sent to the tasks that read texts; more are joined by a shuffle.
BROADCAST_IDS = 200_000
NO_FAMILY = -(1 << 63)


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """Shorten the matched prefix until two texts at the threshold meet in some trie with the wanted probability."""
    length = depth
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def spare_trees(threshold: float, trees: int, depth: int, length: int, recall: float) -> int:
    """How many of a text's tries may keep the whole path when all others are shortened to ``length``."""
    miss = lambda k: (1 - threshold**length) ** (trees - k) * (1 - threshold**depth) ** k
    k = 0
    while k < trees and miss(k + 1) <= 1 - recall:
        k += 1
    return k


def _paths(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values (texts x trees x steps) as two longs a path, the first steps in the highest bits."""
    steps = ((signature ^ (signature >> np.uint32(16))) & np.uint32(0xFFFF)).astype(np.uint64)
    packed = np.zeros((2, *steps.shape[:2]), dtype=np.uint64)
    for k in range(steps.shape[2]):
        packed[k // STEPS] |= steps[:, :, k] << np.uint64(16 * (STEPS - 1 - k % STEPS))
    return packed[0].view(np.int64), packed[1].view(np.int64)


def _node(high: Column, low: Column, length: int) -> Column:
    """The trie's node that a path passes after ``length`` steps."""
    if length <= STEPS:
        return F.shiftrightunsigned(high, 16 * (STEPS - length))
    return F.xxhash64(high, F.shiftrightunsigned(low, 16 * (2 * STEPS - length)))


def _signed(batches: Iterator[pa.RecordBatch], width: int, trees: int, depth: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids, raw = normalized(batch.column("text")), batch.column("id"), batch.column("raw")
        for at, to in slices(texts):
            part = texts.slice(at, to - at)
            bounds = words_of(part)
            hashes, bound = bounds.shingles(width)
            full = np.flatnonzero(np.diff(bound))
            high, low = _paths(minhashes(hashes, bound, trees * depth, SEED).reshape(to - at, trees, depth))
            ends = pa.array(np.arange(len(full) + 1, dtype=np.int32) * trees)
            paths = [pa.ListArray.from_arrays(ends, pa.array(x[full].ravel())) for x in (high, low)]
            took = pa.array(full)
            digest = pa.array(digests(part), pa.binary()).take(took)
            size = pa.array(np.diff(bounds.texts)[full])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, to - at).take(took), digest, size, *paths, raw.slice(at, to - at).take(took)],
                ["id", "digest", "size", "high", "low", "raw"],
            )


def text_key(text_col: str) -> Column:
    """What tells an id's text from its other ones when texts are joined back."""
    return F.unhex(F.md5(F.col(text_col).cast("binary")))


def signatures(df: DataFrame, id_col: str, text_col: str, width: int, trees: int, depth: int) -> DataFrame:
    """One row for each distinct non-null id whose text has words.

    Columns: id, digest and bytes of its words, its path in each trie (high, low), and the text's key (raw).
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_key(text_col).alias("raw"))
    rows = rows.where("id IS NOT NULL AND text IS NOT NULL")
    fields = "id long, digest binary, size long, high array<long>, low array<long>, raw binary"
    made = rows.mapInArrow(lean(lambda batches: _signed(batches, width, trees, depth)), fields)
    return made.groupBy("id").agg(F.min(F.struct("digest", "size", "high", "low", "raw")).alias("s")).select("id", "s.*")


def _forest(classes: DataFrame, length: int, spare: int) -> tuple[DataFrame, DataFrame]:
    """Meetings in the tries, and each text's node in every trie.

    Returns members (rep, size, tree, node, n, bytes, hub: the smallest member) of the nodes
    with at least two, and (rep, labels). Paths are cut to ``length`` steps. A crowded node
    keeps whole paths apart if each of its members can spare that trie: if it is
    among the ``spare`` most crowded ones of the member's own.
    """
    spots = classes.select("rep", "size", F.posexplode(F.arrays_zip("high", "low")).alias("tree", "p"))
    spots = spots.select("rep", "size", "tree", _node(F.col("p.high"), F.col("p.low"), length).alias("node"), F.xxhash64("p.high", "p.low").alias("path"))

    def met(rows: DataFrame, keys: list[str]) -> DataFrame:
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("rep").alias("hub"))
        return rows.join(sizes.where("n > 1"), keys)

    members = written(met(spots, ["tree", "node"]), "members")
    labels = classes.select("rep", F.transform(F.arrays_zip("high", "low"), lambda p: _node(p["high"], p["low"], length)).alias("labels"))
    crowded = members.where(F.col("n") > BLOCK)
    if not spare or crowded.isEmpty():
        return members, labels
    # at most one row a trie is gathered for a text
    ranked = crowded.groupBy("rep").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "tree")), False), 1, spare).alias("most"))
    spared = ranked.select("rep", F.explode("most").alias("m")).select("rep", "m.tree", F.lit(1).alias("spared"))
    whole = crowded.join(spared, ["rep", "tree"], "left").groupBy("tree", "node").agg(F.count("spared").alias("k"), F.count(F.lit(1)).alias("n"))
    whole = written(whole.where("k = n").select("tree", "node"), "lengthened")
    longer = written(members.join(whole, ["tree", "node"], "left_semi").select("rep", "size", "tree", F.col("path").alias("node")), "longer")
    kept = members.join(whole, ["tree", "node"], "left_anti")
    members = written(kept.drop("path").unionByName(met(longer, ["tree", "node"])), "members")
    changed = longer.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("tree", "node"))).alias("changed"))
    new = F.transform("labels", lambda x, t: F.coalesce(F.col("changed")[t], x))
    return members, labels.join(changed, "rep", "left").select("rep", F.when(F.col("changed").isNull(), F.col("labels")).otherwise(new).alias("labels"))


def _first_meetings(labels: np.ndarray, tree: int, block: np.ndarray, i: int, j: int, fam: np.ndarray) -> np.ndarray:
    """Pairs of a task's members that meet in this trie and in none before it, each once; not those of one family."""
    met = labels[:, None, tree] == labels[None, :, tree]
    for before in range(tree):
        met &= labels[:, None, before] != labels[None, :, before]
    met &= (fam[:, None] != fam[None, :]) | (fam[:, None] == NO_FAMILY)
    met &= np.triu(np.ones(met.shape, dtype=bool), 1) if i == j else (block[:, None] == i) & (block[None, :] == j)
    return met


def _columns(table: pa.Table, trees: int) -> tuple[np.ndarray, ...]:
    labels = table.column("labels").combine_chunks()
    labels = labels.flatten().to_numpy().reshape(-1, trees)
    return (labels, *(table.column(c).to_numpy() for c in ("tree", "block", "i", "j", "rep", "fam")))


def _new_members(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[pa.RecordBatch]:
    """Keep the members that meet someone for the first time in their task's trie."""
    for table, bound in complete_groups(batches, "task"):
        labels, tree, block, i, j, _, fam = _columns(table, trees)
        stay = np.zeros(table.num_rows, dtype=bool)
        two = bound[:-1][np.diff(bound) == 2]
        first = (fam[two] != fam[two + 1]) | (fam[two] == NO_FAMILY)
        for before in range(trees):
            first &= (labels[two, before] != labels[two + 1, before]) | (before >= tree[two])
        first &= (i[two] == j[two]) | (block[two] != block[two + 1])
        stay[two] = stay[two + 1] = first
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            if b - a > 2:
                met = _first_meetings(labels[a:b], tree[a], block[a:b], i[a], j[a], fam[a:b])
                stay[a:b] = met.any(axis=0) | met.any(axis=1)
        if stay.any():
            yield from table.filter(pa.array(stay)).to_batches()


def overlaps(hashes: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the shingle sets, and of the intersections of all pairs of one task's sets."""
    n = len(bound) - 1
    values, codes = np.unique(hashes, return_inverse=True)
    spots = np.unique(np.repeat(np.arange(n), np.diff(bound)) * np.int64(len(values)) + codes) if len(values) else np.zeros(0, np.int64)
    owner, code = spots // max(len(values), 1), spots % max(len(values), 1)
    size = np.bincount(owner, minlength=n)
    shared = np.bincount(code, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    owner, code = owner[shared[code]], place[code[shared[code]]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    inter = np.zeros((n, n), dtype=np.float32)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):  # exact: counts stay far below 2**24
        a, b = np.searchsorted(code, (low, low + 4096))
        has = np.zeros((n, 4096), dtype=np.float32)
        has[owner[a:b], code[a:b] - low] = 1
        inter += has @ has.T
    return size, inter


def _verified(batches: Iterator[pa.RecordBatch], width: int, threshold: float, trees: int) -> Iterator[pa.RecordBatch]:
    """Exact similarities of the pairs that meet; sums of links and a star for each local component."""
    for table, bound in complete_groups(batches, "task"):
        labels, tree, block, i, j, rep, fam = _columns(table, trees)
        copies = table.column("copies").to_numpy()
        texts = normalized(table.column("text"))
        out: list[tuple[np.ndarray, ...]] = []
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            rows = np.arange(a, b)
            met = _first_meetings(labels[rows], tree[a], block[rows], i[a], j[a], fam[rows])
            hashes, where = words_of(texts.slice(a, b - a)).shingles(width)
            size, inter = overlaps(hashes, where)
            near = met & (inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-4)
            near |= near.T
            if not near.any():
                continue
            ids, weight = rep[rows], copies[rows]
            root = np.arange(len(rows))
            order = np.argsort(ids)
            rank = np.empty_like(root)
            rank[order] = root
            least = rank.copy()
            while True:  # the smallest id of each local component
                now = np.minimum(least, np.where(near, least[None, :], len(rows)).min(axis=1))
                if np.array_equal(now, least):
                    break
                least = now
            linked = np.flatnonzero(near.any(axis=1))
            out.append((ids[linked], near[linked] @ weight, ids[order][least[linked]], near[linked].sum(axis=1)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["rep", "links", "root", "texts"])


def _measured(batches: Iterator[pa.RecordBatch], width: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Each task: a representative's text, then texts; those at the threshold or above give what sets them apart from it."""
    for table, bound in complete_groups(batches, "task"):
        texts = normalized(table.column("text"))
        rep, hub = table.column("rep").to_numpy(), table.column("hub").to_numpy()
        out = []
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            hashes, where = words_of(texts.slice(a, b - a)).shingles(width)
            base = np.unique(hashes[: where[1]])
            for k in range(1, b - a):
                other = np.setxor1d(base, np.unique(hashes[where[k] : where[k + 1]]), assume_unique=True)
                gone = int(np.isin(other, base, assume_unique=True).sum())
                more = len(other) - gone
                if len(base) - gone >= threshold * (len(base) + more) - 1e-4:
                    out.append((int(rep[a + k]), int(hub[a]), len(base), gone, more, other.tobytes()))
        if out:
            kinds = (pa.int64(),) * 5 + (pa.binary(),)
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "fam", "base", "gone", "more", "diff"])


def _span(threshold: float) -> float:
    """Share of a representative's shingles that a text at the threshold may lack, or have besides them, at most."""
    return max(1 - threshold, 1 / threshold - 1)


def _decided(base: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of bins (shingles gone, shingles more) are linked, and which are not, whatever their members hold."""
    step = max(1, int(np.ceil(base * _span(threshold) / BINS)))
    g, m = a[0][:, None] * step, a[1][:, None] * step  # the most that a bin's members can have
    h, n = b[0][None, :] * step, b[1][None, :] * step
    low = lambda x: np.where(x > 0, x - step + 1, 0)
    surely = base - g - h >= threshold * (base + m + n)
    never = base - np.maximum(low(g), low(h)) + np.minimum(m, n) < threshold * (base - np.minimum(g, h) + np.maximum(low(m), low(n))) - 1e-3
    return surely, never


def _binned(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """For each bin of a family: what it is surely linked with, and whether some pairs must be looked at."""
    for table, bound in complete_groups(batches, "fam"):
        fam, base, gone, more, texts, copies = (table.column(c).to_numpy() for c in ("fam", "base", "gone", "more", "texts", "copies"))
        made = [np.zeros(len(fam), np.int64), np.zeros(len(fam), np.int64), np.zeros(len(fam), bool), np.zeros(len(fam), bool)]
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            for low in range(a, b, 256):
                rows = slice(low, min(low + 256, b))
                surely, never = _decided(int(base[a]), (gone[rows], more[rows]), (gone[a:b], more[a:b]), threshold)
                made[0][rows], made[1][rows] = surely @ copies[a:b], surely @ texts[a:b]
                made[2][rows] = surely[np.arange(surely.shape[0]), np.arange(low - a, low - a + surely.shape[0])]
                made[3][rows] = ~(surely | never).all(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fam, gone, more, *made)], ["fam", "gone_bin", "more_bin", "sure_copies", "sure_texts", "own", "open"])


def _undecided(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links of the pairs of a family that its bins leave open, from what sets their texts apart from the representative."""
    for table, bound in complete_groups(batches, "task"):
        rep, copies, block, i, j, base, gone, more, gone_bin, more_bin = (
            table.column(c).to_numpy() for c in ("rep", "copies", "block", "i", "j", "base", "gone", "more", "gone_bin", "more_bin")
        )
        diffs = table.column("diff").to_pylist()
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            where = np.r_[0, np.cumsum([len(x) // 8 for x in diffs[a:b]])]
            _, common = overlaps(np.frombuffer(b"".join(diffs[a:b]), dtype=np.uint64), where)
            g, m, whole = gone[a:b], more[a:b], int(base[a])
            inter = whole - g[:, None] - g[None, :] + common
            bins = (gone_bin[a:b], more_bin[a:b])
            surely, never = _decided(whole, bins, bins, threshold)
            size = whole - g + m
            near = (inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-4) & ~surely & ~never
            if i[a] == j[a]:
                np.fill_diagonal(near, False)
            else:
                near &= block[a:b, None] != block[None, a:b]
            some = np.flatnonzero(near.any(axis=1))
            if len(some):
                made = (rep[a:b][some], near[some] @ copies[a:b], near[some].sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in made], ["rep", "links", "texts"])


def _dealt(rows: DataFrame, of: Column, key: list[str], n: int) -> DataFrame:
    """Rows in blocks of their key, and every pair of blocks a task: adds block, i, j and task."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(SEED)), of).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (of - 1).cast("int"))))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    return rows.withColumn("task", F.xxhash64(*key, "i", "j")).repartition(n, "task").sortWithinPartitions("task", "rep")


def _families(members: DataFrame, classes: DataFrame, texts: DataFrame, width: int, threshold: float) -> tuple[DataFrame, DataFrame] | None:
    """Texts of crowded nodes as what sets them apart from a representative, and all links within each such family.

    A text is measured against the smallest member of the crowded nodes that it is in; those at
    the threshold or above are its family. Distances bound the similarity of two
    members, so most pairs are decided by counting bins of distances; the others are
    compared, as differences. A text travels once a round. Returns (rep, fam), and (rep, links, root, texts).
    """
    n_parts = partitions(classes.sparkSession)
    left, found = members.where(F.col("n") > BLOCK).select("rep", "tree", "node"), []
    for _ in range(ROUNDS):
        nodes = left.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("hub")).where(F.col("n") > BLOCK)
        asked = written(left.join(nodes, ["tree", "node"]).groupBy("rep").agg(F.min("hub").alias("hub")), "measured")
        sizes = asked.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("of"))
        if sizes.isEmpty():
            break
        mine = asked.join(sizes, "hub").select("rep", "hub", F.pmod(F.xxhash64("rep"), "of").cast("int").alias("chunk"), F.lit(1).alias("side"))
        hubs = sizes.select(F.col("hub").alias("rep"), "hub", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("chunk"), F.lit(0).alias("side"))
        rows = _with_texts(mine.unionByName(hubs), classes, texts, f"r{len(found)}").withColumn("task", F.xxhash64("hub", "chunk"))
        rows = rows.select("task", "side", "rep", "hub", "text").repartition(n_parts, "task").sortWithinPartitions("task", "side", "rep")
        fields = "rep long, fam long, base long, gone long, more long, diff binary"
        found.append(written(rows.mapInArrow(lean(lambda batches: _measured(batches, width, threshold)), fields), "families"))
        left = written(left.join(asked.select("rep"), "rep", "left_semi").join(found[-1].select("rep"), "rep", "left_anti"), "left")
        if left.isEmpty():
            break
    if not found:
        return None
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    step = F.greatest(F.lit(1), F.ceil(F.col("base") * _span(threshold) / BINS))
    rows = rows.withColumns({f"{c}_bin": F.ceil(F.col(c) / step).cast("long") for c in ("gone", "more")}).join(classes.select("rep", "copies"), "rep")
    bins = rows.groupBy("fam", "base", F.col("gone_bin").alias("gone"), F.col("more_bin").alias("more")).agg(F.count(F.lit(1)).alias("texts"), F.sum("copies").alias("copies"))
    bins = bins.repartition(n_parts, "fam").sortWithinPartitions("fam")
    fields = "fam long, gone_bin long, more_bin long, sure_copies long, sure_texts long, own boolean, open boolean"
    told = written(bins.mapInArrow(lean(lambda batches: _binned(batches, threshold)), fields), "bins")
    rows = written(rows.join(told, ["fam", "gone_bin", "more_bin"]), "family-members")
    own = F.col("own").cast("long")
    links = rows.select("rep", (F.col("sure_copies") - own * F.col("copies")).alias("links"), F.col("fam").alias("root"), (F.col("sure_texts") - own).alias("texts"))
    loose = rows.where("open")
    if not loose.isEmpty():
        sizes = loose.groupBy("fam").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("diff")) / BLOCK_BYTES)).cast("int").alias("of"))
        names = ["rep", "copies", "block", "i", "j", "base", "gone", "more", "gone_bin", "more_bin", "diff"]
        tasks = _dealt(loose.join(sizes, "fam"), F.col("of"), ["fam"], n_parts).select("task", *names)
        exact = tasks.mapInArrow(lean(lambda batches: _undecided(batches, threshold)), "rep long, links long, texts long")
        links = links.unionByName(exact.select("rep", "links", F.col("rep").alias("root"), "texts"))
    return rows.select("rep", "fam"), written(links, "family-links")


def _with_texts(rows: DataFrame, classes: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Rows with the signed text of their ``rep``; ids are sent to where texts are read while they are few."""
    wanted = written(rows.select("rep").distinct().join(classes.select("rep", "raw"), "rep"), f"wanted-{name}")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    # rows that repeat an id and its text count once
    read = texts.join(wanted, ["rep", "raw"], "left_semi").groupBy("rep").agg(F.first("text").alias("text"))
    return rows.join(read, "rep")


def _tasks(members: DataFrame, fam: DataFrame | None) -> DataFrame:
    """Each pair of blocks of a node as a task: rep, tree, block, i, j, task.

    A node of one block is one task. In a crowded node, a family with more members than a
    block has blocks of its own, which are not paired with each other.
    """
    fine = (F.col("n") <= BLOCK) & (F.col("bytes") <= BLOCK_BYTES)
    zero = F.lit(0)
    few = members.where(fine).select("rep", "tree", *[zero.alias(c) for c in ("block", "i", "j")], F.xxhash64("tree", "node").alias("task"))
    many = members.where(~fine).select("rep", "size", "tree", "node")
    many = many.withColumn("fam", F.lit(NO_FAMILY)) if fam is None else many.join(fam, "rep", "left").withColumn("fam", F.coalesce("fam", F.lit(NO_FAMILY)))
    keys = ["tree", "node"]
    per = many.groupBy(*keys, "fam").agg(F.count(F.lit(1)).alias("k"), F.sum("size").alias("b"))
    per = per.withColumn("own", F.when(F.col("k") > BLOCK, F.col("fam")).otherwise(F.lit(NO_FAMILY)))
    parts = per.groupBy(*keys, "own").agg(F.sum("k").alias("k"), F.sum("b").alias("b"))
    of = F.least(F.col("k"), F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("b") / BLOCK_BYTES))).cast("int")
    at = Window.partitionBy(*keys).orderBy("own")
    parts = parts.withColumn("of", of).withColumn("low", F.coalesce(F.sum("of").over(at.rowsBetween(Window.unboundedPreceding, -1)), zero))
    parts = parts.withColumn("all", F.sum("of").over(Window.partitionBy(*keys))).drop("k", "b")
    rows = many.join(per.select(*keys, "fam", "own"), [*keys, "fam"]).join(parts, [*keys, "own"])
    rows = rows.withColumn("block", (F.col("low") + F.pmod(F.xxhash64("rep", "tree"), "of")).cast("int"))
    mixed = F.col("own") == NO_FAMILY
    others = F.filter(F.sequence(zero, F.col("all").cast("int") - 1), lambda x: mixed | (x < F.col("low")) | (x >= F.col("low") + F.col("of")))
    rows = rows.withColumn("other", F.explode(others)).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    return few.unionByName(rows.select("rep", "tree", "block", "i", "j", F.xxhash64("tree", "node", "i", "j").alias("task")))


def jaccard_join(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL
) -> DataFrame:
    """Find all documents whose sets of word shingles have a Jaccard similarity of ``threshold`` or more.

    Returns one row for each distinct id: ``id_col``, copy_id (smallest id with the
    same words), class_id (smallest id reachable by links), n_links (other documents
    linked directly, copies with the same words included), n_texts (different texts
    linked directly) and kept (it is its class's smallest id).

    Words are runs of letters, marks and digits, lower-cased. A text of fewer than ``width``
    words has one shingle of all of them. Null texts and texts without words link
    with nothing. Null ids give one row, linked with nothing.
    Rows that repeat an id are one document; if their texts differ, the one with
    the smallest digest stands, in signatures and in the exact check; to have each
    row judged by its own text, give each its own id. An empty table gives no rows. Other columns of
    ``df`` don't matter.

    Copies collapse first, by an aggregate that combines on the map side. Each
    distinct text has a path of ``depth`` MinHash steps in each of the forest's tries. The matched
    prefix is shortened until texts at the threshold meet with probability
    ``recall`` or more; what the forest has to spare beyond that goes to crowded
    prefixes, which keep whole paths where all their members can afford it. So every
    text keeps the recall, at any size of the corpus.

    Members of a prefix meet in tasks of at most two blocks. In crowded
    prefixes, texts are first measured against a representative: pairs of one family are
    then decided by their distances from it, or compared as differences, and texts
    travel a bounded number of times however large the family is. Other pairs are compared in the
    first trie where they meet, exactly, as a matrix product in their task; tasks give
    sums and stars, never pairs, and only texts that meet someone are shuffled.
    """
    if not 1 <= depth <= 2 * STEPS:
        raise ValueError(f"depth must be from 1 to {2 * STEPS}")
    length = prefix_length(threshold, trees, depth, recall)
    ids = df.select(F.col(id_col).cast("long").alias("id"))
    signed = written(signatures(df, id_col, text_col, width, trees, depth), "signatures")
    first = [F.min_by(c, "id").alias(c) for c in ("high", "low", "raw")]
    classes = signed.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), *first)
    classes = written(classes, "classes")
    texts = df.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"), text_key(text_col).alias("raw"))

    members, labels = _forest(classes, length, spare_trees(threshold, trees, depth, length, recall))
    families = _families(members, classes, texts, width, threshold)
    n = partitions(df.sparkSession)
    fields = "task long, tree int, block int, i int, j int, rep long, copies long, labels array<long>, fam long"
    names = [x.split()[0] for x in fields.split(", ")]
    tasks = _tasks(members, families[0] if families else None).join(classes.select("rep", "copies"), "rep").join(labels, "rep")
    tasks = tasks.join(families[0], "rep", "left").withColumn("fam", F.coalesce("fam", F.lit(NO_FAMILY))) if families else tasks.withColumn("fam", F.lit(NO_FAMILY))
    fresh = tasks.select(*names).repartition(n, "task").sortWithinPartitions("task").mapInArrow(lean(lambda batches: _new_members(batches, trees)), fields)
    fresh = written(fresh, "meetings")

    full = _with_texts(fresh, classes, texts, "pairs").select(*names, "text").repartition(n, "task").sortWithinPartitions("task")
    links = full.mapInArrow(lean(lambda batches: _verified(batches, width, threshold, trees)), "rep long, links long, root long, texts long")
    links = written(links.unionByName(families[1]) if families else links, "links")
    components = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    summed = links.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    told = summed.join(components, F.col("rep") == F.col("node"), "left").select("rep", "links", "texts", F.coalesce("component", "rep").alias("component"))
    per_class = classes.select("digest", "rep", "copies").join(told, "rep", "left")

    placed = signed.select("id", "digest").join(per_class, "digest").drop("digest")
    zero = F.lit(0).cast("long")
    return ids.distinct().join(placed, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("rep", "id").alias("copy_id"), F.coalesce("component", "rep", "id").alias("class_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", zero)).cast("long").alias("n_links"), F.coalesce("texts", zero).alias("n_texts"),
        F.coalesce(F.coalesce("component", "rep", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def op3(spark, sf_dir: str) -> DataFrame:
    """Class and number of links of every document, on five-word shingles at a similarity of 0.8."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
copies AS (SELECT min(doc_id) AS rep, count(*) AS copies, list(doc_id) AS ids, w FROM words WHERE len(w) > 0 GROUP BY w),
shingles AS (
  SELECT DISTINCT rep, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM copies),
sizes AS (SELECT rep, count(*) AS n FROM shingles GROUP BY rep),
pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.rep <> b.rep
  GROUP BY a.rep, b.rep HAVING count(*) >= 0.8 * ((SELECT n FROM sizes WHERE rep = a.rep) + (SELECT n FROM sizes WHERE rep = b.rep) - count(*)) - 1e-4),
reach(a, b) AS (SELECT rep, rep FROM copies UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
links AS (SELECT a, sum(c.copies) AS links, count(*) AS texts FROM pairs JOIN copies c ON c.rep = b GROUP BY a),
placed AS (SELECT unnest(ids) AS doc_id, rep, copies FROM copies)
SELECT d.doc_id, coalesce(p.rep, d.doc_id) AS copy_id, coalesce(root, d.doc_id) AS class_id, (coalesce(copies, 1) - 1 + coalesce(links, 0))::BIGINT AS n_links,
       coalesce(texts, 0)::BIGINT AS n_texts, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN placed p USING (doc_id) LEFT JOIN roots ON roots.a = p.rep LEFT JOIN links ON links.a = p.rep
"""
