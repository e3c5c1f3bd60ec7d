"""Spelling variants: words one edit apart, found by merging light subtrees of their trie."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import complete_groups, lean, partitions, written

#: A word has so many characters and occurs so often, at least; a form occurs so many times as often as its variant.
LEAST_CHARS, LEAST_COUNT, RATIO = 7, 2, 10
#: One text position in so many loses a character, by its checksum.
ONE_IN = 31
#: Words of a range, about; a range is the share of one task.
RANGE = 100_000

_UPPER = "".join(map(chr, range(65, 91)))
_RUN = "[a-zÀ-ÿ]"
#: Stands for a replaced character; no word holds it.
ANY = "*"


def lexicon(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = LEAST_CHARS, count: int = LEAST_COUNT) -> DataFrame:
    """Words of whole texts and how often they occur: word and n.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. Where ONE_IN divides
    the checksum of ``<id>:<run>``, the run's character at checksum modulo length is left out; a null id counts as empty.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _UPPER.lower())
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"{_RUN}{{{chars},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % ONE_IN == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def shared(a: str, b: str) -> int:
    """Characters that two words begin with alike."""
    n = min(len(a), len(b))
    x, y = (np.frombuffer(w[:n].encode("utf-32-le"), dtype=np.uint32) for w in (a, b))
    return int(np.argmax(np.r_[x != y, True]))


@dataclass
class Bounds:
    """What neighbouring ranges of sorted words have in common."""

    lcp: list[int]  # of the last word of each range and the first of the next
    heavy: dict[tuple[int, int], int] = field(default_factory=dict)  # of nodes that lie in more ranges than one

    def node(self, boundary: int, depth: int) -> tuple[int, int]:
        """The name of the node of so many characters that lies on both sides of a boundary: its first boundary, its depth."""
        while boundary and self.lcp[boundary - 1] >= depth:
            boundary -= 1
        return boundary, depth


class Range:
    """A range of sorted distinct words as a part of the trie, walked depth by depth."""

    def __init__(self, words: list[str], number: int, bounds: Bounds):
        self.words, self.number, self.bounds = words, number, bounds
        self.size = np.array([len(w) for w in words])
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        self.at = np.r_[0, np.cumsum(self.size)]
        self.left = bounds.lcp[number - 1] if number else -1
        self.right = bounds.lcp[number] if number < len(bounds.lcp) else -1

    def levels(self) -> Iterator[tuple]:
        """For each depth: the words below nodes of two words or more, their next characters, and where nodes and children begin.

        A word that ends at a node is a child of its own, with the character 0. Also tells
        which of the nodes goes on in the range before, and in the one behind, if any.
        """
        active, node, depth = np.arange(len(self.words)), np.zeros(len(self.words), dtype=np.int64), 0
        while len(active):
            ends = self.size[active] == depth
            char = np.where(ends, 0, self.codes[np.minimum(self.at[active] + depth, max(len(self.codes) - 1, 0))])
            fresh = np.r_[True, node[1:] != node[:-1]]
            child = fresh | np.r_[True, char[1:] != char[:-1]]
            before = depth <= self.left and active[0] == 0
            behind = depth <= self.right and active[-1] == len(self.words) - 1
            yield depth, active, char, np.flatnonzero(fresh), np.flatnonzero(child), before, behind
            depth += 1
            first, count = np.flatnonzero(child), np.diff(np.r_[np.flatnonzero(child), len(active)])
            stays = count > 1
            if depth <= self.left and len(first) and active[0] == 0:
                stays[0] = True
            if depth <= self.right and len(first) and active[-1] == len(self.words) - 1:
                stays[-1] = True
            number = np.cumsum(child) - 1
            keep = stays[number] & ~ends
            active, node = active[keep], number[keep]

    def crossing(self) -> Iterator[tuple[int, int, int, int]]:
        """How many words each child of a crossing node has here: boundary, depth, character, count."""
        for depth, active, char, nodes, children, before, behind in self.levels():
            if not before and not behind:
                break
            count = np.diff(np.r_[children, len(active)])
            sides = [(self.number - 1, 0, nodes[1] if len(nodes) > 1 else len(active))] if before else []
            if behind and not (before and len(nodes) == 1):
                sides.append((self.number, nodes[-1], len(active)))
            for boundary, low, high in sides:
                name = self.bounds.node(boundary, depth)
                for c in np.flatnonzero((children >= low) & (children < high)):
                    yield (*name, int(char[children[c]]), int(count[c]))

    def light(self) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Light edges: for each depth the words that leave their heavy path there, and the character it goes on with."""
        for depth, active, char, nodes, children, before, behind in self.levels():
            count = np.diff(np.r_[children, len(active)])
            first = char[children]
            weight = np.where(first == 0, 0, count)
            owner = np.searchsorted(nodes, children, side="right") - 1
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            most = np.maximum.reduceat(weight, begin)
            wins = np.flatnonzero(weight == most[owner])
            best = wins[np.unique(owner[wins], return_index=True)[1]]  # of equal ones the smallest character
            heavy = first[best].copy()
            if before:
                heavy[0] = self.bounds.heavy[self.bounds.node(self.number - 1, depth)]
            if behind:
                heavy[-1] = self.bounds.heavy[self.bounds.node(self.number - 1 if before and len(nodes) == 1 else self.number, depth)]
            mine = heavy[np.searchsorted(nodes, np.arange(len(active)), side="right") - 1]
            off = (char != mine) & (mine != 0)
            if off.any():
                yield active[off], depth, mine[off]


def errata(word: str, depth: int, heavy: str, least: int) -> Iterator[tuple[str, bool]]:
    """What a word of a light subtree becomes when the subtree is merged: strings, and whether others must become them, too.

    With the character behind the node replaced, it may meet words of other light subtrees, which become the
    same, or a word of the heavy one. With the character skipped, it may be a word below the node; with
    the heavy character put in, one of the heavy subtree. Words that differ by one edit first differ
    behind one node, where one of them at least is in a light subtree: so each pair is met once.
    """
    head, tail = word[:depth], word[depth + 1 :]
    if depth < len(word):
        yield f"{head}{ANY}{tail}", True
        yield f"{head}{heavy}{tail}", False
        if len(word) > least and tail[:1] != word[depth]:
            yield head + tail, False
    yield f"{head}{heavy}{word[depth:]}", False


def _crossing(bounds: Bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _, number in _ranges(batches):
            found = list(Range(words, number, bounds).crossing())
            columns = [np.array([r[i] for r in found], dtype=np.int64) for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["boundary", "depth", "char", "n"])

    return run


def _light(bounds: Bounds, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, counts, number in _ranges(batches):
            for at, depth, heavy in Range(words, number, bounds).light():
                for low in range(0, len(at), 20_000):
                    made = [(k, w, i, o) for i, h in zip(at[low : low + 20_000].tolist(), heavy[low : low + 20_000].tolist(), strict=True) for w in (words[i],) for k, o in errata(w, depth, chr(h), least)]
                    keys, own, place, merged = zip(*made, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own), pa.array(counts[list(place)]), pa.array(merged)], ["key", "word", "n", "merged"])

    return run


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, int]]:
    for table, bound in complete_groups(batches, "part"):
        parts = table.column("part").to_numpy()
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            piece = table.slice(a, b - a)
            yield piece.column("word").to_pylist(), piece.column("n").to_numpy(), int(parts[a])


def near(words: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """Words and the words one edit away: word, n, n_near, best_n and best, its commonest near word.

    ``words`` has distinct words (no shorter than ``least``) and n. They are dealt into ranges of the
    sorted order, so a range is a part of the trie; of a node that lies in several ranges, its heavy
    child is found by adding up what each range has below it. What reaches the driver is two words a
    range and one entry for each prefix that neighbouring ranges share. Each word emits a few
    strings for each light edge on its path, of which there are log2(words) at most; a string that is a word, or
    that other light words emit, too, is a pair. So many words emit the same string as there are characters in use.
    """
    spark = words.sparkSession
    words = written(words.select("word", "n"), "words")
    n = max(partitions(spark), -(-words.count() // RANGE))
    dealt = written(words.repartitionByRange(n, "word").withColumn("part", F.spark_partition_id()), "dealt")
    ends = dealt.groupBy("part").agg(F.min("word").alias("low"), F.max("word").alias("high")).collect()  # two words a range
    ends.sort(key=lambda r: r.low)
    number = F.create_map(*[F.lit(x) for i, r in enumerate(ends) for x in (r.part, i)]) if ends else F.create_map(F.lit(0), F.lit(0))
    dealt = dealt.withColumn("part", F.element_at(number, F.col("part"))).repartition(n, "part").sortWithinPartitions("part", "word")
    bounds = Bounds([shared(a.high, b.low) for a, b in zip(ends, ends[1:], strict=False)])
    if bounds.lcp:
        crossing = dealt.mapInArrow(lean(_crossing(bounds)), "boundary long, depth long, char long, n long").where("char > 0")
        crossing = crossing.groupBy("boundary", "depth", "char").agg(F.sum("n").alias("n"))
        crossing = crossing.groupBy("boundary", "depth").agg(F.min_by("char", F.struct(-F.col("n"), "char")).alias("char"))
        bounds.heavy = {(r.boundary, r.depth): r.char for r in crossing.collect()}  # an entry a shared prefix
    made = written(dealt.mapInArrow(lean(_light(bounds, least)), "key string, word string, n long, merged boolean"), "errata")
    met = made.where(~F.col("merged")).join(words.select(F.col("word").alias("key"), F.col("n").alias("key_n")), "key")
    one = met.select("word", F.lit(1).cast("long").alias("k"), _rank("key_n", "key").alias("best"))
    two = met.select(F.col("key").alias("word"), F.lit(1).cast("long").alias("k"), _rank("n", "word").alias("best"))
    # each of a string's words replaces one character in the same place: no more than there are characters
    groups = made.where("merged").groupBy("key").agg(F.array_sort(F.collect_list(_rank("n", "word"))).alias("g")).where(F.size("g") > 1)
    rows = groups.select("g", F.posexplode("g").alias("i", "x"))
    three = rows.select("x.word", (F.size("g") - 1).cast("long").alias("k"), F.when(F.col("i") == 0, F.col("g")[1]).otherwise(F.col("g")[0]).alias("best"))
    return one.unionByName(two).unionByName(three).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def _rank(n: str, word: str) -> Column:
    """Orders by falling count, then by word."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("word"))


def variants(words: DataFrame, ratio: int = RATIO, least: int = LEAST_CHARS) -> DataFrame:
    """Each word with the form it is a variant of: word, form, root, n, n_near, form_n.

    The form is the commonest word one inserted, deleted or replaced character away (of equals the smallest),
    if it is ``ratio`` times as common; else null. The root is where following forms ends. Counts
    grow tenfold with each step, so forms are followed in a handful of doublings. No words give no rows.
    """
    words = written(words.select("word", "n"), "lexicon")
    found = written(words.join(near(words, least), "word", "left"), "near")
    big = -F.col("best.less") >= ratio * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(big, F.col("best.word")).alias("form"), F.when(big, -F.col("best.less")).alias("form_n"))
    links = written(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "forms")
    while True:
        step = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = written(links.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if not links.where("moved").limit(1).count():
            break
        links = links.drop("moved")
    return found.join(links.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark, sf_dir: str) -> DataFrame:
    """All words of seven characters or more of all documents, with their spelling variants.

    Null texts have no words; rows that repeat an id are separate texts; other columns don't matter.
    """
    return variants(lexicon(spark.read.parquet(f"{sf_dir}/documents.parquet")))


_CRC = "xor(list_reduce(list_transform(range(1, octet_length(encode({t})) + 1), lambda i: ('0x' || substr(hex(encode({t})), 2 * i - 1, 2))::BIGINT), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)::BIGINT"

OP12_SQL = rf"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{_UPPER}', '{_UPPER.lower()}') AS run FROM documents),
counted AS (SELECT id || ':' || run AS k, run, count(*) AS c FROM runs WHERE length(run) >= {LEAST_CHARS} GROUP BY id, run),
hashed AS (SELECT run, c, {_CRC.replace("{t}", "k")} AS h FROM counted, t),
cut AS (SELECT c, CASE WHEN h % {ONE_IN} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
places AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM words),
pairs AS (
  SELECT a.word, b.word AS other, b.n FROM (SELECT word, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS k FROM places) a
  JOIN (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS k FROM places) b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT p.word, w.word, w.n FROM places p JOIN words w ON w.word = substr(p.word, 1, i - 1) || substr(p.word, i + 1)
  UNION SELECT w.word, p.word, p.n FROM places p JOIN words w ON w.word = substr(p.word, 1, i - 1) || substr(p.word, i + 1)),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM pairs GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= {RATIO} * w.n THEN other END AS form, CASE WHEN other_n >= {RATIO} * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at, form AS next FROM formed UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN formed f ON f.word = walk.next)
SELECT f.word, form, walk.at AS root, n, n_near, form_n FROM formed f JOIN walk ON walk.word = f.word AND walk.next IS NULL
"""
