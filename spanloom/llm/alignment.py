"""Alignment of two tokenizers over whole texts: distinct segments are tokenized and aligned once."""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import complete_groups, lean, partitions, release, scratch_mark, written

#: Distinct segments after which a task begins another chunk of documents.
SEGMENTS = 400_000
#: Bytes of groups that a task holds before it sends them back, a parcel a chunk.
PARCELS = 1 << 24
#: Larger groups are paired by their distinct ids.
LARGE = 4096
# A cut lies before one of these characters, behind anything that no standard calls white space.
CUT = re.compile(r"(?=[ \n])(?<=\S)")
_CROSSES = re.compile(r"\S[ \n]")
DOC, OTHER = 0, 1


def segments(text: str) -> list[str]:
    """The text behind a space, cut before its runs of white space. Null and empty texts have none."""
    return CUT.split(f" {text}") if text else []


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Two tokenizers, A of byte-level entries and B of pieces, that never join across a cut."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = _byte_alphabet()
        self.bytes_a = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = pieces.index("▁")
        joined = [t for t in (*self.bytes_a.values(), *self.bytes_b) if _CROSSES.search(t.decode(errors="replace"))]
        joined += [t for t in self.bytes_b if t.startswith(b" ") and b"\n" in t]  # the space that B adds must stay apart
        if joined:
            raise ValueError(f"entries join across a cut: {joined[:3]}")

    def ids_b(self, parts: list[str]) -> list[list[int]]:
        """B's ids of segments. B adds a space, which stands for a segment's own first one."""
        made = self.b.encode([s[1:] if s[0] == " " else s for s in parts], num_threads=1)
        return [ids if s[0] == " " and len(s) > 1 else [self.space] if s == " " else ids[1:] for s, ids in zip(parts, made, strict=True)]

    def aligned(self, parts: list[str]) -> list[str]:
        """Groups of segments, ``a1,a2|b1;a3|b2``; an empty string where ids don't give a segment's bytes back."""
        out = []
        for s, x, b in zip(parts, self.a.encode_batch_fast(parts, add_special_tokens=False), self.ids_b(parts), strict=True):
            a, raw = x.ids, s.encode()
            of_a, of_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
            if b"".join(of_a) != raw or b"".join(of_b) != raw:
                out.append("")
            elif len(a) == 1 or len(b) == 1:
                out.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
            else:
                out.append(grouped(a, b, list(accumulate(map(len, of_a))), list(accumulate(map(len, of_b)))))
        return out


def grouped(a: list[int], b: list[int], ends_a: list[int], ends_b: list[int]) -> str:
    """Ids cut where both end."""
    at_b = {e: j + 1 for j, e in enumerate(ends_b)}
    made, i0, j0 = [], 0, 0
    for i, e in enumerate(ends_a, 1):
        if j := at_b.get(e):
            made.append(f"{','.join(map(str, a[i0:i]))}|{','.join(map(str, b[j0:j]))}")
            i0, j0 = i, j
    return ";".join(made)


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _squeezed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(np.concatenate(arrays).astype("<i4").tobytes(), 1) if sum(map(len, arrays)) else b""


def _unsqueezed(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), dtype="<i4") if raw else np.zeros(0, dtype=np.int32)


def _cut(most: int):
    """Documents as numbers of segments, and each chunk's distinct segments behind its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        seen: defaultdict[str, int] = defaultdict()
        seen.default_factory = seen.__len__

        def flushed() -> Iterator[pa.RecordBatch]:
            names = list(seen)
            for low in range(0, len(names), 50_000):
                part = names[low : low + 50_000]
                k = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, chunk)), pa.array(np.full(k, OTHER, np.int32)), pa.array(np.arange(low, low + k, dtype=np.int32)), pa.nulls(k, kind), pa.array(part, pa.string()), pa.nulls(k, pa.binary())], _CUT)
            seen.clear()

        kind = None
        for batch in batches:
            kind = batch.column("id").type
            size = 0
            packed: list[bytes] = []
            low = 0
            texts = batch.column("text")
            for i in range(len(texts)):
                parts = segments(texts[i].as_py())
                packed.append(_squeezed(np.fromiter(map(seen.__getitem__, parts), np.int32, len(parts))))
                size += len(packed[-1])
                full = len(seen) >= most
                if full or size > 1 << 22 or i + 1 == len(texts):
                    k = len(packed)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, chunk)), pa.array(np.full(k, DOC, np.int32)), pa.array(np.arange(k, dtype=np.int32)), batch.column("id").slice(low, k), pa.nulls(k, pa.string()), pa.array(packed, pa.binary())], _CUT)
                    packed, low, size = [], i + 1, 0
                if full:
                    yield from flushed()
                    chunk += 1
        if seen:
            yield from flushed()

    return run


_CUT = ["chunk", "kind", "no", "id", "segment", "data"]


def _aligned(path_a: str, path_b: str):
    """Uses of segments, sorted by segment, to parcels of groups for each chunk: a segment is aligned when it first comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(path_a, path_b)
        last, its, size = None, b"", 0
        held: defaultdict[int, tuple[list[int], list[bytes]]] = defaultdict(lambda: ([], []))

        def parcels() -> pa.RecordBatch:
            made = [parcel(*x) for x in held.values()]
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(made, pa.binary())], ["chunk", "data"])
            held.clear()
            return out

        for batch in batches:
            column = batch.column("segment").to_pylist()
            new = list(dict.fromkeys(s for s in column if s != last))
            found = dict(zip(new, map(str.encode, pair.aligned(new)), strict=True)) if new else {}
            if last is not None:
                found.setdefault(last, its)
            if column:
                last = column[-1]
                its = found[last]
            for chunk, no, s in zip(batch.column("chunk").to_pylist(), batch.column("no").to_pylist(), column, strict=True):
                numbers, groups = held[chunk]
                numbers.append(no)
                groups.append(found[s])
                size += len(groups[-1]) + 8
            if size > PARCELS:
                yield parcels()
                size = 0
        if held:
            yield parcels()

    return run


def parcel(numbers: list[int], groups: list[bytes]) -> bytes:
    return zstandard.compress(np.array([len(numbers), *numbers], dtype="<i4").tobytes() + b"\n".join(groups), 3)


def unparcelled(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    plain = zstandard.decompress(raw)
    n = int(np.frombuffer(plain, dtype="<i4", count=1)[0])
    return np.frombuffer(plain, dtype="<i4", count=n, offset=4), plain[4 * n + 4 :].split(b"\n")


class Chunk:
    """A chunk's segments with their groups: counts of each, and links as numbers of the chunk's distinct pairs."""

    def __init__(self, parcels: list[bytes]):
        taken = [unparcelled(x) for x in parcels]
        n = sum(len(x) for x, _ in taken)
        self.groups: list[bytes] = [b""] * n
        self.bad = np.zeros(n, dtype=bool)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, dtype=np.int64) for _ in range(4))
        links = [self._add(*x) for x in taken] or [(np.zeros(0, np.int64),) * 3]
        owner, key, self.count = map(np.concatenate, zip(*links, strict=True))
        order = np.argsort(owner, kind="stable")
        owner, key, self.count = owner[order], key[order], self.count[order]
        self.pairs, link = np.unique(key, return_inverse=True)
        self.link = link.astype(np.int32)
        self.first = np.searchsorted(owner, np.arange(n + 1))

    def _add(self, numbers: np.ndarray, groups: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take in a parcel; its links: the segment, the pair and how often it is linked there."""
        for no, g in zip(numbers.tolist(), groups, strict=True):
            self.groups[no] = g
        bad = np.array([not g for g in groups])
        self.bad[numbers[bad]] = True
        numbers, groups = numbers[~bad], [g for g in groups if g]
        raw = np.frombuffer(b";".join(groups) + b";" if groups else b"", dtype=np.uint8)
        digit = (raw >= 48) & (raw <= 57)
        sign = raw[~digit]
        value = np.fromstring(np.where(digit, raw, np.uint8(32)).tobytes(), dtype=np.int64, sep=" ") if len(raw) else np.zeros(0, np.int64)
        group = np.r_[0, np.cumsum(sign == ord(";"))[:-1]] if len(sign) else np.zeros(0, np.int64)
        is_b = np.r_[0, np.cumsum(sign == ord("|"))[:-1]] > group if len(sign) else np.zeros(0, bool)
        n_group = int(group[-1]) + 1 if len(group) else 0
        n_a, n_b = np.bincount(group[~is_b], minlength=n_group), np.bincount(group[is_b], minlength=n_group)
        of = np.repeat(numbers, [g.count(b";") + 1 for g in groups])
        for total, x in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, np.ones(n_group, np.int64)), (self.n_links, n_a * n_b)):
            np.add.at(total, of, x)
        a, b, g_of_a = value[~is_b], value[is_b], group[~is_b]
        from_a, from_b = np.r_[0, np.cumsum(n_a)], np.r_[0, np.cumsum(n_b)]
        small = n_a * n_b <= LARGE
        take = small[g_of_a]
        times = n_b[g_of_a[take]]
        place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        keys = [np.repeat(a[take], times) << 32 | b[np.repeat(from_b[g_of_a[take]], times) + place]]
        owners, counts = [of[np.repeat(g_of_a[take], times)].astype(np.int64)], [np.ones(len(place), dtype=np.int64)]
        for g in np.flatnonzero(~small):
            (ua, ca), (ub, cb) = np.unique(a[from_a[g] : from_a[g + 1]], return_counts=True), np.unique(b[from_b[g] : from_b[g + 1]], return_counts=True)
            keys.append((ua[:, None] << 32 | ub[None, :]).ravel())
            counts.append((ca[:, None] * cb[None, :]).ravel())
            owners.append(np.full(len(keys[-1]), of[g], dtype=np.int64))
        return tuple(map(np.concatenate, (owners, keys, counts)))

    def links(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of a document's segments, and how many links each has."""
        distinct, times = np.unique(numbers, return_counts=True)
        low, many = self.first[distinct], self.first[distinct + 1] - self.first[distinct]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        weight = self.count[at] * np.repeat(times, many)
        found, place = np.unique(self.link[at], return_inverse=True)
        return found, np.bincount(place, weights=weight, minlength=len(found)).astype(np.int64)


def _composed(digest: bool):
    """Chunks of documents and groups to documents with their links, and pairs with how many of a chunk's documents hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers.cache_clear()
        for table, bound in complete_groups(batches, "chunk"):
            for low, high in zip(bound[:-1], bound[1:], strict=True):
                whole = table.slice(low, high - low).combine_chunks()
                chunk = whole.column("chunk")[0].as_py()
                is_doc = whole.column("kind").to_numpy() == DOC
                docs, rest = whole.filter(pa.array(is_doc)), whole.filter(pa.array(~is_doc))
                made = Chunk(rest.column("data").to_pylist()) if len(rest) else None
                held = np.zeros(len(made.pairs) if made else 0, dtype=np.int64)
                rows, size = [], 0
                for i, raw in enumerate(docs.column("data")):
                    numbers = _unsqueezed(raw.as_py())
                    if not len(numbers) or made.bad[numbers].any():
                        rows.append((0, 0, 0, 0, "", b""))
                    else:
                        pairs, times = made.links(numbers)
                        held[pairs] += 1
                        text = b";".join([made.groups[j] for j in numbers.tolist()])
                        shown = hashlib.sha256(text).hexdigest() if digest else text.decode()
                        big = times.max() >= 1 << 31
                        packed = zstandard.compress(np.r_[pairs, times].astype("<i8").tobytes(), 1) if big else _squeezed(pairs, times)
                        rows.append((*(int(x[numbers].sum()) for x in (made.n_a, made.n_b, made.n_groups, made.n_links)), shown, packed))
                        size += len(packed) + len(shown)
                    if size > 1 << 23 or i + 1 == len(docs):
                        k, first = len(rows), i + 1 - len(rows)
                        columns = list(zip(*rows, strict=True))
                        longs = [pa.array(c, pa.int64()) for c in columns[:4]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, chunk)), pa.array(np.full(k, DOC, np.int32)), pa.nulls(k, pa.int32()), docs.column("id").slice(first, k).combine_chunks(), *longs, pa.array(columns[4], pa.string()), pa.array(columns[5], pa.binary()), *[pa.nulls(k, pa.int64())] * 3], _COMPOSED)
                        rows, size = [], 0
                for at in range(0, len(held), 50_000):
                    k = min(50_000, len(held) - at)
                    key = made.pairs[at : at + k]
                    told = [pa.array(x.astype(np.int64)) for x in (key >> 32, key & 0xFFFFFFFF, held[at : at + k])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(k, chunk)), pa.array(np.full(k, OTHER, np.int32)), pa.array(np.arange(at, at + k, dtype=np.int32)), pa.nulls(k, docs.schema.field("id").type), *[pa.nulls(k, pa.int64())] * 4, pa.nulls(k, pa.string()), pa.nulls(k, pa.binary()), *told], _COMPOSED)

    return run


_COMPOSED = ["chunk", "kind", "no", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "data", "a", "b", "docs"]


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their links' counts, added up, and how many are their A id's best."""
    for table, bound in complete_groups(batches, "chunk"):
        for low, high in zip(bound[:-1], bound[1:], strict=True):
            whole = table.slice(low, high - low).combine_chunks()
            is_doc = whole.column("kind").to_numpy() == DOC
            docs, rest = whole.filter(pa.array(is_doc)), whole.filter(pa.array(~is_doc))
            count, best = np.zeros(len(rest), dtype=np.int64), np.zeros(len(rest), dtype=np.int64)
            number = rest.column("no").to_numpy()
            count[number], best[number] = rest.column("count").to_numpy(), rest.column("best").to_numpy()
            total, top = [], []
            for raw, n_links in zip(docs.column("data"), docs.column("n_links").to_pylist(), strict=True):
                if not n_links:
                    total.append(0)
                    top.append(0)
                    continue
                plain = zstandard.decompress(raw.as_py())
                both = np.frombuffer(plain, dtype="<i4")
                if both[len(both) // 2 :].sum(dtype=np.int64) != n_links:  # a pair with more than 2**31 links
                    both = np.frombuffer(plain, dtype="<i8")
                pairs, times = both[: len(both) // 2], both[len(both) // 2 :].astype(np.int64)
                total.append(int((count[pairs] * times).sum()))
                top.append(int((best[pairs] * times).sum()))
            if len(docs):
                keep = [docs.column(c).combine_chunks() for c in ("id", "n_a", "n_b", "n_groups", "n_links", "groups")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(top, pa.int64()), pa.array(total, pa.int64())], ["id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"])


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, most: int = SEGMENTS) -> DataFrame:
    """Align A's and B's ids over each text behind a space.

    Returns ``id_col``, n_a, n_b, n_groups, n_links, groups, n_best and count_sum, a row a document. Ids
    are grouped between the places where tokens of both end: ``a1,a2|b1;a3|b2``, or with ``digest``
    the SHA-256 of that. Every A occurrence of a group is linked to every B occurrence. A
    pair's count is the number of documents that hold it linked; n_best counts links whose
    count is the highest of their A id, count_sum adds counts up over links.

    Texts are cut before runs of white space, where the vocabularies hold no entry that reaches across (checked when
    they are loaded). A task numbers the distinct segments of the documents it reads, a chunk, so documents become
    lists of numbers. Chunks' segments meet by segment: each distinct one is tokenized and aligned
    once in all, and its groups go back to each chunk that has it, where documents are composed. Counts of pairs take the
    same way. A task holds a chunk, of ``most`` distinct segments at about, and one document more.

    Null and empty texts, and texts whose ids of either side don't give their bytes back, have no ids: zeros and
    an empty string. Rows that repeat an id are separate documents; other columns don't matter; an empty table gives no rows.
    """
    spark, since = docs.sparkSession, scratch_mark()
    kind = docs.schema[id_col].dataType.simpleString()
    n = partitions(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = written(rows.mapInArrow(lean(_cut(most)), f"chunk long, kind int, no int, id {kind}, segment string, data binary"), "segments")
    uses = cut.where(F.col("kind") == OTHER).select("chunk", "no", "segment").repartition(n, "segment").sortWithinPartitions("segment")
    told = uses.mapInArrow(lean(_aligned(path_a, path_b)), "chunk long, data binary")
    back = told.select("chunk", F.lit(OTHER).alias("kind"), F.lit(0).alias("no"), F.lit(None).cast(kind).alias("id"), "data")
    chunks = cut.where(F.col("kind") == DOC).select("chunk", "kind", "no", "id", "data").unionByName(back)
    chunks = chunks.repartition(n, "chunk").sortWithinPartitions("chunk", "kind", "no")
    fields = f"chunk long, kind int, no int, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, data binary, a long, b long, docs long"
    made = written(chunks.mapInArrow(lean(_composed(digest)), fields), "composed")
    release(spark, since)
    held = made.where(F.col("kind") == OTHER).select("chunk", "no", "a", "b", "docs")
    counts = held.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    counts = written(counts, "counts")
    most_of = counts.groupBy("a").agg(F.max("count").alias("top"))
    counts = counts.join(most_of, "a").select("a", "b", "count", (F.col("count") == F.col("top")).cast("long").alias("best"))
    names = ["chunk", "kind", "no", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "data", "count", "best"]
    scored = held.join(counts, ["a", "b"]).select("chunk", F.lit(OTHER).alias("kind"), "no", "count", "best")
    both = made.where(F.col("kind") == DOC).select(*names[:10]).unionByName(scored, allowMissingColumns=True).select(*names)
    both = both.repartition(n, "chunk").sortWithinPartitions("chunk", "kind", "no")
    out = both.mapInArrow(lean(_scored), f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")
    return out.withColumnRenamed("id", id_col)


def op13(spark, sf_dir: str) -> DataFrame:
    """All documents by the byte-level tokenizer (A) and the tokenizer of pieces (B)."""
    import public_tokenizers

    paths = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    made = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), *paths, digest=True)
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
