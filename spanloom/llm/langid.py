"""Language identification by error-correcting output codes over n-gram classifiers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import lean, written
from spanloom.llm.shingles import normalized

ORDERS = (2, 3, 4)
BITS = 16
#: Labelled rows learned from, in each language: all, or about this many (a hash of the id decides).
SAMPLE = 1500
#: A prediction is ambiguous if its score leads the second language's by less.
LEAD = 0.2
SLICE_BYTES = 1 << 18
#: A longer text is read in pieces of so many bytes; so many n-grams are weighed at once.
PIECE, WEIGHED = 1 << 22, 1 << 20
#: N-grams of a range, as counts are added up.
SPAN = 1 << 12
UNKNOWN = "und"


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """One row of -1 and 1 a language. Up to five languages: all splits; more: the best-spaced of random codes."""
    if languages <= 1:
        return np.ones((languages, 0))
    if languages <= 5:
        splits = np.arange(1, 1 << (languages - 1))
        bits = (splits[None, :] >> np.arange(languages)[:, None]) & 1
        return np.where(bits, 1.0, -1.0)
    rng, width = np.random.default_rng(seed), int(np.ceil(10 * np.log2(languages)))
    best, far = None, -1.0
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (languages, width))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        gap = (code.shape[1] - code @ code.T) / 2 + np.eye(languages) * width
        if gap.min() > far:
            best, far = code, gap.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # hashed n-grams x bits
    trust: np.ndarray  # of each bit, from how far its classes are apart


def _text_slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    if not len(texts):
        return iter(())
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1), len(texts)]
    return zip(cuts[:-1], cuts[1:], strict=True)


def _spread(h: np.ndarray, order: int) -> np.ndarray:
    return ((h + np.uint32(order)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def _long_grams(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same n-grams of one padded text, a piece at a time."""
    for at in range(0, len(data), PIECE):
        for order in ORDERS:
            part = data[at : at + PIECE + order - 1].astype(np.uint32)
            h = np.zeros(max(len(part) - order + 1, 0), dtype=np.uint32)
            for k in range(order):
                h = (h * np.uint32(0x01000193)) ^ part[k : k + len(h)]
            yield _spread(h, order), np.array([0, len(h)])


def _grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed n-grams of texts padded by spaces, and how many of them lie before each text's end, for each order."""
    edge, gap = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    padded = pc.binary_join_element_wise(edge, texts, edge, gap)
    offsets = np.frombuffer(padded.buffers()[1], dtype=np.int64)[padded.offset : padded.offset + len(padded) + 1]
    data = np.frombuffer(padded.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    if len(texts) == 1 and len(data) > PIECE:
        yield from _long_grams(data)
        return
    data = data.astype(np.uint32)
    bound = offsets - offsets[0]
    h = np.zeros(len(data), dtype=np.uint32)
    for order in range(1, max(ORDERS) + 1):
        if len(data) >= order:
            h = (h[: len(data) - order + 1] * np.uint32(0x01000193)) ^ data[order - 1 :]
        else:
            h = h[:0]
        if order in ORDERS:
            spread = _spread(h, order)
            # n-grams begin in their text; those that reach past its end are left out
            first, last = bound[:-1], np.maximum(bound[1:] - order + 1, bound[:-1])
            inside = np.zeros(len(data) + 1, dtype=np.int32)
            np.add.at(inside, first, 1)
            np.add.at(inside, last, -1)
            keep = np.cumsum(inside)[: len(spread)] > 0
            yield spread[keep], np.r_[0, np.cumsum(last - first)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        texts = normalized(batch.column("text"))
        for lang in dict.fromkeys(langs):
            own = texts.take(pa.array(np.flatnonzero(langs == lang)))
            total = counts.setdefault(lang, np.zeros(1 << BITS, dtype=np.int64))
            for a, b in _text_slices(own):
                for grams, _ in _grams(own.slice(a, b - a)):
                    total += np.bincount(grams, minlength=1 << BITS)
    for lang, total in counts.items():
        parts = [total[i : i + SPAN] for i in range(0, 1 << BITS, SPAN)]
        k = len(parts)
        columns = [pa.array([lang] * k), pa.array(range(k), pa.int32()), pa.array([int(x.sum()) for x in parts], pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "span", "total", "counts"])


def _weighed(names: list[str], totals: np.ndarray, code: np.ndarray):
    """Ranges of n-grams with each language's counts to the sums of its chances on either side of each bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(names)}
        held, total = None, np.zeros((len(names), SPAN))

        def told() -> pa.RecordBatch:
            chance = (total + 0.5) / (totals[:, None] + 0.5 * (1 << BITS))
            sides = [(side.T @ chance).tobytes() for side in (code > 0, code < 0)]
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), *[pa.array([x], pa.binary()) for x in sides]], ["span", "up", "down"])

        for batch in batches:
            for span, name, raw in zip(*(batch.column(c).to_pylist() for c in ("span", "lang", "counts")), strict=True):
                if span != held:
                    if held is not None:
                        yield told()
                    held, total = span, np.zeros((len(names), SPAN))
                total[number[name]] += np.frombuffer(raw, dtype=np.int64)
        if held is not None:
            yield told()

    return run


def fit(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> Model:
    """Learn from rows with a text and a language, at most about ``sample`` of each language; all languages are learned.

    A hash of the id chooses the rows, so the same rows are chosen at every layout. N-gram counts are added up on the
    executors, a range of n-grams a row; what reaches the driver is a number a language, and the weights of the
    bits, of which there are ten for each doubling of the languages. Each bit's classifier is a naive-Bayes log ratio between
    the languages on either side of the split, all languages weighing alike.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    mark = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), 1, 10), 16, 10).cast("long")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    limit = F.floor(F.lit(float(1 << 40)) * F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n")))
    # a short row a language, as the driver gets below: texts stay where they are until they are chosen
    chosen = rows.join(F.broadcast(sizes.select("lang", limit.alias("limit"))), "lang").where(mark < F.col("limit"))
    chosen = chosen.repartition(8, "id").coalesce(8)  # at most eight tasks, however finely the shuffle deals
    tasks = written(chosen.select("text", "lang").mapInArrow(lean(_counted), "lang string, span int, total long, counts binary"), "grams")
    found = tasks.groupBy("lang").agg(F.sum("total").alias("n")).orderBy("lang").collect()  # a number a language
    languages, totals = [r[0] for r in found], np.array([r[1] for r in found], dtype=np.float64)
    code = codewords(len(languages))
    weights, spans = np.zeros((1 << BITS, code.shape[1]), dtype=np.float32), (1 << BITS) // SPAN
    apart = np.zeros(code.shape[1])
    per = tasks.repartition(8, "span").sortWithinPartitions("span").mapInArrow(lean(_weighed(languages, totals, code)), "span int, up binary, down binary")
    sides = [np.maximum((code * s > 0).sum(axis=0), 1)[:, None] for s in (1, -1)]
    seen = per.collect() if code.shape[1] else []  # the weights, range by range
    for r in seen:
        up, down = (np.frombuffer(x, dtype=np.float64).reshape(-1, SPAN) / n for x, n in zip((r.up, r.down), sides, strict=True))
        ratio = np.log(up) - np.log(down)
        apart += ((up - down) * ratio).sum(axis=1) / 2
        weights[r.span * SPAN : (r.span + 1) * SPAN] = ratio.T
    assert len(seen) in (0, spans)
    return Model(languages, code, weights, apart / max(apart.sum(), 1e-12))


def _add(sums: np.ndarray, weights: np.ndarray, grams: np.ndarray, bound: np.ndarray) -> None:
    """Add the weights of each text's n-grams to its row, WEIGHED n-grams at a time."""
    for low in range(0, len(grams), WEIGHED):
        high = min(low + WEIGHED, len(grams))
        first, last = np.clip(bound[:-1], low, high), np.clip(bound[1:], low, high)
        some = np.flatnonzero(last > first)
        sums[some] += np.add.reduceat(weights[grams[low:high]], first[some] - low, axis=0)


def _decoded(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language's index, its score and its lead, of normalised texts."""
    n, bits = len(texts), model.code.shape[1]
    sums, seen = np.zeros((n, bits)), np.zeros(n)
    for a, b in _text_slices(texts):
        for grams, bound in _grams(texts.slice(a, b - a)):
            full = np.flatnonzero(np.diff(bound))
            if len(full):
                _add(sums[a:b], model.weights, grams, bound)
            seen[a:b] += np.diff(bound)
    margin = np.clip(sums / np.sqrt(np.maximum(seen, 1))[:, None], -40, 40)
    loss = (np.log1p(np.exp(-margin[:, None, :] * model.code[None, :, :])) * model.trust).sum(axis=2)
    odds = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * max(bits, 1))
    odds /= odds.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    score = odds[np.arange(n), best]
    second = np.sort(odds, axis=1)[:, -2] if len(model.languages) > 1 else np.zeros(n)
    return best, score, score - second


def predict(df: DataFrame, model: Model, text_col: str = "text", lead: float = LEAD) -> DataFrame:
    """All rows and columns of ``df`` with lang_pred, score (0 to 1) and ambiguous added.

    Loss-weighted decoding: each language's codeword costs the logistic loss of every
    bit's margin, weighted by the bit's trust, and the cheapest wins; ties go to the
    first language by name. ``ambiguous`` tells that the score's lead over the second language is below ``lead``.
    Texts that are null or hold no letter give ``und``, score 0, not ambiguous; so
    does every text if nothing was learned. Whole texts are read. Columns of ``df``
    named like the new ones are replaced. An empty table gives no rows.
    """
    new = ["lang_pred", "score", "ambiguous"]
    df = df.drop(*new)
    names, where = df.columns, df.columns.index(text_col)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where)
            known = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False).astype(bool)
            n = batch.num_rows
            lang, score, unsure = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.zeros(n, dtype=bool)
            rows = np.flatnonzero(known)
            if len(rows) and model.languages:
                best, sure, gap = _decoded(normalized(texts.take(pa.array(rows))), model)
                lang[rows], score[rows], unsure[rows] = np.array(model.languages, dtype=object)[best], sure, gap < lead
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], [*names, *new])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "lang_pred string, score double, ambiguous boolean"])
    return df.mapInArrow(lean(told), fields)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning: those whose id's text has a CRC-32 of 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a quarter of the ids is held out of learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()), "doc_id", "text", "lang")
    made = predict(docs.select("doc_id", "text"), model)
    return made.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
