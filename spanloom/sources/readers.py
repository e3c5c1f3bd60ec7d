"""Readers that give documents as blocks."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions.text import WS, normalize_block
from spanloom.operators.blocks import is_noise, margin_band, reading_order, with_offsets
from spanloom.plans.settings import Settings

#: Bytes from which on a file is not read as a whole.
WHOLE = (1 << 31) - (1 << 20)
RAW = "doc_id string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double, text string"


def paragraphs(docs: DataFrame, *keep: str) -> DataFrame:
    """Texts (doc_id, text) cut at blank lines into normalized, non-empty blocks numbered from 0."""
    plain = F.regexp_replace("text", "\r\n?", "\n")
    parts = F.transform(F.split(plain, rf"\n{WS}*\n", -1), normalize_block)
    return docs.select("doc_id", *keep, F.posexplode(F.filter(parts, lambda p: F.length(p) > 0)).alias("block_no", "text"))


def read_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Blocks of UTF-8 text files; doc_id is the path, doc_hash the hash of the bytes. Other bytes are an error.

    Files with equal bytes are documents of their own, with equal hashes. A file is read by lines, in as many byte
    ranges as Spark deals it into. Blank lines are counted in each range and added up over ranges, so
    each line knows its paragraph, and a paragraph on a border is put together from both sides. Files
    are hashed in a pass of their own; one of 2 GB or more, which Spark can't read as a whole, by the hashes of its blocks.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("line"),
        F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.raise_error(F.lit("a file is not UTF-8"))).alias("value"),
    )
    blank = F.col("value").rlike(rf"^{WS}*\z").cast("long")
    order = Window.partitionBy("doc_id", "range").orderBy("line")
    lines = lines.withColumn("blank", blank)
    before = Window.partitionBy("doc_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = lines.groupBy("doc_id", "range").agg(F.sum("blank").alias("n")).select("doc_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = lines.withColumn("in", F.sum("blank").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("blank = 0").join(ranges, ["doc_id", "range"])
    parts = placed.groupBy("doc_id", (F.col("before") + F.col("in")).alias("ord")).agg(F.array_sort(F.collect_list(F.struct("range", "line", "value"))).alias("l"))
    text = normalize_block(F.array_join(F.transform("l", lambda x: x["value"]), "\n"))
    made = with_offsets(parts.select("doc_id", F.lit(1).alias("page"), "ord", text.alias("text")).where(F.length("text") > 0))
    made = made.withColumn("block_no", F.col("block_idx").cast("int"))
    files = spark.read.format("binaryFile").load(paths)
    files = files.where(F.col("length") < WHOLE).select(F.col("path").alias("doc_id"), F.sha2("content", 256).alias("whole"))
    parted = made.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", F.sha2("text", 256).alias("h")))), lambda x: x["h"]), ""), 256).alias("parted"))
    hashes = parted.join(files, "doc_id", "left").select("doc_id", F.coalesce("whole", "parted").alias("doc_hash"))
    return made.join(hashes, "doc_id").withColumn("path", F.col("doc_id"))


def quarantine(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Files (path, content) that are valid UTF-8, and those that are not, for corpora where one bad file must not fail the job."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    fine = F.is_valid_utf8(F.col("content").cast("string"))
    return files.where(fine), files.where(~fine)


def _in_range(raw: DataFrame, start_page: int | None, end_page: int | None) -> DataFrame:
    """Boxes of the pages in range, with the first and last page of the range in each document."""
    rows, first = raw, max(start_page or 1, 1)
    if start_page is not None:
        rows = rows.where(F.col("page") >= start_page)
    if end_page is not None:
        rows = rows.where(F.col("page") <= end_page)
    last = rows.groupBy("doc_id").agg(F.max("page").cast("int").alias("last_page"))
    return rows.join(last, "doc_id").withColumn("first_page", F.lit(first))


def cleaning_counts(
    raw: DataFrame, drop_margins: bool = True, patterns: tuple[str, ...] = (), start_page: int | None = None, end_page: int | None = None
) -> DataFrame:
    """Per document: boxes seen and removed, and how many of them a margin, or else a pattern or emptiness, removed."""
    rows = _in_range(raw, start_page, end_page).where("text IS NOT NULL").withColumn("text", normalize_block(F.col("text")))
    margin = (margin_band(F.col("y0"), F.col("y1"), F.col("page_h")) != "body") & F.lit(drop_margins)
    blank, noise = F.length("text") == 0, is_noise(F.col("text"), None, patterns)
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_blocks_seen"), F.count_if(margin | noise).alias("n_blocks_removed"),
        F.count_if(margin & ~blank).alias("margin_dropped"), F.count_if(~margin & noise & ~blank).alias("pattern_dropped"),
    )


def page_table(raw: DataFrame, blocks: DataFrame, start_page: int | None = None, end_page: int | None = None) -> DataFrame:
    """Every page in range, empty ones that have a row too: its size, and its kept blocks with their offsets."""
    sizes = _in_range(raw, start_page, end_page).groupBy("doc_id", "page").agg(F.max("page_w").alias("width"), F.max("page_h").alias("height"))
    kept = blocks.groupBy("doc_id", "page").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.count(F.lit(1)).alias("n_blocks"))
    return sizes.join(kept, ["doc_id", "page"], "left").na.fill(0, ["n_blocks"])


def page_offsets(
    raw: DataFrame, drop_margins: bool = True, patterns: tuple[str, ...] = (), start_page: int | None = None, end_page: int | None = None
) -> DataFrame:
    """The page table of ``from_raw_blocks`` with the same options, without its blocks.

    Where a page begins follows from how much text the pages before it kept, in whatever order it is read, so boxes are
    only summed up by page, and a document of many boxes is no group that a task sorts.
    """
    first = max(start_page or 1, 1)
    rows = raw if start_page is None else raw.where(F.col("page") >= start_page)
    rows = rows if end_page is None else rows.where(F.col("page") <= end_page)
    text, band = normalize_block(F.col("text")), margin_band(F.col("y0"), F.col("y1"), F.col("page_h"))
    rows = rows.select("doc_id", "page", "page_w", "page_h", text.alias("text"), band.alias("band"))
    kept = F.col("text").isNotNull() & ~is_noise(F.col("text"), F.col("band") if drop_margins else None, patterns)
    pages = rows.groupBy("doc_id", "page").agg(
        F.max("page_w").alias("width"), F.max("page_h").alias("height"), F.sum(F.when(kept, F.length("text") + 1)).alias("chars"), F.count_if(kept).alias("n_blocks"),
    )
    before = F.sum("chars").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(F.col("n_blocks") > 0, F.coalesce(before, F.lit(0)) + F.col("page") - first).cast("long")
    pages = pages.where("doc_id IS NOT NULL").withColumn("char_start", start)
    return pages.select("doc_id", "page", "width", "height", "char_start", (F.col("char_start") + F.col("chars") - 1).alias("char_end"), "n_blocks")


def from_raw_blocks(
    raw: DataFrame, detect_columns: bool = True, drop_margins: bool = True, patterns: tuple[str, ...] = (), start_page: int | None = None, end_page: int | None = None
) -> DataFrame:
    """Blocks from positioned boxes (RAW): page range, bands, reading order, noise filter, offsets.

    Offsets count from the range's first page, which is page 1 by default. A row without text
    stands for a page that has no boxes.
    """
    rows = _in_range(raw, start_page, end_page)
    rows = rows.withColumn("band", margin_band(F.col("y0"), F.col("y1"), F.col("page_h")))
    rows = rows.withColumn("_band", F.when(F.col("band") == "header", 0).when(F.col("band") == "body", 1).otherwise(2))
    if detect_columns:
        rows = reading_order(rows, ["doc_id", "page", "_band"], F.col("page_w"), "block_no")
        # only the body is read by column; margins go by top and left
        key = F.when(F.col("_band") == 1, F.struct(F.col("reading_idx").cast("double").alias("y0"), F.lit(0.0).alias("x0"))).otherwise(F.struct("y0", "x0"))
    else:
        key = F.struct("y0", "x0")
    rows = rows.withColumn("ord", F.struct("_band" if detect_columns else F.lit(0), key, "block_no"))
    rows = rows.withColumn("text", normalize_block(F.col("text")))
    band = F.col("band") if drop_margins else None
    kept = rows.where(F.col("text").isNotNull() & ~is_noise(F.col("text"), band, patterns))
    return with_offsets(kept.select("doc_id", "page", "ord", "block_no", "x0", "y0", "x1", "y1", "text", "first_page", "last_page"))


def read_pdf(spark: SparkSession, paths: str | list[str], start_page: int | None = None, end_page: int | None = None, **options) -> DataFrame:
    """Blocks of PDF files; needs the optional PyMuPDF parser on the executors. Only pages in range are parsed."""
    try:
        import fitz  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the optional PyMuPDF package; pass positioned boxes to from_raw_blocks instead") from e

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz as parser

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                with parser.open(stream=content, filetype="pdf") as pdf:
                    for n in range(max((start_page or 1) - 1, 0), min(end_page or len(pdf), len(pdf))):
                        page = pdf[n]
                        size = (page.rect.width, page.rect.height)
                        boxes = [(b[5], *(round(float(x), 2) for x in b[:4]), *size, b[4]) for b in page.get_text("blocks") if b[6] == 0]
                        rows += [(path, n + 1, *b) for b in boxes or [(None, None, None, None, None, *size, None)]]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in RAW.split(", ")])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    hashes = files.select(F.col("path").alias("doc_id"), F.sha2("content", 256).alias("doc_hash"))
    return from_raw_blocks(files.mapInPandas(parsed, RAW), start_page=start_page, end_page=end_page, **options).join(hashes, "doc_id")


def read(spark: SparkSession, path: str, start_page: int | None = None, end_page: int | None = None, **options) -> DataFrame:
    """Blocks of a file, by its suffix: .txt (pages don't apply) or .pdf. Margins and patterns go as the settings say."""
    suffix = PurePosixPath(path).suffix.lower()
    settings = Settings.of(spark)
    options = {"drop_margins": settings.drop_margin_blocks, "patterns": settings.patterns()} | options
    if suffix == ".txt":
        return read_text(spark, path)
    if suffix == ".pdf":
        return read_pdf(spark, path, start_page=start_page, end_page=end_page, **options)
    raise ValueError(f"unsupported file type: {suffix or 'no suffix'}")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Recorded calls, from Parquet or JSON lines; replaying them needs no model."""
    return spark.read.json(path) if PurePosixPath(path).suffix.lower() in (".json", ".jsonl") else spark.read.parquet(path)
