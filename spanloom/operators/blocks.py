"""Blocks: noise filters, margin bands, reading order, offsets, pages, documents and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import normalize_block, strip

HEADER, FOOTER = 0.07, 0.93
COLUMN_GAP, WIDE = 50.0, 0.6
#: Positions of a range, in lookups.
SPAN = 1 << 18
#: Blocks that are joined to a run before runs are joined to a text.
RUN = 1024


def margin_band(y0: Column, y1: Column, height: Column) -> Column:
    """header, footer or body; body where the page's height is missing or zero."""
    tall = F.coalesce(height, F.lit(0.0)) > 0
    return F.when(tall & (y1 < HEADER * height), "header").when(tall & (y0 > FOOTER * height), "footer").otherwise("body")


def is_noise(text: Column, band: Column | None = None, patterns: tuple[str, ...] = ()) -> Column:
    """Blocks to drop: blank, page numbers, short runs of digits and dots, margins if asked for, and full matches."""
    bare = strip(text)
    drop = (bare == "") | bare.rlike(r"^\d{1,4}\z") | ((F.length(bare) <= 3) & bare.rlike(r"^[\d.\-–—]+\z"))
    for pattern in patterns:
        drop = drop | bare.rlike(rf"^(?:{pattern})\z")
    return drop if band is None else drop | (band != "body")


def reading_order(df: DataFrame, keys: list[str], width: Column, position: str) -> DataFrame:
    """Body boxes (x0, y0, x1) by column, then top, then left: adds ``column`` and ``reading_idx``.

    Columns are runs of sorted left edges less than 50 apart; a box belongs to the
    nearest run's mean, wide boxes to the first. Ties go to the lower column and then
    to the earlier ``position``.
    """
    along = Window.partitionBy(*keys).orderBy("x0", position)
    edges = df.withColumn("_new", F.coalesce((F.col("x0") - F.lag("x0").over(along) > COLUMN_GAP).cast("int"), F.lit(0)))
    edges = edges.withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    centres = edges.groupBy(*keys, "_run").agg(F.avg("x0").alias("centre"))
    centres = centres.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_run", "centre"))).alias("_centres"))
    placed = df.join(centres, keys)
    nearest = F.array_min(F.transform("_centres", lambda c: F.struct(F.abs(c["centre"] - F.col("x0")).alias("d"), c["_run"].alias("run"))))["run"]
    placed = placed.withColumn("column", F.when(F.col("x1") - F.col("x0") > WIDE * width, 0).otherwise(nearest).cast("int")).drop("_centres")
    order = Window.partitionBy(*keys).orderBy("column", "y0", "x0", position)
    return placed.withColumn("reading_idx", (F.row_number().over(order) - 1).cast("int"))


def with_offsets(df: DataFrame, doc: str = "doc_id", page: str = "page", order: str = "ord") -> DataFrame:
    """Kept blocks with block_idx, page_block_idx, char_start and char_end in their document's text.

    Each block is followed by one line end, each page by one more, whether it kept a block or not.
    Pages count from the column ``first_page`` where there is one, else from the first that kept a block.
    """
    run = Window.partitionBy(doc).orderBy(page, order)
    first = F.col("first_page") if "first_page" in df.columns else F.min(page).over(Window.partitionBy(doc))
    before = F.coalesce(F.sum(F.length("text") + 1).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = (before + F.col(page) - first).cast("long")
    in_page = Window.partitionBy(doc, page).orderBy(order)
    out = df.withColumns({"block_idx": (F.row_number().over(run) - 1).cast("long"), "page_block_idx": (F.row_number().over(in_page) - 1).cast("int"), "char_start": start})
    return out.withColumn("char_end", F.col("char_start") + F.length("text"))


def normalized_blocks(df: DataFrame) -> DataFrame:
    """Blocks whose normalized text is not empty."""
    return df.withColumn("text", normalize_block(F.col("text"))).where(F.length("text") > 0)


def page_spans(blocks: DataFrame) -> DataFrame:
    """First and last offset of each page's blocks, the page's own line ends included, and how many there are."""
    return blocks.groupBy("doc_id", "page").agg(F.min("char_start").alias("char_start"), (F.max("char_end") + 2).alias("char_end"), F.count(F.lit(1)).alias("n_blocks"))


def spaced(parts: Column) -> Column:
    """Texts of ordered parts (char_start, char_end, text), with the line ends that their offsets leave between them."""
    gap = lambda i: F.get(parts, i + 1)["char_start"] - F.get(parts, i)["char_end"]
    return F.array_join(F.transform(parts, lambda x, i: F.concat(x["text"], F.repeat(F.lit("\n"), F.coalesce(gap(i), F.lit(0)).cast("int")))), "")


def documents(blocks: DataFrame) -> DataFrame:
    """One row a document: its text, hash, blocks and pages.

    Columns ``first_page`` and ``last_page`` of the blocks tell the range that was read, empty
    pages at its ends included. The hash is that of the text, or the blocks' own ``doc_hash``.
    Offsets say how many line ends are between blocks, so a text is put together in two levels, runs of
    blocks and runs of runs, each character copied twice, however many pages there are.
    """
    have = set(blocks.columns)
    parts = lambda order: F.array_sort(F.collect_list(F.struct(order, "char_start", "char_end", "text")))
    first = F.min("first_page") if "first_page" in have else F.min("page")
    last = F.max("last_page") if "last_page" in have else F.max("page")
    runs = blocks.withColumn("_run", F.expr(f"block_idx div {RUN}")).groupBy("doc_id", "_run").agg(
        parts("block_idx").alias("_parts"), F.count(F.lit(1)).alias("n_blocks"), first.alias("start_page"), last.alias("end_page"), F.max("page").alias("kept_page"),
        (F.max("doc_hash") if "doc_hash" in have else F.lit(None).cast("string")).alias("own_hash"),
    )
    runs = runs.select("*", F.col("_parts")[0]["char_start"].alias("char_start"), F.element_at("_parts", -1)["char_end"].alias("char_end"), spaced(F.col("_parts")).alias("text"))
    whole = runs.groupBy("doc_id").agg(
        parts("_run").alias("_parts"), F.sum("n_blocks").alias("n_blocks"), F.min("start_page").cast("int").alias("start_page"), F.max("end_page").cast("int").alias("end_page"),
        F.max("kept_page").alias("kept_page"), F.max("own_hash").alias("own_hash"),
    )
    lead, tail = F.col("_parts")[0]["char_start"].cast("int"), F.col("end_page") - F.col("kept_page") + 2  # a block's line end, its page's, and those of pages behind it
    whole = whole.withColumn("full_text", F.concat(F.repeat(F.lit("\n"), lead), spaced(F.col("_parts")), F.repeat(F.lit("\n"), tail.cast("int"))))
    return whole.select("doc_id", "full_text", "start_page", "end_page", "n_blocks", F.coalesce("own_hash", F.sha2("full_text", 256)).alias("doc_hash"))


def locate(offsets: DataFrame, blocks: DataFrame) -> DataFrame:
    """The block that holds each offset, or nulls: an as-of lookup by windows, no range join.

    ``offsets`` has doc_id and offset; offsets between blocks are in none. A document's blocks and offsets are dealt by ranges of
    its positions, and each range is told the last block that starts before it, so a long document spreads.
    """
    place = F.struct("block_idx", "page", "char_end")
    marks = blocks.select("doc_id", F.col("char_start").alias("at"), F.lit(0).alias("kind"), place.alias("b"))
    asked = offsets.select("doc_id", F.col("offset").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["b"].dataType).alias("b"))
    rows = marks.unionByName(asked).withColumn("range", F.expr(f"at div {SPAN}"))
    ranges = rows.groupBy("doc_id", "range").agg(F.max_by("b", F.when(F.col("kind") == 0, F.col("at"))).alias("ended"))
    before = Window.partitionBy("doc_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("doc_id", "range", F.last("ended", True).over(before).alias("carried"))
    upto = Window.partitionBy("doc_id", "range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("b", F.last("b", True).over(upto)).where("kind = 1").join(ranges, ["doc_id", "range"]).withColumn("b", F.coalesce("b", "carried"))
    inside = F.col("at") < F.col("b.char_end")
    return found.select("doc_id", F.col("at").alias("offset"), F.when(inside, F.col("b.block_idx")).alias("block_idx"), F.when(inside, F.col("b.page")).alias("page"))


def slices(spans: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``text``: the document's text from ``start`` to ``end`` (doc_id, ``keys``, start, end); '' where that is empty.

    Each span is told its first and last block, by a window over offsets alone or by its own columns first_block
    and last_block; it meets these blocks one by one, by number. So neither a document nor its text is ever a row, and no block goes
    where no span wants it.
    """
    spans = spans.where("start >= 0 AND end > start")
    if not {"first_block", "last_block"} <= set(spans.columns):
        marks = blocks.select("doc_id", F.col("char_start").alias("at"), F.lit(0).alias("kind"), "block_idx")
        upto = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
        ends = {"start": F.col("start"), "end": F.col("end") - 1}
        asked = spans.select("doc_id", F.explode(F.array(*ends.values())).alias("at")).distinct()
        placed = marks.unionByName(asked.select("doc_id", "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("block_idx")))
        placed = placed.withColumn("block_idx", F.coalesce(F.last("block_idx", True).over(upto), F.lit(0))).where("kind = 1")
        for name, at in (("first_block", ends["start"]), ("last_block", ends["end"])):
            spans = spans.withColumn("_at", at).join(placed.select("doc_id", F.col("at").alias("_at"), F.col("block_idx").alias(name)), ["doc_id", "_at"]).drop("_at")
    rows = spans.select("doc_id", *keys, "start", "end", F.explode(F.sequence("first_block", "last_block")).alias("block_idx"))
    rows = rows.join(blocks.select("doc_id", "block_idx", F.col("char_start").alias("_a"), F.col("char_end").alias("_b"), "text"), ["doc_id", "block_idx"])
    low, high = F.greatest("start", "_a"), F.least("end", "_b")
    cut = F.when((low == F.col("_a")) & (high == F.col("_b")), F.col("text")).otherwise(F.substring(F.col("text"), (low - F.col("_a") + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")))
    part = F.struct("block_idx", F.least(low, "end").alias("char_start"), F.greatest(high, low).alias("char_end"), cut.alias("text"))
    made = rows.groupBy("doc_id", *keys, "start", "end").agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    lead = (F.col("_parts")[0]["char_start"] - F.col("start")).cast("int")
    tail = (F.col("end") - F.element_at("_parts", -1)["char_end"]).cast("int")
    whole = F.concat(F.repeat(F.lit("\n"), lead), spaced(F.col("_parts")), F.repeat(F.lit("\n"), tail))
    return made.select("doc_id", *keys, whole.alias("text"))


def page_range(blocks: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """Each document's blocks from page ``first`` to page ``last``: first_block and last_block (length and -1 if there is none)."""
    after = F.lit(True) if first is None else F.col("page") >= first
    upto = F.lit(True) if last is None else F.col("page") <= last
    return blocks.groupBy("doc_id").agg(
        F.coalesce(F.min(F.when(after, F.col("block_idx"))), F.max("block_idx") + 1).alias("first_block"),
        F.coalesce(F.max(F.when(upto, F.col("block_idx"))), F.lit(-1)).cast("long").alias("last_block"),
    )
