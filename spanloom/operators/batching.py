"""Token-budgeted batches of whole blocks or whole units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import LINE_END, WS, estimate_tokens, heading_ident
from spanloom.plans.storage import stored

#: How far into a line a heading may start, and how much of it is searched.
SLACK, HEAD = 8, 60
#: Units of a document that are folded as one list.
FOLD = 4096


def is_heading(text: Column, pattern: str) -> Column:
    """The pattern matches at the start, or begins within the first characters of, the left-stripped text."""
    bare = F.regexp_replace(text, f"^{WS}+", "")
    near = F.regexp_instr(F.substring(bare, 1, HEAD), F.lit(pattern))
    return bare.rlike(f"^(?:{pattern})") | near.between(1, SLACK + 1)


def with_units(blocks: DataFrame, pattern: str | None) -> DataFrame:
    """Blocks with is_boundary and unit_no; blocks before the first heading are unit 0.

    A document without headings, or no pattern at all, has each block as a unit.
    """
    mark = F.lit(False) if pattern is None else is_heading(F.col("text"), pattern)
    upto = Window.partitionBy("doc_id").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    found = blocks.withColumn("is_boundary", mark)
    some = F.max("is_boundary").over(Window.partitionBy("doc_id"))
    return found.withColumn("unit_no", F.when(some, F.sum(F.col("is_boundary").cast("long")).over(upto)).otherwise(F.col("block_idx")))


#: Fields of a unit, and of a batch.
_BATCH = ("first_block", "last_block", "char_start", "char_end", "page_start", "page_end", "headings")


def _folded(units: Column, budget: Column) -> Column:
    """Greedy cut of ordered units: the batches, as structs."""
    kind = "struct<" + ",".join(f"{f}:{'int' if f.startswith('page') else 'bigint'}" for f in _BATCH) + ">"
    one = lambda u: F.struct(*[u[f].alias(f) for f in _BATCH])
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("now"))

    def step(a: Column, x: Column) -> Column:
        now = a["now"]
        fits = F.coalesce(F.floor((x["char_end"] - now["char_start"]) / 4) + 1 <= budget, F.lit(False))
        more = F.struct(
            now["first_block"].alias("first_block"), x["last_block"].alias("last_block"), now["char_start"].alias("char_start"), x["char_end"].alias("char_end"),
            now["page_start"].alias("page_start"), x["page_end"].alias("page_end"), (now["headings"] + x["headings"]).alias("headings"),
        )
        done = F.when(fits | now.isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(now)))
        return F.struct(done.alias("done"), F.when(fits, more).otherwise(one(x)).alias("now"))

    return F.aggregate(units, start, step, lambda a: F.concat(a["done"], F.array(a["now"])))


def _jumped(units: DataFrame, budget: Column, group: list[str]) -> DataFrame:
    """The same batches by jumps, for documents of any number of units; none of them is ever a list.

    Where a batch that starts with a unit ends is a search over offsets: the first unit whose end is too far from
    the start opens the next one. These jumps are doubled, and each doubling tells as many more batches of the
    chain that starts with the first unit as are known: rounds grow with the logarithm of the batches.
    """
    run = Window.partitionBy(*group).orderBy("unit_no")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda f: F.lag(f).over(run).alias(f)
    rows = units.withColumns({
        "_before": F.struct(last("last_block"), last("char_end"), last("page_end"), F.coalesce(F.sum("headings").over(before), F.lit(0)).alias("seen")),
        "_next": F.lead("unit_no").over(run), "_seen": F.sum("headings").over(run),
    })
    own = F.struct("last_block", "char_end", "page_end", F.col("_seen").alias("seen"))
    far = (1 << 62) - 1
    # each unit as the one that a batch stops before; behind the last one is the end
    stops = rows.select(*group, F.col("char_end").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col("unit_no").alias("stop"), F.col("_before").alias("told")).alias("_stop"), F.lit(None).cast("long").alias("unit_no"))
    end = rows.where(F.col("_next").isNull()).select(*group, F.lit(far).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.lit(None).cast("long").alias("stop"), own.alias("told")).alias("_stop"), F.lit(None).cast("long").alias("unit_no"))
    asks = rows.select(*group, (F.col("char_start") + 4 * budget).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(stops.schema["_stop"].dataType).alias("_stop"), "unit_no")
    down = Window.partitionBy(*group).orderBy(F.desc("_at"), "_kind", F.desc("unit_no")).rowsBetween(Window.unboundedPreceding, 0)
    found = stops.unionByName(end).unionByName(asks).withColumn("_stop", F.last("_stop", True).over(down)).where("_kind = 1").select(*group, "unit_no", "_stop")
    alone = F.coalesce(F.col("_stop.stop") == F.col("unit_no"), F.lit(False))  # a unit too long for any batch is one
    edges = rows.join(found, [*group, "unit_no"]).withColumns({"_to": F.when(alone, F.col("_next")).otherwise(F.col("_stop.stop")), "_told": F.when(alone, own).otherwise(F.col("_stop.told"))})
    edges = stored(edges.select(*group, "unit_no", "first_block", "char_start", "page_start", F.col("_before.seen").alias("_from"), "_told", "_to"), "jumps")
    jump = edges.where(F.col("_to").isNotNull()).select(*group, "unit_no", "_to")
    opened = stored(edges.groupBy(*group).agg(F.min("unit_no").alias("unit_no")), "opened")
    while True:
        more = stored(opened.join(jump, [*group, "unit_no"]).select(*group, F.col("_to").alias("unit_no")), "opened")
        if not more.limit(1).count():
            break
        opened = opened.unionByName(more)
        jump = stored(jump.join(jump.select(*group, F.col("unit_no").alias("_to"), F.col("_to").alias("_then")), [*group, "_to"]).select(*group, "unit_no", F.col("_then").alias("_to")), "jumps")
    batches = opened.join(edges, [*group, "unit_no"]).withColumn("batch_no", F.row_number().over(run) - 1)
    return batches.select(*group, "batch_no", "first_block", "_told.last_block", "char_start", "_told.char_end", "page_start", "_told.page_end", (F.col("_told.seen") - F.col("_from")).alias("headings"))


def plan_batches(blocks: DataFrame, budget: int | Column, pattern: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Batches of each document: the longest runs of whole units within the budget, at least one unit each.

    Columns: doc_id, ``keys``, batch_no, first_block, last_block, char_start,
    char_end, est_input_tokens, n_units, page_start and page_end. n_units counts
    headings (0 for a batch before the first), or is 1 in documents without.
    Documents of at most FOLD units are folded in one expression; the batches of longer ones are found by jumps.
    """
    return plan_units(with_units(blocks, pattern), budget, keys)


def plan_units(marked: DataFrame, budget: int | Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Batches of blocks that have their units already. A budget that is a column must be among ``keys``."""
    budget = F.lit(budget).cast("long") if isinstance(budget, int) else budget
    group = ["doc_id", *keys]
    units = marked.groupBy(*group, F.col("unit_no").cast("long").alias("unit_no")).agg(
        F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"), F.min("block_idx").alias("first_block"), F.max("block_idx").alias("last_block"),
        F.min("page").cast("int").alias("page_start"), F.max("page").cast("int").alias("page_end"), F.max("is_boundary").cast("long").alias("headings"),
    )
    units = stored(units, "units")
    sizes = units.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.max("headings").alias("_some"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    short = units if most <= FOLD else units.join(sizes.where(F.col("_n") <= FOLD).select(*group), group)
    docs = short.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("unit_no", *_BATCH))).alias("_units"))
    some = F.exists("_units", lambda u: u["headings"] > 0).cast("long").alias("_some")
    cut = docs.select(*group, some, F.posexplode(_folded(F.col("_units"), budget)).alias("batch_no", "_b")).select(*group, "_some", "batch_no", "_b.*")
    if most > FOLD:
        long = sizes.where(F.col("_n") > FOLD).drop("_n")
        cut = cut.unionByName(_jumped(units.join(long.drop("_some"), group), budget, group).join(long, group))
    made = cut.withColumn("n_units", F.when(F.col("_some") > 0, F.col("headings")).otherwise(1).cast("long")).withColumn("batch_no", F.col("batch_no").cast("long"))
    made = made.select(*group, "batch_no", "first_block", "last_block", "char_start", "char_end", "n_units", "page_start", "page_end")
    return made.withColumn("est_input_tokens", estimate_tokens(F.col("char_end") - F.col("char_start")))


def summarize(plans: DataFrame, *keys: str) -> DataFrame:
    """n_batches, largest, smallest, median and total estimate, and most units of a batch; zeros if there is none."""
    est = F.col("est_input_tokens")
    return plans.groupBy(*keys).agg(
        F.count(est).alias("n_batches"), F.coalesce(F.max(est), F.lit(0)).alias("max_tokens"), F.coalesce(F.min(est), F.lit(0)).alias("min_tokens"),
        F.coalesce(F.floor(F.percentile(est, 0.5)), F.lit(0)).cast("long").alias("median_tokens"), F.coalesce(F.sum(est), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.max("n_units"), F.lit(0)).alias("max_units"),
    )


def headings(df: DataFrame, pattern: str, text: str = "text", tolerant: bool = True) -> DataFrame:
    """Distinct heading identifiers of each doc_id's text, with the line where each comes first: ident and line_no."""
    lines = df.select("doc_id", F.posexplode(F.split(text, LINE_END, -1)).alias("line_no", "line"))
    bare = F.regexp_replace("line", f"^{WS}+", "")
    hit = is_heading(F.col("line"), pattern) if tolerant else bare.rlike(f"^(?:{pattern})")
    grouped = "(" in pattern.replace("(?:", "").replace(r"\(", "")
    group = F.regexp_extract(bare, pattern, 1 if grouped else 0)
    found = lines.where(hit).select("doc_id", "line_no", heading_ident(group).alias("ident"))
    return found.groupBy("doc_id", "ident").agg(F.min("line_no").alias("line_no"))


def section_ids(plans: DataFrame, blocks: DataFrame, pattern: str) -> DataFrame:
    """Plans with ``section_ids``: the heading identifiers in each batch's text, in order."""
    found = headings(blocks.select(F.struct("doc_id", "block_idx").alias("doc_id"), "text"), pattern)
    found = found.select("doc_id.doc_id", "doc_id.block_idx", "line_no", "ident")
    starts = plans.select("doc_id", F.col("first_block").alias("block_idx"), F.lit(-1).alias("line_no"), F.lit(None).cast("string").alias("ident"), "batch_no")
    upto = Window.partitionBy("doc_id").orderBy("block_idx", "line_no")
    placed = starts.unionByName(found.withColumn("batch_no", F.lit(None).cast("long"))).withColumn("batch_no", F.last("batch_no", True).over(upto)).where("ident IS NOT NULL")
    firsts = placed.groupBy("doc_id", "batch_no", "ident").agg(F.min(F.struct("block_idx", "line_no")).alias("at"))
    listed = firsts.groupBy("doc_id", "batch_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ident"))), lambda x: x["ident"]).alias("section_ids"))
    return plans.join(listed, ["doc_id", "batch_no"], "left").withColumn("section_ids", F.coalesce("section_ids", F.array().cast("array<string>")))


def contains_section(ids: Column, wanted: str) -> Column:
    """Whether a batch has a section, given with or without its sign."""
    return F.array_contains(ids, wanted.strip().removeprefix("§").strip())
