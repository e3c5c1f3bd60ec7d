"""From blocks to units: plan all batches, call, resolve and stitch."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from spanloom.operators.batching import plan_units, with_units
from spanloom.operators.blocks import documents, page_range, slices
from spanloom.operators.payloads import FIELDS, batch_status, items_of, renamed, specs_of
from spanloom.operators.resolve import BatchUnit, Searchable, batch_unit, resolve
from spanloom.operators.stitch import TextWindow, Unit, finished, pending_state, restored_pending, restored_unit, step, unit_state
from spanloom.plans.calls import CallStore, TokenBucket, call_key, in_order
from spanloom.plans.providers import Provider, call
from spanloom.plans.settings import Profile, Settings, system_prompt
from spanloom.plans.storage import partitions, stored

log = logging.getLogger("spanloom")
KEY = ["doc_id", "first_block", "last_block"]
#: Rows that a task takes up, and answers that it hands on, at once.
ANSWERS = 64

SPEC = "struct<start_quote:string,end_quote:string,end_before_quote:string,start_after_quote:string,role:string,metadata:string>"
SEGMENT = "struct<start:bigint,end:bigint,role:string,text:string>"
UNIT_FIELDS = (
    f"k int, sequence long, status string, verbatim_match boolean, start long, end long, segments array<{SEGMENT}>, specs array<{SPEC}>, n_segments int, start_quote string, end_quote string, "
    "end_resolved boolean, end_inferred_from_next_start boolean, end_quote_unresolved boolean, start_via_fallback boolean, ambiguous boolean, segments_partial boolean, "
    "source_chunk_id long, source_chunk_ids array<long>, requirement_text string, questionnaire_text string, context_text string, model_parts array<string>"
)
CALL_FIELDS = (
    "chunk_id long, n_returned int, n_found int, n_malformed int, malformed array<string>, batch_status string, model_items array<string>"
)
SENT = "payload_json string, model_used string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, stop_reason string, response_time_s double, attempts string, failed boolean"


def batch_units(payload: str | None, text: str, shift: int, keep_lone_ends: bool, names: dict[str, str] | None = None) -> tuple[list[BatchUnit], list[object], list[str]]:
    """A batch's units, the items that its payload had, and why some were malformed."""
    items, malformed = items_of(payload)
    items = [renamed(x, names) for x in items]
    good = []
    for item in items:
        specs, reason = specs_of(item)
        if reason:
            malformed.append(reason)
        else:
            good.append((item, specs))
    found = resolve(Searchable(text), [s for _, specs in good for s in specs])
    units, at = [], 0
    for item, specs in good:
        units.append(batch_unit(item, specs, found[at : at + len(specs)], text, shift, keep_lone_ends))
        at += len(specs)
    return units, items, malformed


def unit_row(k: int, u: Unit) -> dict:
    plain = lambda x: None if x is None else json.dumps(x, ensure_ascii=False)
    row = {f: getattr(u, f) for f in ("sequence", "status", "verbatim_match", "start", "end", "n_segments", "start_quote", "end_quote",
        "end_resolved", "end_inferred_from_next_start", "end_quote_unresolved", "start_via_fallback", "ambiguous", "segments_partial",
        "source_chunk_id", "source_chunk_ids")}
    return row | {
        "k": k, "segments": [{"start": a, "end": b, "role": r, "text": t} for (a, b, r),
            t in zip(u.segments, u.segment_texts, strict=True)], "specs": [{c: s[c] for c in (*FIELDS, "role")} | {"metadata": plain(s["metadata"])} for s in u.specs],
        **{f"{r}_text": t for r, t in u.texts.items()}, "model_parts": [plain(m) for m in u.model_parts],
    }


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A task's rows; few of them are Python objects at a time, however many came in a batch."""
    for batch in batches:
        for i in range(0, batch.num_rows, ANSWERS):
            yield from batch.slice(i, ANSWERS).to_pylist()


def batches_of(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows handed on a few at a time."""
    made: list[dict] = []
    for row in rows:
        made.append(row)
        if len(made) == ANSWERS:
            yield pa.RecordBatch.from_pylist(made, schema=schema)
            made = []
    if made:
        yield pa.RecordBatch.from_pylist(made, schema=schema)


def arrow_schema(fields: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(fields))


def failed_call(e: Exception) -> dict:
    """A call that came to nothing: one failed call costs its batch, not the job."""
    told = {"model": None, "attempt_no": 1, "duration_s": 0.0, "outcome": "api_error", "error_message": str(e)[:200]}
    return call({}, "", stop_reason="", attempts=[told]) | {"failed": True}


def _asked(provider: Provider, prompt: str, names: list[str], settings: Settings, fields: str):
    """Calls of a task's rows, so many in flight at once, under one budget of tokens; answers that are kept are not asked for again."""
    schema = arrow_schema(fields)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TokenBucket(settings.tokens_per_s)
        store = CallStore(settings.call_store) if settings.call_store else None
        pause = iter([0.0])

        def one(r: dict) -> dict:
            blocks = r.pop("blocks")
            text = "\n".join(b["text"] for b in blocks)
            made = store.get(r["call_key"]) if store else None
            if made is None:
                time.sleep(next(pause, settings.call_pause_s))
                bucket.take((len(prompt) + len(text)) / 4)
                try:
                    made = provider.propose(prompt, text, blocks)
                except Exception as e:  # noqa: BLE001
                    return {c: r[c] for c in names} | failed_call(e)
                if store:
                    store.put(r["call_key"], made)
            return {c: r[c] for c in names} | {"failed": False} | made

        yield from batches_of(in_order(one, rows_of(batches), settings.calls_in_flight), schema)

    return ask


def propose(plans: DataFrame, blocks: DataFrame, provider: Provider, prompt: str, settings: Settings) -> DataFrame:
    """Call the provider once for each planned batch; written before anything reads it.

    With ``settings.call_store``, what was answered before, by whichever job, is taken from there, and batches that are
    equal in all that is sent are asked about once.
    """
    spark = blocks.sparkSession
    have = {"role": F.lit(None).cast("string"), "label": F.lit(None).cast("string")} | {c: F.col(c) for c in blocks.columns}
    rows = blocks.select("doc_id", F.struct("block_idx", "text", have["role"].alias("role"), have["label"].alias("label")).alias("b"), "block_idx")
    # a batch's first block carries its place to the blocks behind it
    marked = rows.join(plans.select("doc_id", F.col("first_block").alias("block_idx"), "first_block", "last_block"), ["doc_id", "block_idx"], "left")
    upto = Window.partitionBy("doc_id").orderBy("block_idx")
    marked = marked.withColumns({c: F.last(c, True).over(upto) for c in ("first_block", "last_block")}).where("block_idx <= last_block")
    texts = marked.groupBy("doc_id", "first_block").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    key = call_key(F.lit(prompt), F.lit(",".join(settings.models())), F.col("blocks"))
    asked = plans.join(texts, ["doc_id", "first_block"]).select(*plans.columns, "blocks", key.alias("call_key"), F.substring(F.sha2(text, 256), 1, 16).alias("chunk_hash"))
    if not settings.call_store:
        # calls are dealt one by one, so those of a long document don't wait for each other
        kept = [*plans.columns, "chunk_hash"]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select(*kept).schema.fields)
        dealt = asked.drop("call_key").repartition(partitions(spark), "doc_id", "first_block")
        fields = f"{fields}, {SENT}"
        return stored(dealt.mapInArrow(_asked(provider, prompt, kept, settings, fields), fields), "calls")
    asked = stored(asked, "asked")
    answered = CallStore(settings.call_store).answers(spark).withColumn("failed", F.lit(False)).dropDuplicates(["key"]).withColumnRenamed("key", "call_key")
    new = asked.select("call_key", "blocks").join(answered.select("call_key"), "call_key", "left_anti").dropDuplicates(["call_key"]).repartition(partitions(spark), "call_key")
    fields = f"call_key string, {SENT}"
    called = stored(new.mapInArrow(_asked(provider, prompt, ["call_key"], settings, fields), fields), "called")
    known = answered.join(asked.select("call_key").distinct(), "call_key", "left_semi").join(called.select("call_key"), "call_key", "left_anti")
    every = called.unionByName(known.select(*called.columns))
    return stored(asked.drop("blocks").join(every, "call_key").drop("call_key"), "calls")


def call_all(blocks: DataFrame, provider: Provider, profile: Profile, settings: Settings) -> DataFrame:
    """All calls of all documents, with chunk_id, and overflowed for batches that are not stitched.

    Batches depend on each other only through overflow: the blocks of an overflowed
    batch, and no others, are planned again under a smaller budget, until it
    has shrunk as often as allowed or to its floor; then the batch is given up. A batch of one
    unit can't be cut, and is given up at once. All overflowed batches of all documents shrink together, so
    rounds don't grow with the data, and no batch is called twice. A document may have any number of batches.
    """
    prompt = system_prompt(profile)
    target = settings.budget(prompt)
    units = with_units(blocks, profile.boundary_pattern)
    rest = units.withColumns({"part": F.lit(-1).cast("long"), "budget": F.lit(target).cast("long")})
    done: list[DataFrame] = []
    rounds = min(settings.max_iterations, settings.max_consecutive_shrinks + 1)
    for turn in range(rounds):
        plans = plan_units(rest, F.col("budget"), ("part", "budget")).drop("part")
        if done:  # what can't be cut would be the same batch again
            plans = plans.join(done[-1].where("overflowed").select(*KEY), KEY, "left_anti")
        made = propose(plans, rest, provider, prompt, settings)
        over = (F.col("stop_reason") == "max_tokens") & ~F.col("failed")
        done.append(made.withColumn("overflowed", over))
        again = done[-1].where(F.col("overflowed") & (F.col("budget") > settings.min_input_tokens))
        left = again.count()
        log.info("round %d: %d batches overflowed and are planned again", turn + 1, left)
        if not left:
            break
        if turn + 1 == rounds:
            log.warning("stopped after %d rounds; %d batches still overflow", rounds, left)
            break
        smaller = F.greatest(F.lit(settings.min_input_tokens), F.floor(F.col("budget") * settings.shrink_factor)).cast("long")
        again = again.select("doc_id", F.col("first_block").alias("part"), F.col("last_block").alias("_until"), smaller.alias("budget"))
        rest = stored(units.join(again, "doc_id").where("block_idx BETWEEN part AND _until").drop("_until"), "rest")
    calls = done[0]
    for more in done[1:]:
        calls = calls.unionByName(more)
    # in the order of calls: a batch that overflowed is longer than the ones that took its place
    order = Window.partitionBy("doc_id").orderBy("first_block", F.desc("last_block"))
    return calls.withColumn("chunk_id", F.row_number().over(order).cast("long"))


def _split(fields: str) -> list[str]:
    """Top-level parts of a schema string."""
    parts, depth, now = [], 0, ""
    for ch in fields:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            parts.append(now)
            now = ""
        else:
            now += ch
    return [*parts, now]


STEP_FIELDS = "used int, n_lead int, n_total int, closes string, bound long, passes boolean, parts array<string>, open string, open_start long, open_until long"


def _plain(x: object) -> str | None:
    return None if x is None else json.dumps(x, ensure_ascii=False)


def names_of(fields: str) -> list[str]:
    """The names of a schema string's fields."""
    return [f.strip().split(" ")[0].strip("`") for f in _split(fields)]


def _stepped(settings: Settings, names: dict[str, str] | None, fields: str):
    """Each call by itself: its items, its units, and what it does to a unit that is open when it comes."""

    schema = arrow_schema(fields)

    def one(c: dict) -> dict:
        a, text = int(c["char_start"]), c["text"] or ""
        units, items, bad = ([], [], []) if c["failed"] else batch_units(c["payload_json"], text, a, settings.keep_lone_ends, names)
        status = "api_error" if c["failed"] else batch_status(len(units), sum(u.verbatim for u in units), len(bad), c["stop_reason"])
        row = {"doc_id": c["doc_id"], "chunk_id": c["chunk_id"], "n_returned": len(items), "n_found": len(units), "n_malformed": len(bad), "malformed": bad, "batch_status": status}
        row["model_items"] = [json.dumps(x, ensure_ascii=False) for x in items]
        counts = not (c["overflowed"] or c["failed"])
        made = step(units if counts else [], int(c["chunk_id"]), a, TextWindow(a, text))
        ends = [x[1] for x in made.closes.segments] + [made.closes.end] if made.closes else []
        row |= {
            "used": made.used, "n_lead": made.n_lead, "n_total": made.n_total, "closes": _plain(unit_state(made.closes)) if made.closes else None, "bound": made.bound, "passes": made.passes,
            "parts": [_plain(x) for x in made.parts], "open": _plain(pending_state(made.open)) if made.open else None, "open_start": made.open.unit.start if made.open else None,
            "open_until": max(ends) if ends else made.bound, "units": [unit_row(k, u) for k, u in enumerate(made.units)],
        }
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(map(one, rows_of(batches)), schema)

    return run


def _closed(fields: str):
    """Units that were open between batches, with the text from their start to where they end."""

    schema = arrow_schema(fields)

    def one(r: dict) -> dict:
        p = restored_pending(json.loads(r["open"]))
        p.chunk_ids += [int(x) for x in r["more_ids"]]
        for part in map(json.loads, r["more_parts"]):
            p.parts += [part] if part not in p.parts else []
        closes = restored_unit(json.loads(r["closes"])) if r["closes"] else None
        bound = r["bound"]
        u = finished(p, closes, bound, int(r["range_end"]), TextWindow(p.unit.start, r["text"] or ""))
        return {c: r[c] for c in ("doc_id", "chunk_id", "at_chunk")} | unit_row(-1, u)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(map(one, rows_of(batches)), schema)

    return run


def struct_of(fields: str) -> str:
    """A schema string's fields as a struct type."""
    return "struct<" + ", ".join(":".join(f.strip().split(" ", 1)) for f in _split(fields)) + ">"


@dataclass
class Extraction:
    """An extraction's tables: docs, blocks, calls and units."""

    docs: DataFrame
    blocks: DataFrame
    calls: DataFrame
    units: DataFrame


def assemble(blocks: DataFrame, calls: DataFrame, settings: Settings | None = None, names: dict[str, str] | None = None) -> Extraction:
    """Resolve and stitch recorded calls: doc_id, chunk_id, char_start, char_end, payload_json, stop_reason, failed, overflowed and more.

    ``names`` maps our field names to those of payloads that came from elsewhere. Calls that count (neither failed
    nor overflowed) must not overlap, and chunk_id must follow their order.

    Every call is a row of its own, with its own text: batches of a long document are resolved by all tasks alike.
    What a batch does to a unit that is open when it comes composes by a rule that a window can
    follow: the last batch before that didn't let an open unit pass decides. So sequence numbers, and what becomes of
    units over several batches, come from windows over a few numbers a batch; units that were open meet the text from their start to their end.
    """
    settings = settings or Settings.of(blocks.sparkSession)
    spark, kind = blocks.sparkSession, blocks.schema["doc_id"].dataType.simpleString()
    need = ["doc_id", "chunk_id", "char_start", "char_end", "payload_json", "stop_reason", "failed", "overflowed"]
    spans = calls.select("doc_id", "chunk_id", F.col("char_start").alias("start"), F.col("char_end").alias("end"), *[c for c in ("first_block", "last_block") if c in calls.columns])
    texts = slices(spans, blocks, ["chunk_id"])
    rows = calls.select(*need).join(texts, ["doc_id", "chunk_id"], "left").repartition(partitions(spark), "doc_id", "chunk_id")
    fields = f"doc_id {kind}, {CALL_FIELDS}, {STEP_FIELDS}, units array<{struct_of(UNIT_FIELDS)}>"
    steps = stored(rows.mapInArrow(_stepped(settings, names, fields), fields), "steps")

    order = Window.partitionBy("doc_id").orderBy("chunk_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    decided = F.last(F.when(~F.col("passes"), F.struct("chunk_id", F.col("open").isNotNull().alias("some"))), True).over(before)
    told = steps.select("doc_id", "chunk_id", "used", "n_lead", "n_total", "passes", "open", decided.alias("_d"))
    told = told.withColumn("opener", F.when(F.col("_d.some"), F.col("_d.chunk_id")))
    lead = F.when(F.col("opener").isNotNull(), F.col("n_lead")).otherwise(0)
    taken = F.coalesce(F.sum(F.col("n_total") - lead).over(before), F.lit(0))
    told = stored(told.select("doc_id", "chunk_id", "opener", (taken - lead).alias("shift")), "told")

    both = steps.join(told, ["doc_id", "chunk_id"])
    own = both.where("size(units) > 0").select("doc_id", "chunk_id", "opener", "used", "shift", F.col("chunk_id").alias("at_chunk"), F.inline("units"))
    own = own.where("opener IS NULL OR k >= used").drop("opener", "used")
    # what later batches gave to a unit that was open, and which of them ended it
    went = both.where("opener IS NOT NULL").groupBy("doc_id", F.col("opener").alias("chunk_id")).agg(
        F.sort_array(F.collect_list(F.when(F.col("used") > 0, F.struct(F.col("chunk_id").alias("c"), "parts")))).alias("more"),
        F.max(F.when(~F.col("passes"), F.struct(F.col("chunk_id").alias("at_chunk"), "closes", "bound", "open_until"))).alias("ended"),
    )
    flush = (1 << 62) - 1
    ends = calls.groupBy("doc_id").agg(F.max("char_end").alias("range_end"))
    cut = both.where("open IS NOT NULL").select("doc_id", "chunk_id", "open", "open_start", "shift").join(went, ["doc_id", "chunk_id"], "left").join(ends, "doc_id")
    cut = cut.select(
        "doc_id", "chunk_id", "open", "open_start", "shift", "range_end", F.coalesce("ended.at_chunk", F.lit(flush)).alias("at_chunk"), "ended.closes", "ended.bound",
        F.coalesce("ended.open_until", "range_end").alias("until"), F.coalesce(F.transform("more", lambda x: x["c"]), F.array().cast("array<long>")).alias("more_ids"),
        F.coalesce(F.flatten(F.transform("more", lambda x: x["parts"])), F.array().cast("array<string>")).alias("more_parts"),
    )
    cut = stored(cut, "open")
    texts = slices(cut.select("doc_id", "chunk_id", F.col("open_start").alias("start"), F.greatest("until", "open_start").alias("end")), blocks, ["chunk_id"])
    rows = cut.join(texts, ["doc_id", "chunk_id"], "left").select("doc_id", "chunk_id", "at_chunk", "open", "closes", "bound", "range_end", "more_ids", "more_parts", "text")
    fields = f"doc_id {kind}, chunk_id long, at_chunk long, {UNIT_FIELDS}"
    done = rows.repartition(partitions(spark), "doc_id", "chunk_id").mapInArrow(_closed(fields), fields).join(cut.select("doc_id", "chunk_id", "shift"), ["doc_id", "chunk_id"])

    units = own.unionByName(done).withColumn("sequence", F.when(F.col("sequence") > 0, F.col("sequence") + F.col("shift")).otherwise(F.col("sequence")))
    place = Window.partitionBy("doc_id").orderBy("at_chunk", "k")
    units = units.withColumn("k", (F.row_number().over(place) - 1).cast("int")).drop("chunk_id", "at_chunk", "shift")
    judged = steps.select("doc_id", *names_of(CALL_FIELDS))
    return Extraction(documents(blocks), blocks, calls.join(judged, ["doc_id", "chunk_id"]), stored(units.select("doc_id", *names_of(UNIT_FIELDS)), "units"))


def progress(e: Extraction) -> dict[str, int]:
    """What a run came to: calls, failed, overflowed and malformed ones, units, and those cut at an end. Counts alone reach the driver."""
    told = e.calls.agg(
        F.count(F.lit(1)), F.count_if("failed"), F.count_if("overflowed"), F.coalesce(F.sum("n_malformed"), F.lit(0)), F.count_if(F.col("batch_status").isin("ok", "empty")),
    ).first()
    units = e.units.agg(F.count(F.lit(1)), F.count_if(F.col("status").startswith("truncated"))).first()
    made = dict(zip(("calls", "failed", "overflowed", "malformed", "ok", "units", "truncated"), (*told, *units), strict=True))
    log.info("%s", ", ".join(f"{n} {k}" for k, n in made.items()))
    return made


def extract(
    blocks: DataFrame, profile: Profile, provider: Provider, settings: Settings | None = None,
    start_page: int | None = None, end_page: int | None = None, refine_ends: bool = False, names: dict[str, str] | None = None,
) -> Extraction:
    """Extract units from blocks (doc_id, block_idx, page, text, char_start, char_end and, for rule-based providers, role and label).

    Only blocks from ``start_page`` to ``end_page`` are called; offsets are those of the whole
    document. ``refine_ends`` asks again for doubtful ends. Blocks are written once, as
    planning, calling and stitching all read them.
    """
    settings = settings or Settings.of(blocks.sparkSession)
    chosen = blocks = stored(blocks, "blocks")
    if start_page is not None or end_page is not None:
        if start_page is not None and end_page is not None and start_page > end_page:
            raise ValueError(f"pages {start_page} to {end_page} are no range")
        span = page_range(blocks, start_page, end_page).withColumnsRenamed({"first_block": "_low", "last_block": "_high"})
        chosen = blocks.join(span, "doc_id").where("block_idx BETWEEN _low AND _high").drop("_low", "_high")
    made = assemble(blocks, call_all(chosen, provider, profile, settings), settings, names)
    if refine_ends:
        from spanloom.plans.refinement import refine

        made = refine(made, provider, profile, settings, names)
    return made
