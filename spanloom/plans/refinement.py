"""Ask again for units whose end was inferred or not found."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import KNOWN_ROLES
from spanloom.operators.blocks import slices
from spanloom.operators.payloads import batch_status
from spanloom.operators.refine import merge, windows
from spanloom.operators.resolve import role_texts
from spanloom.operators.stitch import TextWindow
from spanloom.plans.calls import TokenBucket, in_order
from spanloom.plans.engine import SEGMENT, SENT, Extraction, arrow_schema, batch_units, batches_of, failed_call, rows_of, struct_of
from spanloom.plans.providers import Provider
from spanloom.plans.settings import Profile, Settings, system_prompt
from spanloom.plans.storage import partitions, stored

FOUND = f"new_start long, new_end long, new_end_quote string, new_end_resolved boolean, new_segments array<{SEGMENT}>, " + ", ".join(f"new_{r}_text string" for r in KNOWN_ROLES)
ASKED = "chunk_hash string, n_returned int, n_found int, n_malformed int, malformed array<string>, batch_status string, model_items array<string>"


def _moved(text: TextWindow, segments: list[dict], end: int) -> dict:
    """The unit's segments and texts if its last segment ends there."""
    spans = [(int(s["start"]), int(s["end"]), s["role"]) for s in segments]
    spans = [*spans[:-1], (spans[-1][0], end, spans[-1][2])] if spans else []
    made = {"new_segments": [{"start": a, "end": b, "role": r, "text": text[a:b]} for a, b, r in spans]}
    return made | {f"new_{r}_text": t for r, t in role_texts(text, spans).items()}


def _asked(provider: Provider, prompt: str, settings: Settings, names: dict[str, str] | None, fields: str):
    """One call for each window; its call's columns, and the units found in it."""
    schema = arrow_schema(fields)

    def one(w: dict) -> dict:
        start, text = int(w["span_start"]), w["text"] or ""
        row = {c: w[c] for c in ("doc_id", "k", "span_start", "span_end")} | {"chunk_hash": hashlib.sha256(text.encode()).hexdigest()[:16]}
        try:
            made = provider.propose(prompt, text, [{"text": text, "role": None, "label": None, "block_idx": 0}]) | {"failed": False}
            units, items, bad = batch_units(made["payload_json"], text, start, settings.keep_lone_ends, names)
            status = batch_status(len(units), sum(u.verbatim for u in units), len(bad), made["stop_reason"])
        except Exception as e:  # noqa: BLE001  a failed call leaves its unit as it is
            made, units, items, bad, status = failed_call(e), [], [], [], "api_error"
        whole = TextWindow(start, text)
        found = [{"new_start": u.start, "new_end": u.end, "new_end_quote": u.end_quote, "new_end_resolved": u.end_resolved} | _moved(whole, list(w["segments"]), u.end) for u in units]
        told = {"n_returned": len(items), "n_found": len(units), "n_malformed": len(bad), "malformed": bad, "batch_status": status, "model_items": [json.dumps(x, ensure_ascii=False) for x in items]}
        return row | made | told | {"found": found}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = TokenBucket(settings.tokens_per_s)

        def paced(w: dict) -> dict:
            bucket.take((len(prompt) + len(w["text"] or "")) / 4)
            return one(w)

        yield from batches_of(in_order(paced, rows_of(batches), settings.calls_in_flight), schema)

    return ask


def refine(extraction: Extraction, provider: Provider, profile: Profile, settings: Settings | None = None, names: dict[str, str] | None = None) -> Extraction:
    """One call for each unit that needs it, on its window; ends that are acceptable replace the old ones.

    A refined unit's last segment, texts and flags follow its new end. The second calls join the first ones, numbered behind
    them in the order of their units, with blocks from -1 to -1: their tokens and failures count, and they are written before
    they are read. ``names`` maps our field names to those of the payloads. Every window is a row of its own, with its own text.
    """
    settings = settings or Settings.of(extraction.blocks.sparkSession)
    blocks, calls = extraction.blocks, extraction.calls
    ends = blocks.groupBy("doc_id").agg(F.max("char_end").alias("range_end"))
    spans = windows(extraction.units, ends).select("doc_id", "k", "span_start", "span_end", "segments")
    texts = slices(spans.select("doc_id", "k", F.col("span_start").alias("start"), F.col("span_end").alias("end")), blocks, ["k"])
    kind, n = blocks.schema["doc_id"].dataType.simpleString(), partitions(blocks.sparkSession)
    fields = f"doc_id {kind}, k int, span_start long, span_end long, {SENT}, {ASKED}, found array<{struct_of(FOUND)}>"
    rows = spans.join(texts, ["doc_id", "k"]).repartition(n, "doc_id", "k")
    asked = stored(rows.mapInArrow(_asked(provider, system_prompt(profile, refining=True), settings, names, fields), fields), "refined")
    units = merge(extraction.units, asked.select("doc_id", "k", "span_end", F.inline("found")))
    fresh = {f"{r}_text": F.col(f"new_{r}_text") for r in KNOWN_ROLES} | {"segments": F.col("new_segments")}
    flags = {"end_resolved": F.lit(True), "segments_partial": F.lit(False), "status": F.lit("complete"), "verbatim_match": F.col("new_requirement_text") != ""}
    units = units.withColumns({c: F.when(F.col("refined"), v).otherwise(F.col(c)) for c, v in (fresh | flags).items()})
    units = units.drop("new_segments", *[f"new_{r}_text" for r in KNOWN_ROLES])

    last = calls.groupBy("doc_id").agg(F.max("chunk_id").alias("_last"))
    order = Window.partitionBy("doc_id").orderBy("k")
    none = F.lit(-1).cast("long")
    given = {
        "chunk_id": F.col("_last") + F.row_number().over(order), "first_block": none, "last_block": none, "char_start": F.col("span_start"), "char_end": F.col("span_end"),
        "est_input_tokens": F.floor((F.col("span_end") - F.col("span_start")) / 4) + 1, "overflowed": F.lit(False),
    }
    more = asked.join(last, "doc_id").withColumns(given)
    have = {c: F.col(c) if c in more.columns else F.lit(None) for c in calls.columns}
    more = more.select(*[have[f.name].cast(f.dataType).alias(f.name) for f in calls.schema.fields])
    return Extraction(extraction.docs, blocks, calls.unionByName(more), units)


def save_json(rows: DataFrame, folder: str) -> None:
    """Write artifacts (doc_id, json), a JSON line a document, below ``folder`` by any file system Spark knows."""
    rows.select("json").write.mode("overwrite").text(folder)


def save_pretty(text: str, path: str | Path) -> None:
    """Write one artifact to a local file, indented; missing folders are made."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(pretty(text), encoding="utf-8")


def pretty(text: str) -> str:
    """An artifact indented for reading, non-ASCII kept."""
    return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
