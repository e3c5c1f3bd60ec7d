"""The four flat views of an extraction, its statistics and its JSON artifacts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import run_id, span_key, text_slice, title
from spanloom.operators.blocks import locate
from spanloom.operators.segments import warnings


def unit_id(sequence: Column) -> Column:
    return F.when(sequence > 0, sequence.cast("string")).otherwise(F.lit(""))


def page_of(units: DataFrame, blocks: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the page of the block that holds an offset column; null between blocks."""
    asked = units.select("doc_id", F.col(column).alias("offset")).where("offset >= 0").distinct()
    found = locate(asked, blocks).select("doc_id", F.col("offset").alias(column), F.col("page").alias(name))
    return units.join(found, ["doc_id", column], "left")


def unit_warnings(units: DataFrame) -> DataFrame:
    named = {c: F.col(c) for c in ("start", "end_resolved", "ambiguous", "start_via_fallback", "segments_partial", "n_segments")}
    return units.withColumn("warnings", warnings(named | {"text": F.col("requirement_text"), "chunk_ids": F.col("source_chunk_ids")}))


def units_view(units: DataFrame, docs: DataFrame) -> DataFrame:
    """One row a unit; flags, offsets and warnings."""
    made = unit_warnings(units).join(docs.select("doc_id", "doc_hash"), "doc_id")
    return made.select(
        "doc_id", unit_id(F.col("sequence")).alias("unit_id"), "sequence", span_key(F.col("doc_hash"), F.col("start")).alias("span_key"), "status", "verbatim_match", "end_resolved",
        "end_inferred_from_next_start", "end_quote_unresolved", "n_segments", F.size("segments").alias("n_segments_resolved"), "segments_partial",
        F.col("start").alias("doc_offset_start"), F.col("end").alias("doc_offset_end"), "source_chunk_id", "source_chunk_ids", "warnings",
    )


def segments_view(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row a resolved segment, with its text, page and the metadata of the spec at its index."""
    rows = units.select("doc_id", "sequence", "specs", F.posexplode("segments").alias("segment_index", "s"))
    metadata = F.get("specs", F.col("segment_index"))["metadata"]
    rows = rows.select(
        "doc_id", unit_id(F.col("sequence")).alias("unit_id"), "segment_index", "s.role", "s.text", metadata.alias("metadata"),
        F.col("s.start").alias("doc_offset_start"), F.col("s.end").alias("doc_offset_end"),
    )
    return page_of(rows, blocks, "doc_offset_start", "page_start").select(*rows.columns, "page_start")


def unit_places(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds the pages of a unit's first and last character, and the box (x0, y0, x1, y1) of the block where it starts."""
    last = units.withColumn("_last", F.when(F.col("end") > 0, F.col("end") - 1))
    made = page_of(page_of(last, blocks, "start", "page_start"), blocks, "_last", "page_end").drop("_last")
    if "x0" not in blocks.columns:
        return made.withColumn("bbox", F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>"))
    found = locate(units.select("doc_id", F.col("start").alias("offset")).where("offset >= 0").distinct(), blocks)
    boxes = found.join(blocks.select("doc_id", "block_idx", F.struct("x0", "y0", "x1", "y1").alias("bbox")), ["doc_id", "block_idx"])
    return made.join(boxes.select("doc_id", F.col("offset").alias("start"), "bbox"), ["doc_id", "start"], "left")


def quotes_view(units: DataFrame) -> DataFrame:
    """One row a segment as the model sent it."""
    rows = units.select("doc_id", "sequence", F.posexplode("specs").alias("segment_index", "s"))
    return rows.select("doc_id", unit_id(F.col("sequence")).alias("unit_id"), "segment_index", "s.start_quote", "s.end_quote", "s.end_before_quote", "s.start_after_quote", "s.role", "s.metadata")


def calls_view(calls: DataFrame) -> DataFrame:
    """One row a call; the pages are those of its first and last block."""
    return calls.select(
        "doc_id", "chunk_id", "model_used", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "stop_reason", "batch_status",
        F.col("first_block").alias("batch_first_block"), F.col("last_block").alias("batch_last_block"),
            F.col("char_start").alias("batch_doc_offset_start"), F.col("char_end").alias("batch_doc_offset_end"),
        F.array("page_start", "page_end").alias("page_range"), "model_items",
    )


def histogram(df: DataFrame, value: Column, keys: list[str], name: str) -> DataFrame:
    counted = df.where(value.isNotNull()).groupBy(*keys, value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_v", "_n")))).alias(name))


def statistics(calls: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, tokens, failures and units of each key, with histograms by outcome, model and status."""
    ok = F.col("batch_status").isin("ok", "empty")
    a = calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_total_calls"), F.count_if(ok).alias("n_successful_calls"), F.count_if(~ok).alias("n_failed_calls"), F.round(F.sum("response_time_s"), 3).alias("total_wall_time_s"),
        *[F.sum(f"{c}_tokens").alias(f"total_{c}_tokens") for c in ("input", "output", "cache_creation", "cache_read")],
    )
    b = unit_warnings(units).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_units"), F.count_if(F.size("warnings") > 0).alias("n_flagged_units"))
    out = a.join(b, keys, "left")
    for more in (histogram(calls.where(~ok), F.col("batch_status"), keys, "failures_by_outcome"),
        histogram(calls, F.col("model_used"), keys, "calls_by_model"), histogram(units, F.col("status"), keys, "status_counts")):
        out = out.join(more, keys, "left")
    return out.na.fill(0, ["n_units", "n_flagged_units"])


def source_kind(parser: Column) -> Column:
    return F.when(parser == "text", "text").otherwise("pdf")


def _segment_pages(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each unit the page ranges of its segments, in their order."""
    rows = units.select("doc_id", "k", F.posexplode("segments").alias("i", "s"))
    rows = rows.select("doc_id", "k", "i", F.col("s.start").alias("_a"), (F.col("s.end") - 1).alias("_b"))
    rows = page_of(page_of(rows, blocks, "_a", "p"), blocks, "_b", "q")
    listed = F.array_sort(F.collect_list(F.struct("i", F.array("p", "q").alias("r"))))
    return rows.groupBy("doc_id", "k").agg(F.transform(listed, lambda x: x["r"]).alias("_pages"))


def units_json(units: DataFrame, docs: DataFrame, blocks: DataFrame, framework: str, stamp: str, word: str = "units") -> DataFrame:
    """One JSON document a source document (doc_id, json): its units with texts, quotes, trace and validation. ``word``: units or requirements.

    Metadata are objects. A segment's are null where not every spec was resolved.
    """
    run = run_id(F.lit(stamp), F.col("doc_hash"))
    rows = unit_places(unit_warnings(units), blocks).join(docs.select("doc_id", "doc_hash"), "doc_id")
    rows = rows.join(_segment_pages(units, blocks), ["doc_id", "k"], "left")
    same = F.size("specs") == F.size("segments")
    segment = F.transform("segments", lambda s, i: F.struct(
        F.array(s["start"], s["end"]).alias("doc_offset"), F.get("_pages", i).alias("page_range"), s["role"].alias("role"), F.lit(True).alias("resolved"),
        F.when(same, F.try_parse_json(F.get("specs", i)["metadata"])).alias("metadata"),
    ))
    first = F.get(F.filter(F.transform("specs", lambda s: s["metadata"]), lambda m: m.isNotNull() & (m != "{}")), F.lit(0))
    pairs = F.transform("specs", lambda s: F.struct(
        *[s[c].alias(c) for c in ("start_quote", "end_quote", "end_before_quote", "start_after_quote", "role")], F.try_parse_json(s["metadata"]).alias("metadata"),
    ))
    number, call = unit_id(F.col("sequence")), F.col("source_chunk_id")
    unit = F.struct(
        F.format_string("%s#r%04d", run, F.col("k")).alias("uid"), number.alias("unit_id"), number.alias("requirement_id"), "sequence",
        span_key(F.col("doc_hash"), F.col("start")).alias("span_key"), F.try_parse_json(F.coalesce(first, F.lit("{}"))).alias("metadata"), title(F.col("requirement_text")).alias("title"),
        F.col("requirement_text").alias("extracted_text"), "requirement_text", "questionnaire_text", "context_text",
        F.struct(F.array("start", "end").alias("doc_offset"), F.array("page_start", "page_end").alias("page_range"), "bbox").alias("source"),
        F.struct(F.col("start_quote").alias("start"), F.col("end_quote").alias("end"), pairs.alias("segment_quote_pairs")).alias("quotes"), segment.alias("segments"),
        F.struct(call.alias("chunk_id"), F.concat(run, F.lit("#c"), call.cast("string")).alias("extraction_call_id"), F.col("source_chunk_ids").alias("spans_chunks")).alias("trace"),
        F.struct(
            "status", "verbatim_match", "end_resolved", "end_inferred_from_next_start", "end_quote_unresolved", "n_segments", F.size("segments").alias("n_segments_resolved"),
            "segments_partial", "warnings",
        ).alias("validation"),
    )
    parts = rows.select("doc_id", "doc_hash", "k", F.to_json(unit, {"ignoreNullFields": "false"}).alias("u"))
    return _wrapped(parts, run, framework, stamp, "k", word)


def _wrapped(parts: DataFrame, run: Column, framework: str, stamp: str, order: str, word: str, more: Column | None = None) -> DataFrame:
    """Whole documents around the JSON text ``u`` of their parts, in order."""
    head = [F.lit("3.0").alias("schema_version"), run.alias("run_id"), F.col("doc_hash").alias("document_id"), F.lit(framework).alias("framework")]
    head = [*head, F.lit(stamp).alias("generated_at"), F.size("_l").cast("int").alias(f"n_{word}"), *([] if more is None else [more])]
    listed = parts.groupBy("doc_id", "doc_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "u"))), lambda x: x["u"]).alias("_l"))
    text = F.to_json(F.struct(*head), {"ignoreNullFields": "false"})
    body = F.concat(F.expr("left(_h, length(_h) - 1)"), F.lit(f',"{word}":['), F.array_join("_l", ","), F.lit("]}"))
    return listed.withColumn("_h", text).select("doc_id", body.alias("json"))


def run_json(calls: DataFrame, docs: DataFrame, framework: str, stamp: str, settings: dict[str, object] | None = None) -> DataFrame:
    """One JSON trace a document (doc_id, json): every call with its input, model and output; never a batch's text.

    ``attempts`` is there if a call took more than one or one failed, ``malformed`` if there is any.
    """
    run = run_id(F.lit(stamp), F.col("doc_hash"))
    rows = calls.join(docs.select("doc_id", "doc_hash"), "doc_id")
    whole = F.struct(
        "chunk_id", F.concat(run, F.lit("#c"), F.col("chunk_id").cast("string")).alias("extraction_call_id"),
        F.struct(F.array("first_block", "last_block").alias("block_range"), F.array("page_start", "page_end").alias("page_range"),
            F.array("char_start", "char_end").alias("doc_offset"), "est_input_tokens", "chunk_hash").alias("input"),
        F.struct("model_used", "stop_reason", "batch_status", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "response_time_s").alias("call"),
        F.struct("n_returned", "n_malformed", F.transform("model_items", F.try_parse_json).alias("items")).alias("model_output"),
    )
    tried = F.from_json("attempts", "array<struct<model:string,attempt_no:int,duration_s:double,outcome:string,error_message:string>>")
    shown = (F.size(tried) > 1) | F.exists(tried, lambda x: x["outcome"] != "ok")
    options = F.struct(F.when(shown, tried).alias("attempts"), F.when(F.size("malformed") > 0, F.col("malformed")).alias("malformed"))
    extra, text = F.to_json(options), F.to_json(whole, {"ignoreNullFields": "false"})  # null options are left out
    parts = rows.select("doc_id", "doc_hash", "chunk_id", text.alias("_t"), extra.alias("_e"))
    joined = F.when(F.col("_e") == "{}", F.col("_t")).otherwise(F.concat(F.expr("left(_t, length(_t) - 1)"), F.lit(","), F.expr("substring(_e, 2)")))
    more = F.try_parse_json(F.lit(json.dumps(settings or {}))).alias("settings")
    return _wrapped(parts.select("doc_id", "doc_hash", "chunk_id", joined.alias("u")), run, framework, stamp, "chunk_id", "chunks", more)


def blocks_json(blocks: DataFrame, docs: DataFrame, kind: str = "text", include_full_text: bool = False) -> DataFrame:
    """One JSON document a source document (doc_id, json): its blocks."""
    box = [F.array("x0", "y0", "x1", "y1").alias("bbox")] if "x0" in blocks.columns else []
    path = [F.col("path")] if "path" in blocks.columns else []
    block = F.struct("block_idx", "page", "page_block_idx", "text", "char_start", "char_end", *box)
    docs = docs.join(blocks.groupBy("doc_id").agg(F.first("path").alias("path")), "doc_id") if path else docs
    listed = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(block)).alias("blocks")).join(docs, "doc_id")
    extra = [F.col("full_text")] if include_full_text else []
    whole = F.struct(F.lit(1).alias("schema_version"), F.struct(F.lit(kind).alias("kind"), *path,
        F.substring("doc_hash", 1, 12).alias("hash_prefix")).alias("source"),
        F.struct("n_blocks", "start_page", "end_page", F.length("full_text").alias("n_chars")).alias("summary"), "blocks", *extra)
    return listed.select("doc_id", F.to_json(whole).alias("json"))


def lookup(units: DataFrame, which: int | str) -> DataFrame:
    """Units of that sequence number or unit id, the first of each document; unresolved units have 0 and ''. A bool is neither."""
    number = F.col("sequence") == (int(which) if not isinstance(which, str) or which.isdigit() else -1)
    found = units.where(F.lit(not isinstance(which, bool)) & (number | (unit_id(F.col("sequence")) == str(which))))
    first = Window.partitionBy("doc_id").orderBy("k")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def model_parts(units: DataFrame, calls: DataFrame) -> DataFrame:
    """What the model sent for each unit (doc_id, k, model_parts).

    Where a unit keeps none, the first item of its calls whose start quote, or first segment's, is the unit's.
    """
    items = calls.select("doc_id", "chunk_id", F.posexplode("model_items").alias("i", "item"))
    start = F.coalesce(F.get_json_object("item", "$.start_quote"), F.get_json_object("item", "$.segments[0].start_quote"))
    bare = units.where("size(model_parts) = 0").select("doc_id", "k", "start_quote", F.explode("source_chunk_ids").alias("chunk_id"))
    found = bare.join(items.withColumn("quoted", start), ["doc_id", "chunk_id"]).where("quoted = start_quote")
    found = found.groupBy("doc_id", "k").agg(F.min_by("item", F.struct("chunk_id", "i")).alias("fallback"))
    own = F.when(F.size("model_parts") > 0, F.col("model_parts")).when(F.col("fallback").isNotNull(), F.array("fallback")).otherwise(F.array().cast("array<string>"))
    return units.select("doc_id", "k", "model_parts").join(found, ["doc_id", "k"], "left").select("doc_id", "k", own.alias("model_parts"))


def inspect(units: DataFrame, calls: DataFrame, which: int | str, docs: DataFrame | None = None) -> DataFrame:
    """A unit's record: metadata, what the model sent, its calls, how it was resolved and, with ``docs``, its exact slice."""
    hit = lookup(units, which)
    told = ["chunk_id", "model_used", "stop_reason", "batch_status", "input_tokens", "output_tokens", "response_time_s", "payload_json"]
    per = hit.withColumn("chunk_id", F.explode_outer("source_chunk_ids")).join(calls.select("doc_id", *told), ["doc_id", "chunk_id"], "left")
    grouped = per.groupBy("doc_id", "k").agg(F.array_sort(F.collect_list(F.struct(*told))).alias("llm_calls"))
    rows = unit_warnings(hit).drop("model_parts").join(grouped, ["doc_id", "k"]).join(model_parts(hit, calls), ["doc_id", "k"])
    flags = ["status", "verbatim_match", "end_resolved", "end_inferred_from_next_start", "end_quote_unresolved", "start_via_fallback", "ambiguous", "segments_partial"]
    resolution = F.struct(F.col("start").alias("doc_offset_start"), F.col("end").alias("doc_offset_end"), *flags, "n_segments", "warnings")
    rows = rows.select(
        "doc_id", "k", unit_id(F.col("sequence")).alias("unit_id"), "sequence", F.transform("specs", lambda s: s["metadata"]).alias("metadata"),
        F.col("model_parts").alias("model_quotes"), "llm_calls", resolution.alias("resolution"),
    )
    if docs is None:
        return rows
    r = F.col("resolution")
    whole = F.when((r["n_segments"] == 1) & (r["doc_offset_start"] >= 0) & (r["doc_offset_end"] > r["doc_offset_start"]), text_slice(F.col("full_text"), r["doc_offset_start"], r["doc_offset_end"]))
    return rows.join(docs.select("doc_id", "full_text"), "doc_id").withColumn("extracted_slice", whole).drop("full_text")
