"""The recorded corpus and small tables of cases, with the rows that must come out.

Every branch of the kernels has a case. Texts and offsets of documents and segments are worked
out by SQL from the cases' blocks. The other expected rows, in ``golden.json``, were written
down from a run and then read through against the rules; they guard against changes.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import segments, views
from spanloom.operators.payloads import items_of, renamed, specs_of
from spanloom.plans import providers
from spanloom.plans.engine import Extraction, assemble, extract
from spanloom.plans.refinement import refine
from spanloom.plans.settings import Profile, Settings
from spanloom.plans.storage import shared_folder
from spanloom.queries import STAMP

from recorded_corpus import CASES, Closing, Limited, overflow_blocks, recorded_blocks, recorded_calls

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGS = ["verbatim_match", "end_resolved", "end_inferred_from_next_start", "end_quote_unresolved", "start_via_fallback", "ambiguous", "segments_partial"]


@lru_cache(maxsize=1)
def golden() -> dict[str, dict]:
    """Expected rows by query: DuckDB column types by name, and rows."""
    return json.loads((Path(__file__).parent / "golden.json").read_text(encoding="utf-8"))


def values_sql(columns: dict[str, str], rows: list[list]) -> str:
    """Rows as a SELECT over VALUES."""

    def literal(x: object) -> str:
        if x is None:
            return "NULL"
        return str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"

    names = ", ".join(f'"{c}"' for c in columns)
    shown = ", ".join(f'"{c}"::{kind} AS "{c}"' for c, kind in columns.items())
    return f"SELECT {shown} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({names})"


def expected(fn):
    """Keep a case whose rows are stated in full."""
    name = fn.__name__
    QUERIES[name] = fn
    if name in golden():
        ORACLES[name] = values_sql(golden()[name]["columns"], golden()[name]["rows"])
    if name in DERIVED:
        ORACLES[name] = DERIVED[name]()
    return fn


def _texts_sql() -> str:
    """CTEs that build each case's text from its blocks: a line end after each block, one more after each page in range."""
    rows = [[name, page, i, text] for name, (blocks, _, _) in CASES.items() for i, (page, text) in enumerate(blocks)]
    blocks = values_sql({"doc_id": "VARCHAR", "page": "INT", "ord": "INT", "text": "VARCHAR"}, rows)
    return f"""b AS ({blocks}),
r AS (SELECT DISTINCT doc_id, CASE doc_id WHEN 'exclusive' THEN 2 ELSE 1 END AS lo, CASE doc_id WHEN 'exclusive' THEN 6 ELSE 2 END AS hi FROM b),
g AS (SELECT doc_id, unnest(generate_series(lo, hi))::INT AS page FROM r),
p AS (SELECT g.doc_id, g.page, coalesce(string_agg(text || chr(10), '' ORDER BY ord), '') || chr(10) AS t, count(text) AS n FROM g LEFT JOIN b ON b.doc_id = g.doc_id AND b.page = g.page GROUP BY ALL),
docs AS (SELECT doc_id, string_agg(t, '' ORDER BY page) AS full_text, min(page) AS start_page, max(page) AS end_page, sum(n)::BIGINT AS n_blocks FROM p GROUP BY doc_id)"""


def _segments_sql() -> str:
    """The stated texts, each at its first place in its document."""
    kept = ("doc_id", "unit_id", "segment_index", "role", "text", "metadata")
    told = golden().get("recorded_segments", {"columns": {}, "rows": []})
    at = [list(told["columns"]).index(c) for c in kept if c in told["columns"]]
    stated = values_sql({c: told["columns"][c] for c in kept}, [[r[i] for i in at] for r in told["rows"]]) if at else "SELECT 1"
    return f"""WITH {_texts_sql()}, s AS ({stated}),
a AS (SELECT s.*, instr(full_text, text) - 1 AS doc_offset_start, full_text, start_page FROM s JOIN docs USING (doc_id))
SELECT doc_id, unit_id, segment_index, role, text, metadata, doc_offset_start::BIGINT AS doc_offset_start, (doc_offset_start + length(text))::BIGINT AS doc_offset_end,
       (SELECT min(b.page) FROM b WHERE b.doc_id = a.doc_id AND instr(a.full_text, b.text) - 1 <= a.doc_offset_start
AND a.doc_offset_start < instr(a.full_text, b.text) - 1 + length(b.text))::INT AS page_start
FROM a"""


#: Expected rows that SQL works out.
DERIVED = {
    "recorded_docs": lambda: f"WITH {_texts_sql()} SELECT doc_id, full_text, start_page, end_page, n_blocks FROM docs",
    "recorded_segments": _segments_sql,
}


def extraction(spark: SparkSession) -> Extraction:
    blocks = recorded_blocks(spark)
    return assemble(blocks, recorded_calls(spark, blocks), Settings())


def joined(column: str | Column) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@expected
def recorded_units(spark, sf_dir):
    """Across batches, of several segments, exclusive, ambiguous, interrupted, orphaned, flushed, inferred and unresolved units."""
    e = extraction(spark)
    rows = views.unit_warnings(e.units)
    columns = ["doc_id", "k", "sequence", "status", "start", "end", "n_segments", *FLAGS, "start_quote", "end_quote", "requirement_text"]
    return rows.select(*columns, joined("source_chunk_ids").alias("chunks"), joined("warnings").alias("warnings"))


@expected
def recorded_segments(spark, sf_dir):
    e = extraction(spark)
    return views.segments_view(e.units, e.blocks)


@expected
def recorded_quotes(spark, sf_dir):
    return views.quotes_view(extraction(spark).units)


@expected
def recorded_places(spark, sf_dir):
    """Pages of units in a range whose first and last pages kept no block."""
    e = extraction(spark)
    return views.unit_places(e.units, e.blocks).select("doc_id", "k", "start", "end", "page_start", "page_end")


@expected
def recorded_docs(spark, sf_dir):
    return extraction(spark).docs.select("doc_id", "full_text", "start_page", "end_page", "n_blocks")


@expected
def recorded_calls_view(spark, sf_dir):
    e = extraction(spark)
    made = views.calls_view(e.calls).join(e.calls.select("doc_id", "chunk_id", "n_returned", "n_found", "n_malformed", "malformed"), ["doc_id", "chunk_id"])
    columns = ["doc_id", "chunk_id", "stop_reason", "batch_status", "batch_first_block", "batch_last_block", "batch_doc_offset_start", "batch_doc_offset_end"]
    return made.select(*columns, "n_returned", "n_found", "n_malformed", joined("malformed").alias("malformed"), joined("page_range").alias("pages"), F.size("model_items").alias("n_items"))


@expected
def recorded_statistics(spark, sf_dir):
    e = extraction(spark)
    made = views.statistics(e.calls, e.units, ["doc_id"])
    shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    plain = ["doc_id", "n_total_calls", "n_successful_calls", "n_failed_calls", "total_wall_time_s", "total_input_tokens", "total_output_tokens", "n_units", "n_flagged_units"]
    return made.select(*plain, *[shown(m).alias(m) for m in ("failures_by_outcome", "calls_by_model", "status_counts")])


@expected
def recorded_units_json(spark, sf_dir):
    """Whole artifacts, metadata as objects."""
    e = extraction(spark)
    return views.units_json(e.units.where("doc_id IN ('exclusive', 'cross', 'inferred', 'untrue')"), e.docs, e.blocks, "recorded", STAMP)


@expected
def recorded_requirements_json(spark, sf_dir):
    e = extraction(spark)
    return views.units_json(e.units.where("doc_id = 'cross'"), e.docs, e.blocks, "recorded", STAMP, "requirements")


@expected
def recorded_run_json(spark, sf_dir):
    """Whole traces, with attempts and malformed entries where there are any."""
    e = extraction(spark)
    calls = e.calls.where("doc_id IN ('gone', 'malformed', 'cross')")
    return views.run_json(calls, e.docs, "recorded", STAMP, {"model": "m", "dynamic_budget": False})


@expected
def overflow_calls(spark, sf_dir):
    """Thirty blocks in batches of three, one of which overflows: planned again from there, other batches are not called twice."""
    e = extract(overflow_blocks(spark), Profile("p"), Limited(), Settings(target_input_tokens=38, min_input_tokens=10))
    return e.calls.select("chunk_id", "first_block", "last_block", "overflowed", "batch_status", "n_found")


@expected
def overflow_units(spark, sf_dir):
    e = extract(overflow_blocks(spark), Profile("p"), Limited(), Settings(target_input_tokens=38, min_input_tokens=10))
    return e.units.select("k", "sequence", "start", "end", "verbatim_match", "requirement_text")


@expected
def recorded_inspect(spark, sf_dir):
    """The record of each document's second unit: what the model sent, its calls, its resolution and its slice."""
    e = extraction(spark)
    made = views.inspect(e.units, e.calls, 2, e.docs)
    resolution = F.col("resolution")
    calls = F.transform("llm_calls", lambda c: F.concat_ws(":", c["chunk_id"], c["batch_status"]))
    return made.select(
        "doc_id", "k", "unit_id", joined("metadata").alias("metadata"), joined("model_quotes").alias("model_quotes"), joined(calls).alias("llm_calls"),
        resolution["doc_offset_start"].alias("start"), resolution["doc_offset_end"].alias("end"), resolution["status"].alias("status"), "extracted_slice",
    )


@expected
def recorded_fallback_items(spark, sf_dir):
    """What the model sent, found again from the calls by a unit's start quote where the unit keeps nothing."""
    e = extraction(spark)
    bare = e.units.withColumn("model_parts", F.array().cast("array<string>"))
    return views.model_parts(bare, e.calls).select("doc_id", "k", joined("model_parts").alias("model_parts"))


@expected
def recorded_source_ids(spark, sf_dir):
    """Source ids in order and distinct; numbers and blanks are none."""
    rows = extraction(spark).units.withColumn("metadata", F.transform("specs", lambda s: s["metadata"]))
    made = segments.source_id_lists(rows, ["doc_id"])
    return made.select("doc_id", joined("ids_in_order").alias("ids_in_order"), joined("ids").alias("ids"))


@expected
def recorded_refined(spark, sf_dir):
    """Units with inferred or unresolved ends after a second call; the others stay."""
    e = refine(extraction(spark), Closing(), Profile("recorded"))
    return e.units.select("doc_id", "k", "start", "end", "end_quote", "refined", "status", *FLAGS[:4], "requirement_text").where("doc_id IN ('inferred', 'cross', 'fallback')")


@expected
def recorded_stream(spark, sf_dir):
    """The same units from a stream of one batch at a time that comes in the wrong order."""
    import uuid

    from spanloom.streaming.stitch import stitch_stream

    blocks = recorded_blocks(spark)
    calls = recorded_calls(spark, blocks)
    docs = extraction(spark).docs.select("doc_id", "full_text")
    last = calls.groupBy("doc_id").agg(F.max("chunk_id").alias("n"))
    text = F.substring("full_text", (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int"))
    rows = calls.join(docs, "doc_id").join(last, "doc_id").select("doc_id", "chunk_id", "char_start", "char_end", text.alias("text"),
        "payload_json", (F.col("chunk_id") == F.col("n")).alias("is_last"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for chunk in (3, 1, 2):  # the files of a stream, one trigger each
        rows.where(F.col("chunk_id") == chunk).coalesce(1).write.mode("append").parquet(f"{root}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    sink = stitch_stream(source).select("doc_id", "k", "sequence", "status", "start", "end", joined("source_chunk_ids").alias("chunks"), "requirement_text")
    run = sink.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(sink.schema).parquet(f"{root}/out")


PAYLOADS = [
    '{"requirements": [{"status": "complete", "start_quote": "a", "end_quote": "b"}, 7, {"status": "complete"}]}',
    '{"requirements": "[{\\"status\\": \\"truncated_at_start\\"}]"}',
    '{"requirements": "no json"}',
    '{"requirements": 7}',
    '{"requirements": [{"segments": [{"start_quote": "x", "role": "  ", "metadata": {"n": 1}}, {"end_quote": 5, "role": " context "}]}, {"segments": [1]}]}',
    "{",
    '{"other": 1}',
]
FOREIGN = {"start_quote": "from", "end_quote": "to"}


@expected
def payload_items(spark, sf_dir):
    """Items and specs of payloads in every shape, and of one with foreign field names."""
    rows = []
    for n, payload in enumerate([*PAYLOADS, '{"requirements": [{"from": "a", "to": "b"}, {"segments": [{"from": "c", "role": "r"}]}]}']):
        items, bad = items_of(payload)
        rows += [(n, -1, -1, reason, None, None, None, None) for reason in bad]
        for i, raw in enumerate(items):
            specs, reason = specs_of(renamed(raw, FOREIGN if n == len(PAYLOADS) else None))
            rows += [(n, i, -1, reason, None, None, None, None)] * bool(reason)
            rows += [(n, i, j, None, s["start_quote"], s["end_quote"], s["role"], None if s["metadata"] is None else json.dumps(s["metadata"])) for j, s in enumerate(specs)]
    return spark.createDataFrame(rows, "payload int, item int, spec int, reason string, start_quote string, end_quote string, role string, metadata string")


@expected
def provider_rules(spark, sf_dir):
    """Stop reasons, arguments, retries, fallbacks, budgets and windows."""
    rows = [("stop_reason", f"{f} {c}", providers.stop_reason(f, c)) for f, c in (("length", True), ("tool_calls", False), ("stop", True), ("stop", False), (None, False))]
    for raw in ('{"a": 1}', "{", "[1]"):
        try:
            rows.append(("arguments", raw, json.dumps(providers.arguments(raw))))
        except RuntimeError:
            rows.append(("arguments", raw, "error"))
    failures = {"a": providers.CallError("busy", status=503), "b": providers.CallError("gone", missing_model=True), "d": providers.CallError("refused", status=401)}

    def send(model: str, prompt: str, text: str, **options: object) -> dict:
        if model in failures:
            raise failures[model]
        return providers.call({"requirements": []}, output_tokens=int(options["max_tokens"]))

    for models in ("a,b,a,c", "d,c", "b"):
        first, _, more = models.partition(",")
        chain = providers.Chain(send, Settings(model=first, fallback_models=more, max_retries=2, retry_wait_s=0, max_tokens=77))
        try:
            made = chain.propose("p", "t", [])
            told = " ".join(f"{x['model']}:{x['outcome']}" for x in json.loads(made["attempts"])) + f" {made['output_tokens']}"
        except RuntimeError as e:
            told = str(e)
        rows.append(("chain", models, told))
    windows = Settings(model="m", context_windows="m=30000, n=18000", dynamic_budget=True, target_input_tokens=12000)
    rows += [("window", m or "", str(windows.context_window(m))) for m in (None, "n", "other")]
    rows += [("budget", str(n), str(windows.budget("x" * n))) for n in (0, 8000, 10**6)]
    rows.append(("budget", "fixed", str(Settings(target_input_tokens=500).budget("x" * 10**6))))
    return spark.createDataFrame(rows, "rule string, given string, made string")
