"""Readers, batching cases, refinement, providers, overflow and streaming."""

import hashlib
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F
from recorded_corpus import Limited, overflow_blocks

from spanloom.functions import text as T
from spanloom.operators import batching, blocks, refine, segments
from spanloom.plans.engine import assemble, extract, progress
from spanloom.plans.providers import CallError, Chain, RuleBased, call
from spanloom.plans.settings import Profile, Settings, read_prompt, system_prompt
from spanloom.sources import readers


def doc(spark, texts, page=lambda i: 1):
    rows = spark.createDataFrame([("d", i, page(i), t, None, str(i)) for i, t in enumerate(texts)], "doc_id string, ord int, page int, text string, role string, label string")
    return blocks.with_offsets(rows)


def plans(df, budget, pattern=None):
    return [(r.first_block, r.last_block, r.n_units) for r in batching.plan_batches(df, budget, pattern).orderBy("batch_no").collect()]


def test_read_text(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("First para line one\r\nline two\n\n \nSecond hyphen-\nated para\n".encode())
    got = readers.read(spark, str(tmp_path / "a.TXT"), start_page=3).orderBy("block_idx").collect()
    assert [r.text for r in got] == ["First para line one line two", "Second hyphenated para"]
    assert [(r.char_start, r.char_end) for r in got] == [(0, 28), (29, 51)]
    for bad in ("a.docx", "plain"):
        with pytest.raises(ValueError):
            readers.read(spark, bad)


def test_quarantine(spark, tmp_path):
    (tmp_path / "good.txt").write_bytes(b"fine")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    good, bad = readers.quarantine(spark, str(tmp_path))
    assert (good.count(), bad.count()) == (1, 1)


def test_raw_blocks_are_read_by_column(spark):
    rows = [(1, 10, 300, "left low"), (2, 320, 100, "right"), (3, 12, 100, "left high"), (4, 10, 5, "header"), (5, 10, 780, "12")]
    raw = spark.createDataFrame([("d", 1, n, float(x), float(y), float(x + 100), float(y + 10), 612.0, 792.0, t) for n, x, y, t in rows], readers.RAW)
    assert [r.text for r in readers.from_raw_blocks(raw).orderBy("block_idx").collect()] == ["left high", "left low", "right"]
    assert [r.text for r in readers.from_raw_blocks(raw, drop_margins=False).orderBy("block_idx").collect()] == ["header", "left high", "left low", "right"]


def test_noise(spark):
    df = spark.createDataFrame([("11",), ("(1)",), (" ",), ("1.–",), ("12345",), ("page 3 of 9",)], "t string")
    assert [r.t for r in df.where(~blocks.is_noise(F.col("t"), None, (r"page \d+ of \d+",))).collect()] == ["(1)", "12345"]


def test_empty_pages_keep_their_line_end(spark):
    df = doc(spark, ["ab", "c"], page=lambda i: 1 + 2 * i)
    assert [(r.char_start, r.char_end) for r in df.orderBy("block_idx").collect()] == [(0, 2), (5, 6)]
    text = blocks.documents(df).first().full_text
    assert text[5:6] == "c" and text == "ab\n\n\nc\n\n"


def test_whole_units_are_packed(spark):
    units = [t for n in range(3) for t in [f"HEAD {n}", *["w" * 25] * 4]]
    assert plans(doc(spark, units), 40, "HEAD") == [(0, 4, 1), (5, 9, 1), (10, 14, 1)]
    assert plans(doc(spark, units), 10000, "HEAD") == [(0, 14, 3)]
    assert plans(doc(spark, ["intro " * 14, *units]), 40, "HEAD")[0] == (0, 0, 0)
    big = ["HEAD a", "x" * 4000, "HEAD b", "y" * 40]
    assert plans(doc(spark, big), 50, "HEAD") == [(0, 1, 1), (2, 3, 1)]
    assert plans(doc(spark, big), 50, "NONE")[0] == (0, 0, 1)


def test_headings(spark):
    pattern = r"§ (\d+\.\d+) [A-Z]"
    text = "§ 160.103 Definitions.\nsee § 164.501 of this\n 1. § 160.102 Applicability\n§ 160.103 Again"
    df = spark.createDataFrame([("d", text)], "doc_id string, text string")
    assert sorted(r.ident for r in batching.headings(df, pattern, tolerant=False).collect()) == ["160.103"]


def test_titles(spark):
    df = spark.createDataFrame([("Applicability. Applies…",), (".5 rule",), ("  ",), (None,), ("x" * 200,)], "t string")
    assert [r[0] for r in df.select(T.title(F.col("t"))).collect()] == ["Applicability", "5 rule", None, None, "x" * 80]


def test_refinement(spark):
    units = spark.createDataFrame([("d", 0, 0, 8, "e", True, False), ("d", 1, 8, 11, None, False, True)], "doc_id string, k int, start long, end long, end_quote string, end_inferred_from_next_start boolean, end_quote_unresolved boolean")
    ends = spark.createDataFrame([("d", 11)], "doc_id string, range_end long")
    spans = refine.windows(units, ends)
    assert [(r.k, r.span_start, r.span_end) for r in spans.orderBy("k").collect()] == [(0, 0, 8), (1, 8, 11)]
    for rows, wanted in (([(0, 7, "x", True)], 7), ([(0, 8, "x", True)], 8), ([(0, 11, "x", True)], 8), ([(1, 7, "x", True)], 8), ([(0, 7, "x", True), (3, 4, "y", True)], 8), ([(0, 7, None, True)], 8), ([(0, 7, "x", False)], 8)):
        new = spark.createDataFrame([("d", 0, 8, *r) for r in rows], "doc_id string, k int, span_end long, new_start long, new_end long, new_end_quote string, new_end_resolved boolean")
        got = {r.k: r for r in refine.merge(units, new).collect()}
        assert got[0].end == wanted and got[1].end == 11
        assert got[0].refined == (rows[0][1] == wanted and len(rows) == 1 and rows[0][0] == 0 and rows[0][2] is not None and rows[0][3])


def test_warnings_and_ids(spark):
    df = spark.createDataFrame([(-1, "", ['{"req_id": 5}', '{"req_id": " ", "subcategory_id": "b"}', "no json"])], "start int, t string, m array<string>")
    unit = {"start": F.col("start"), "end_resolved": F.lit(False), "text": F.col("t"), "ambiguous": F.lit(False), "start_via_fallback": F.lit(False), "segments_partial": F.lit(False), "n_segments": F.lit(1), "chunk_ids": F.array(F.lit(1))}
    got = df.select(segments.warnings(unit).alias("w"), segments.source_id(F.col("m")).alias("i")).first()
    assert (got.w, got.i) == (["start_unresolved", "end_unresolved", "empty_text"], "b")


class Overflowing:
    """Answers max_tokens for batches of more than two blocks."""

    def propose(self, prompt, text, blocks):
        made = RuleBased().propose(prompt, text, blocks)
        return made | {"stop_reason": "max_tokens", "payload_json": "{}"} if len(blocks) > 2 else made


class Failing:
    def propose(self, prompt, text, blocks):
        if "two" in text:
            raise ConnectionError("down")
        return RuleBased().propose(prompt, text, blocks)


TEXTS = [f"block {w} starts here and it ends over there {w}" for w in ("zero", "one", "two", "three", "four", "five")]


def test_overflow_is_planned_again(spark):
    rows = doc(spark, TEXTS)
    e = extract(rows, Profile("p"), Overflowing(), Settings(target_input_tokens=70, min_input_tokens=10))
    calls = e.calls.orderBy("chunk_id").collect()
    assert calls[0].overflowed and calls[0].batch_status == "overflow"
    done = [b for c in calls if not c.overflowed for b in range(c.first_block, c.last_block + 1)]
    assert done == list(range(6))
    got = e.units.orderBy("k").collect()
    text = e.docs.first().full_text
    assert [text[u.start : u.end] for u in got] == TEXTS and all(u.verbatim_match for u in got)


def test_a_failed_call_costs_its_batch(spark):
    e = extract(doc(spark, TEXTS), Profile("p"), Failing(), Settings(target_input_tokens=13))
    assert [c.batch_status for c in e.calls.orderBy("chunk_id").collect()] == ["ok", "ok", "api_error", "ok", "ok", "ok"]
    assert e.units.count() == 5


def test_chain_retries_and_falls_back():
    seen = []

    def send(model, prompt, text, **options):
        seen.append(model)
        assert options == {"max_tokens": 8000, "temperature": 0.0}
        if model == "a":
            raise CallError("busy", status=503)
        if model == "b":
            raise CallError("gone", missing_model=True)
        return call({"requirements": []}, output_tokens=3)

    made = Chain(send, Settings(model="a", fallback_models="b, a, c", max_retries=2, retry_wait_s=0)).propose("p", "t", [])
    assert seen == ["a", "a", "b", "c"] and made["model_used"] == "c" and made["output_tokens"] == 3
    assert [x["outcome"] for x in json.loads(made["attempts"])] == ["api_error", "api_error", "not_found", "ok"]
    with pytest.raises(RuntimeError):
        Chain(send, Settings(model="b")).propose("p", "t", [])


def test_settings_and_prompt(spark):
    spark.conf.set("spark.spanloom.target_input_tokens", "77")
    spark.conf.set("spark.spanloom.drop_margin_blocks", "No")
    assert Settings.of(spark).target_input_tokens == 77 and not Settings.of(spark).drop_margin_blocks
    spark.conf.unset("spark.spanloom.target_input_tokens")
    spark.conf.unset("spark.spanloom.drop_margin_blocks")
    assert "find rules" in system_prompt(Profile("p", " find rules ")) and T.input_token_budget(400, cap=5000) == 5000 and T.input_token_budget(10**9) == 0


class Endless:
    """Quotes starts alone at first, and the end when asked again."""

    def propose(self, prompt, text, blocks):
        if "exactly one item" in prompt:
            return call({"requirements": [{"status": "complete", "start_quote": " ".join(text.split()[:3]), "end_quote": " ".join(text.split()[3:7])}]})
        return call({"requirements": [{"start_quote": " ".join(b["text"].split()[:3])} for b in blocks]})


def test_refinement_asks_again(spark):
    from spanloom.plans.refinement import pretty, refine, save_json

    e = extract(doc(spark, TEXTS), Profile("p"), Endless())
    before = e.units.orderBy("k").collect()
    assert [u.end_inferred_from_next_start for u in before] == [True] * 5 + [False]
    after = refine(e, Endless(), Profile("p")).units.orderBy("k").collect()
    text = e.docs.first().full_text
    assert [text[u.start : u.end] for u in after[:5]] == [" ".join(t.split()[:7]) for t in TEXTS[:5]]
    assert all(u.refined and u.requirement_text == text[u.start : u.end] and u.verbatim_match for u in after[:5]) and not after[5].refined
    assert pretty('{"a": "é"}') == '{\n  "a": "é"\n}' and save_json is not None


def test_document_and_views(spark, tmp_path):
    from spanloom import session
    from spanloom.operators import views
    from spanloom.sweep import main, parse_budgets

    (tmp_path / "a.txt").write_text("HEAD one\n\nbody of one is here\n\nHEAD two\n\nbody of two is here")
    d = session.read(spark, str(tmp_path / "a.txt"))
    assert d.locate(9) == (1, 1) and d.locate(8) is None and d.text_in_range(0, 4) == "HEAD"
    assert d.summary()["pages_processed"] == "1-1 of 1" and json.loads(d.blocks())["schema_version"] == 1
    assert json.loads(d.blocks(include_full_text=True))["full_text"] == d.full_text
    e = extract(d.table, Profile("p", boundary_pattern="HEAD"), session.resolve_provider("rule-based"))
    names = session.register(e, "t_")
    assert spark.sql("SELECT count(*) FROM t_units").first()[0] == 4 and "t_calls" in names
    assert views.segments_view(e.units, e.blocks).where("text = 'body of one is here'").count() == 1
    one = views.inspect(e.units, e.calls, 2).first()
    assert one.sequence == 2 and one.llm_calls[0].chunk_id == 1 and views.inspect(e.units, e.calls, "9").count() == 0
    assert session.find_unit(e, "2").extracted_slice == "body of one is here" and views.inspect(e.units, e.calls, True).count() == 0
    with pytest.raises(KeyError):
        session.find_unit(e, "9")
    stamp = "2024-01-02T03:04:05+00:00"
    made = json.loads(views.units_json(e.units, e.docs, e.blocks, "f", stamp, "requirements").first().json)
    assert made["n_requirements"] == 4 and made["requirements"][0]["uid"] == made["run_id"] + "#r0000" and made["run_id"].startswith("20240102T030405Z-")
    plans = batching.section_ids(batching.plan_batches(d.table, 8, "HEAD"), d.table, "HEAD ([a-z]+)").orderBy("batch_no")
    assert [r.section_ids for r in plans.collect()] == [["one"], ["two"]]
    assert plans.where(batching.contains_section(F.col("section_ids"), " § two")).count() == 1
    assert [r["n_batches"] for r in main([str(tmp_path / "a.txt"), "--budgets", "8,800", "--pattern", "HEAD", "--json", str(tmp_path / "o.json")])] == [2, 1]
    for bad in ("", "0,5"):
        with pytest.raises(ValueError):
            parse_budgets(bad)


def test_providers_by_name(monkeypatch):
    from spanloom.plans import providers
    from spanloom.session import resolve_provider

    monkeypatch.setenv("SPANLOOM_PROVIDER", "recorded")
    assert isinstance(resolve_provider(payloads={"a": "{}"}), providers.Recorded)
    for name in ("recorded", "other"):
        with pytest.raises(ValueError):
            resolve_provider(name)
    assert [providers.stop_reason(*x) for x in (("length", True), ("tool_calls", False), ("stop", True), ("stop", False), (None, False))] == ["max_tokens", "tool_use", "tool_use", "stop", ""]
    assert providers.arguments('{"a": 1}') == {"a": 1} and providers.arguments({}) == {}
    for bad in ("{", "[1]", 3):
        with pytest.raises(RuntimeError):
            providers.arguments(bad)


def test_empty_tables(spark):
    rows = doc(spark, TEXTS).where("false")
    e = extract(rows, Profile("p"), RuleBased())
    assert (e.units.count(), e.calls.count(), e.docs.count()) == (0, 0, 0)


def test_stream_stitches_like_the_batch(spark, tmp_path):
    from spanloom.streaming.stitch import stitch_stream

    text = "\n".join(TEXTS) + "\n\n"
    one = {"requirements": [{"status": "complete", "start_quote": "block zero", "end_quote": "over there zero"}, {"status": "truncated_at_end", "start_quote": "block one"}]}
    two = {"requirements": [{"status": "truncated_at_start", "end_quote": "over there two"}, {"status": "complete", "start_quote": "block three", "end_quote": "over there three"}]}
    cut = text.index("block two")
    fields = "doc_id string, chunk_id long, char_start long, char_end long, text string, payload_json string, is_last boolean, stop_reason string, failed boolean, overflowed boolean"
    calls = [("d", 1, 0, cut - 1, text[: cut - 1], json.dumps(one), False, "", False, False), ("d", 2, cut, len(text) - 2, text[cut : len(text) - 2], json.dumps(two), True, "", False, False)]
    for i, row in enumerate(calls):
        spark.createDataFrame([row], fields).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = stitch_stream(source).writeStream.format("memory").queryName("stitched").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    columns = ["k", "sequence", "start", "end", "status", "requirement_text", "source_chunk_ids"]
    streamed = [tuple(r) for r in spark.table("stitched").select(*columns).orderBy("k").collect()]
    batch = assemble(doc(spark, TEXTS), spark.createDataFrame(calls, fields))
    assert streamed == [tuple(r) for r in batch.units.select(*columns).orderBy("k").collect()]
    assert [r[2:4] for r in streamed] == [(0, len(TEXTS[0])), (text.index("block one"), text.index("block three") - 1), (text.index("block three"), text.index("block four") - 1)]


def test_no_batch_of_a_document_is_dropped(spark):
    rows = doc(spark, [f"block {i} of a long text" for i in range(9)])
    e = extract(rows, Profile("p"), RuleBased(), Settings(target_input_tokens=8, max_iterations=3))
    calls = e.calls.orderBy("chunk_id").collect()
    assert [c.chunk_id for c in calls] == list(range(1, len(calls) + 1)) and len(calls) > 3
    assert calls[-1].last_block == 8 and e.units.count() == 9


class Counting:
    """Writes a line for every call; finds batches of several blocks too long if one is dense."""

    def __init__(self, path):
        self.path = path

    def propose(self, prompt, text, blocks):
        with open(self.path, "a") as out:
            out.write(f"{len(blocks)}\n")
        return Limited().propose(prompt, text, blocks)


def test_overflow_repeats_no_call(spark, tmp_path):
    log = tmp_path / "calls"
    e = extract(overflow_blocks(spark), Profile("p"), Counting(str(log)), Settings(target_input_tokens=38, min_input_tokens=10))
    assert e.units.count() == 30 and e.calls.count() == 13 and len(log.read_text().split()) == 13
    # at the floor, and for a batch of one block, there is nothing to try again
    log.unlink()
    e = extract(overflow_blocks(spark), Profile("p"), Counting(str(log)), Settings(target_input_tokens=38, min_input_tokens=38))
    assert len(log.read_text().split()) == 10 and e.units.count() == 27
    assert progress(e) == {"calls": 10, "failed": 0, "overflowed": 1, "malformed": 0, "ok": 9, "units": 27, "truncated": 0}


def test_equal_files_are_two_documents(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("one\n\ntwo")
    rows = readers.read_text(spark, str(tmp_path))
    assert rows.select("path").distinct().count() == 2 and rows.select("doc_hash").distinct().count() == 1
    assert blocks.documents(rows).select("full_text").distinct().count() == 1 and rows.count() == 4


def test_pages_without_blocks(spark):
    raw = [("d", 2, 1, 10.0, 100.0, 60.0, 110.0, 612.0, 792.0, "body"), ("d", 4, None, None, None, None, None, 612.0, 792.0, None), ("d", 3, 2, 10.0, 5.0, 60.0, 9.0, 612.0, 792.0, "head")]
    raw = spark.createDataFrame(raw, readers.RAW)
    got = readers.from_raw_blocks(raw)
    assert [(r.char_start, r.char_end) for r in got.collect()] == [(1, 5)]
    assert blocks.documents(got).first().full_text == "\nbody\n\n\n\n" and blocks.documents(got).first().end_page == 4
    assert [(r.char_start, r.page) for r in readers.from_raw_blocks(raw, start_page=2, end_page=2).collect()] == [(0, 2)]
    assert [tuple(r) for r in readers.cleaning_counts(raw).collect()] == [("d", 2, 1, 1, 0)]
    assert [(r.page, r.n_blocks, r.height) for r in readers.page_table(raw, got).orderBy("page").collect()] == [(2, 1, 792.0), (3, 0, 792.0), (4, 0, 792.0)]


def test_page_range_and_budget(spark):
    rows = doc(spark, TEXTS, page=lambda i: 1 + i // 2)
    e = extract(rows, Profile("p"), RuleBased(), Settings(target_input_tokens=500), start_page=2, end_page=2)
    assert [u.requirement_text for u in e.units.orderBy("k").collect()] == TEXTS[2:4] and e.calls.count() == 1
    assert extract(rows, Profile("p"), RuleBased(), start_page=9).calls.count() == 0
    with pytest.raises(ValueError):
        extract(rows, Profile("p"), RuleBased(), start_page=3, end_page=2)


def test_prompt_files(tmp_path):
    path = tmp_path / "rules.txt"
    path.write_text("\n Find rules. \n")
    assert Profile.from_file(path) == Profile("rules", "Find rules.")
    path.write_text(" \n")
    with pytest.raises(ValueError):
        read_prompt(path)
    with pytest.raises(FileNotFoundError):
        read_prompt(tmp_path / "none.txt")


def made_client():
    def create(**request):
        if "max_completion_tokens" not in request and "system" not in request:
            raise CallError("max_tokens is not supported here", status=400)
        if "system" in request:
            assert request["tool_choice"] == {"type": "tool", "name": "record_units"}
            return {"content": [{"type": "text"}, {"type": "tool_use", "input": {"requirements": []}}], "usage": {"input_tokens": 3, "output_tokens": 4}, "stop_reason": "tool_use"}
        call = {"function": {"arguments": '{"requirements": [1]}'}}
        return {"choices": [{"message": {"tool_calls": [call]}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 5, "completion_tokens": 6}}

    made_client.times = getattr(made_client, "times", 0) + 1
    return create


def test_services_by_a_client():
    from spanloom.plans import backends

    one = Chain(backends.MessageService(made_client), Settings(model="m")).propose("p", "t", [])
    two = Chain(backends.ChatService(made_client), Settings(model="m")).propose("p", "t", [])
    assert (one["payload_json"], one["input_tokens"], one["stop_reason"]) == ('{"requirements": []}', 3, "tool_use")
    assert (two["payload_json"], two["output_tokens"], two["stop_reason"]) == ('{"requirements": [1]}', 6, "tool_use")
    assert made_client.times == 1


def test_live_sweep(spark):
    from spanloom.sweep import sweep_live

    rows = sweep_live(doc(spark, TEXTS), [13, 500], Profile("p"), RuleBased(), "3")
    assert [(r["budget"], r["n_calls"], r["n_units"], r["n_source_ids"], r["has_section"]) for r in rows] == [(13, 6, 6, 6, True), (500, 1, 6, 6, True)]


def test_next_starts_with_a_stack(spark):
    rng = random.Random(1)
    rows = [(k, p, rng.randrange(-3, 20)) for k in range(3) for p in range(40)]
    df = spark.createDataFrame(rows, "k int, p int, start long")
    want = {(k, p): next((s for kk, q, s in rows if kk == k and q > p and s > start), None) if start >= 0 else None for k, p, start in rows}
    assert {(r.k, r.p): r.next_start for r in segments.next_starts(df, ["k"], "p").collect()} == want


def test_artifacts_are_saved(tmp_path):
    from spanloom.plans.refinement import save_pretty

    save_pretty('{"a": "é"}', tmp_path / "x" / "y.json")
    assert (tmp_path / "x" / "y.json").read_text(encoding="utf-8") == '{\n  "a": "é"\n}'


def random_payload(rng, words, size):
    """Items of every kind, at random: whole, cut, going on, without an end, of two segments, malformed."""
    items = []
    for _ in range(rng.randint(0, 4)):
        at = sorted(rng.randrange(size) for _ in range(4))
        quote = lambda i: " ".join(words[i : i + rng.randint(2, 5)])
        start, end = quote(at[0]), quote(at[3])
        kind = rng.randrange(8)
        if kind == 0:
            items.append({"status": "truncated_at_start", "end_quote": end if rng.random() < 0.6 else None})
        elif kind == 1:
            items.append({"status": "truncated_at_end", "start_quote": start})
        elif kind == 2:
            items.append({"status": "complete", "start_quote": start, "end_quote": rng.choice([None, "never said at all", end])})
        elif kind == 3:
            items.append({"status": rng.choice(["complete", "truncated_at_end"]), "segments": [{"start_quote": start, "end_quote": quote(at[1]), "role": rng.choice(["requirement", "context", "x"])}, {"start_quote": quote(at[2]), "end_quote": end}]})
        elif kind == 4:
            items.append({"status": "complete", "segments": [{"start_after_quote": start, "end_before_quote": end}]})
        elif kind == 5:
            items.append(rng.choice([7, {}, {"segments": [2]}, {"start_quote": "not to be found"}]))
        else:
            items.append({"status": rng.choice(["complete", "truncated_at_start"]), "start_quote": start, "end_quote": end})
    return json.dumps({"requirements": items})


def test_steps_compose_to_the_fold(spark):
    """Batches worked on apart give what the fold over a document's batches gives."""
    from spanloom.operators.stitch import Stitcher
    from spanloom.plans.engine import batch_units

    rng = random.Random(11)
    texts, calls, wanted = [], [], {}
    for d in range(60):
        whole = [f"w{rng.randrange(60)}" for _ in range(240)]
        rows, at, n = [], 0, rng.randint(1, 7)
        for i in range(n):
            part = whole[i * 30 : (i + 1) * 30]
            rows.append((f"d{d}", i, 1 + i // 2, " ".join(part)))
        texts += rows
        starts = []
        for i, r in enumerate(rows):
            at += 1 if i and r[2] != rows[i - 1][2] else 0
            starts.append(at)
            at += len(r[3]) + 1
        text = blocks_text(rows)
        fold = Stitcher(text)
        end = starts[-1] + len(rows[-1][3])
        for i, r in enumerate(rows):
            payload, bad = random_payload(rng, r[3].split(), 25), rng.random()
            calls.append((f"d{d}", i + 1, starts[i], starts[i] + len(r[3]), payload, "x", bad < 0.05, 0.05 < bad < 0.1))
            if bad >= 0.1:
                fold.add(batch_units(payload, r[3], starts[i], True)[0], i + 1, starts[i], end)
        wanted[f"d{d}"] = [(u.sequence, u.status, u.start, u.end, u.segments, u.verbatim_match, u.segments_partial, u.end_resolved, u.source_chunk_ids, u.texts["requirement"], u.segment_texts, u.end_quote, [json.dumps(m) for m in u.model_parts]) for u in fold.finish(end)]
    rows = blocks.with_offsets(spark.createDataFrame(texts, "doc_id string, ord int, page int, text string"))
    fields = "doc_id string, chunk_id long, char_start long, char_end long, payload_json string, stop_reason string, failed boolean, overflowed boolean"
    got = assemble(rows, spark.createDataFrame(calls, fields)).units.orderBy("doc_id", "k").collect()
    made = {d: [] for d in wanted}
    for u in got:
        segs = [(s.start, s.end, s.role) for s in u.segments]
        made[u.doc_id].append((u.sequence, u.status, u.start, u.end, segs, u.verbatim_match, u.segments_partial, u.end_resolved, u.source_chunk_ids, u.requirement_text, [s.text for s in u.segments], u.end_quote, u.model_parts))
    assert made == wanted and sum(map(len, wanted.values())) > 300
    assert any(len(u[8]) > 2 for us in wanted.values() for u in us)


def blocks_text(rows):
    out, page = "", rows[0][2]
    for _, _, p, t in rows:
        out += "\n" * (p - page) + t + "\n"
        page = p
    return out + "\n"


@pytest.mark.parametrize("pattern", [None, "HEAD"])
def test_jumps_plan_like_the_fold(spark, monkeypatch, pattern):
    rng = random.Random(5)
    texts = [(f"d{d}", i, i // 3, rng.choice(["HEAD ", ""]) + "x" * rng.randrange(1, 60)) for d in range(12) for i in range(rng.randint(1, 60))]
    rows = blocks.with_offsets(spark.createDataFrame(texts, "doc_id string, ord int, page int, text string"))
    columns = ["doc_id", "batch_no", "first_block", "last_block", "char_start", "char_end", "n_units", "page_start", "page_end", "est_input_tokens"]
    found = []
    for fold in (4096, 0, 20):
        monkeypatch.setattr(batching, "FOLD", fold)
        found.append(sorted(tuple(r) for r in batching.plan_batches(rows, 30, pattern).select(*columns).collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 80


def test_a_long_document_is_planned_and_joined(spark):
    """200,000 blocks on as many pages: time grows with their number, and no row holds them all but the text's own."""
    n = 200_000
    rows = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").alias("ord"), (F.col("id") + 1).cast("int").alias("page"), F.concat(F.lit("block "), "id").alias("text"))
    rows = blocks.with_offsets(rows)
    made = blocks.documents(rows).select(F.length("full_text").alias("n"), F.sha2("full_text", 256).alias("h"), "doc_hash", "n_blocks").first()
    assert made.n == sum(len(str(i)) + 8 for i in range(n)) and made.h == made.doc_hash and made.n_blocks == n
    plans = batching.plan_batches(rows, 600)
    told = plans.agg(F.count(F.lit(1)), F.sum(F.col("last_block") - F.col("first_block") + 1), F.max("est_input_tokens"), F.max("batch_no")).first()
    assert told[1] == n and told[2] <= 600 and told[0] == told[3] + 1 > 1000


class Paid:
    """Notes every call that was answered; may die at a block."""

    def __init__(self, path, dies_at=None):
        self.path, self.dies_at = str(path), dies_at

    def propose(self, prompt, text, blocks):
        if self.dies_at and self.dies_at in text:
            os._exit(1)
        with open(self.path, "a") as out:
            out.write(text + "\n")
        return RuleBased().propose(prompt, text, blocks)


def test_a_killed_job_repeats_no_answered_call(spark, tmp_path):
    texts = [f"block {i:02d} of a text that is long enough to be one batch" for i in range(24)] + ["block 00 of a text that is long enough to be one batch"]
    rows = spark.createDataFrame([("d" if i < 24 else "e", 0, 1, t, None, None) if i > 23 else ("d", i, 1, t, None, None) for i, t in enumerate(texts)], "doc_id string, ord int, page int, text string, role string, label string")
    rows = blocks.with_offsets(rows)
    settings = Settings(target_input_tokens=16, call_store=f"file:{tmp_path}/store")
    with pytest.raises(Exception):  # noqa: B017  the worker dies with its job
        extract(rows, Profile("p"), Paid(tmp_path / "one", "block 17"), settings)
    e = extract(rows, Profile("p"), Paid(tmp_path / "two"), settings)
    assert e.calls.count() == 25 and e.units.count() == 25
    one, two = ((tmp_path / n).read_text().splitlines() if (tmp_path / n).exists() else [] for n in ("one", "two"))
    assert not set(one) & set(two) and sorted([*one, *two]) == sorted(set(texts))  # equal batches are asked about once
    again = extract(rows, Profile("p"), Paid(tmp_path / "three"), settings)
    assert not (tmp_path / "three").exists()
    columns = ["doc_id", "k", "sequence", "start", "end", "requirement_text"]
    plain = extract(rows, Profile("p"), RuleBased(), Settings(target_input_tokens=16))
    assert sorted(map(tuple, again.units.select(*columns).collect())) == sorted(map(tuple, plain.units.select(*columns).collect()))


def test_calls_in_flight():
    from spanloom.plans.calls import TokenBucket, in_order

    def slow(row):
        time.sleep(0.1 * (1 + row["n"] % 2))
        return row

    began = time.monotonic()
    assert [r["n"] for r in in_order(slow, ({"n": i} for i in range(40)), 8)] == list(range(40))
    assert time.monotonic() - began < 6.0 / 4
    assert list(in_order(slow, iter([]), 8)) == []
    now, slept = [0.0], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    bucket = TokenBucket(100, 200, clock=lambda: now[0], sleep=sleep)
    for _ in range(20):
        bucket.take(50)
    # what was free at first is 0; afterwards no more than 100 a second
    assert now[0] == pytest.approx(10.0) and len(slept) == 20
    now[0] += 100
    bucket.take(200)
    assert len(slept) == 20


def test_refinement_keeps_its_calls_and_names(spark):
    from spanloom.plans.refinement import refine

    class Foreign:
        def propose(self, prompt, text, blocks):
            if "exactly one item" in prompt:
                if "block two" in text:
                    raise ConnectionError("down")
                return call({"requirements": [{"from": " ".join(text.split()[:3]), "to": " ".join(text.split()[3:7])}]}, "m", 7, 3)
            return call({"requirements": [{"from": " ".join(b["text"].split()[:3])} for b in blocks]}, "m", 5, 2)

    names = {"start_quote": "from", "end_quote": "to"}
    e = extract(doc(spark, TEXTS), Profile("p"), Foreign(), refine_ends=True, names=names)
    got = e.units.orderBy("k").collect()
    assert [u.refined for u in got] == [True, True, False, True, True, False]
    calls = e.calls.orderBy("chunk_id").collect()
    assert [(c.chunk_id, c.first_block, c.last_block, c.batch_status, c.input_tokens) for c in calls] == [(1, 0, 5, "ok", 5)] + [(2 + i, -1, -1, "api_error" if i == 2 else "ok", 0 if i == 2 else 7) for i in range(5)]
    assert refine(extract(doc(spark, TEXTS), Profile("p"), Foreign(), names=names), Foreign(), Profile("p")).units.where("refined").count() == 0


def test_stream_of_late_repeated_and_missing_batches(spark, tmp_path):
    from spanloom.streaming.stitch import stitch_stream

    fields = "doc_id string, chunk_id long, char_start long, char_end long, text string, payload_json string, is_last boolean"
    texts = [f"unit {i} begins here and it ends over there {i}" for i in range(4)]
    whole = {"requirements": [{"status": "complete", "start_quote": "unit", "end_quote": "there"}]}
    opens = {"requirements": [{"status": "truncated_at_end", "start_quote": "unit"}]}
    size = len(texts[0]) + 1

    def row(d, n, payload=whole, last=False):
        return (d, n, (n - 1) * size, n * size - 1, texts[n - 1], json.dumps(payload), last)

    def files():
        yield [row("late", 2, last=True), row("twice", 1), row("gap", 1), row("gap", 3), row("endless", 1), row("endless", 2, opens)]
        yield [row("late", 1), row("twice", 1), row("twice", 2, last=True)]
        yield [row("twice", 2, last=True), row("late", 1), row("other", 1, last=True)]
        yield [row("other", 1, last=True)]
        yield [row("gap", 4, last=True), row("endless", 3)]

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = stitch_stream(source, wait_s=25, remember_s=600)
    q = made.writeStream.format("memory").queryName("patient").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    for i, rows in enumerate(files()):
        if i == 3:
            time.sleep(26)  # what has waited since the first files has waited long enough
        spark.createDataFrame(rows, fields).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        for f in (tmp_path / f"part{i}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{i}-{f.name}")
        q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.table("patient").collect():
        got.setdefault(r.doc_id, []).append((r.k, r.sequence, r.status, r.start))
    got = {d: sorted(v) for d, v in got.items()}
    assert got["late"] == [(0, 1, "complete", 0), (1, 2, "complete", size)] and got["twice"] == got["late"] and got["other"] == [(0, 1, "complete", 0)]
    # the second batch is told to be missing, the third is taken without it, and the last one when it comes
    assert got["gap"] == [(-1, 2, "missing", None), (0, 1, "complete", 0), (1, 2, "complete", 2 * size), (2, 3, "complete", 3 * size)]
    # the end never came: what was open is flushed, and what comes behind it is passed over
    assert got["endless"] == [(-1, 3, "missing", None), (0, 1, "complete", 0), (1, 2, "truncated_at_end", size)]


def test_a_text_file_is_read_in_ranges(spark, tmp_path):
    """Byte ranges that cut paragraphs, lines and characters anywhere give the blocks of the whole file."""
    rng = random.Random(12)
    text = "".join(rng.choice(["word ", "é—", "x-\n", "\n", "\r\n", "\n\n", " \t\n\n", "\n\x0b\n", "𝄞", "\r"]) for _ in range(4000))
    (tmp_path / "a.txt").write_bytes(text.encode())
    (tmp_path / "b.txt").write_bytes(b"one\n\ntwo")
    whole = readers.paragraphs(spark.createDataFrame([("a", text)], "doc_id string, text string")).orderBy("block_no").collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "1001b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = readers.read_text(spark, str(tmp_path))
            got = rows.where("doc_id LIKE '%a.txt'").orderBy("block_idx").collect()
            assert [(r.block_no, r.text) for r in got] == [(r.block_no, r.text) for r in whole] and len(got) > 300
            assert {r.doc_hash for r in got} == {hashlib.sha256(text.encode()).hexdigest()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "c.txt").write_bytes(b"a\xff")
    with pytest.raises(Exception, match="UTF-8"):  # noqa: B017
        readers.read_text(spark, str(tmp_path / "c.txt")).count()


def test_services_by_name(spark, tmp_path, monkeypatch):
    """A live run through a service that settings name, made in the workers."""
    from spanloom.session import resolve_provider
    from spanloom.sweep import main

    for name in ("messages", "chat"):
        with pytest.raises(ValueError):
            resolve_provider(name)
    monkeypatch.setenv("SPANLOOM_CLIENT", "recorded_corpus:quoting_client")
    monkeypatch.setenv("SPANLOOM_PROVIDER", "messages")
    (tmp_path / "a.txt").write_text("\n\n".join(TEXTS))
    rows = main([str(tmp_path / "a.txt"), "--budgets", "13,500", "--live", "--section", "7"])
    assert [(r["budget"], r["n_calls"], r["n_units"], r["input_tokens"], r["has_section"]) for r in rows] == [(13, 6, 6, 18, True), (500, 1, 1, 3, True)]
    chat = resolve_provider("chat", settings=Settings(model="m", fallback_models="n"))
    assert chat.settings.models() == ["m"]
