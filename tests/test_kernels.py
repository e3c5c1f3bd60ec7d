"""Golden cases of the resolve and stitch kernels, and of payload parsing."""

import json
import random
import sys

import pytest

from spanloom.functions.text import WS_CODES
from spanloom.operators import occurrences
from spanloom.operators.occurrences import Occurrences, Suffixes
from spanloom.operators.payloads import batch_status, items_of, specs_of
from spanloom.operators.resolve import BatchUnit, Searchable, batch_unit, clipped, quoted, resolve
from spanloom.operators.stitch import Stitcher, restored, state_of


def seg(start=None, end=None, before=None, after=None, role="requirement", metadata=None):
    return {"start_quote": start, "end_quote": end, "end_before_quote": before, "start_after_quote": after, "role": role, "metadata": metadata}


def unit(start, end, status="complete", specs=None, partial=False, segments=None, end_quote="e"):
    specs = specs or [seg("s", end_quote)]
    spans = segments if segments is not None else ([(start, end, "requirement")] if 0 <= start < end else [])
    return BatchUnit(status, specs, spans, start, end, "s", end_quote, partial, bool(spans) and not partial, True, False, False, {"m": start})


def found(text, *specs):
    return resolve(Searchable(text), list(specs))


def test_white_space_is_pythons():
    assert {c for c in range(sys.maxunicode) if chr(c).isspace()} == set(WS_CODES)


def test_match_maps_back_to_the_raw_text():
    f = found("A  b\nc", seg("b c", None))[0]
    assert (f.start, f.at, f.at_end) == (3, 2, 5)
    assert found("A  b\nc d", seg("A", "b c"))[0].end == 6


def test_typography_is_folded():
    text = "The business’s plan is due."
    f = found(text, seg("business's plan", "is due."))[0]
    assert text[f.start : f.end] == "business’s plan is due."
    assert quoted(" a  b\tc ") == "a b c"


def test_shortened_start():
    base = "zero one two three four fifth and more words"
    hit = found(base, seg("one two three four fifth XX", None))[0]
    assert hit.fallback and not hit.ambiguous and base[hit.start :].startswith("one two")
    miss = found(base.replace("fifth", "five"), seg("one two three four five XX", None))[0]
    assert miss.start == -1 and miss.ambiguous
    twice = found(base + " " + base, seg("one two three four fifth XX", None))[0]
    assert twice.start == -1 and twice.ambiguous
    assert found(base, seg("one two XX", None))[0].ambiguous


def test_end_before_the_next_heading():
    text = "Head A body of a. Head B body of b."
    a, b = found(text, seg("Head A", before="Head B"), seg("Head B", "of b."))
    assert (a.start, a.end, b.start, b.end) == (0, text.index("Head B"), text.index("Head B"), len(text))


def test_starts_are_searched_forward_and_after():
    text = "x one y one z"
    a, b = found(text, seg("one"), seg("one"))
    assert (a.start, b.start) == (2, 8)
    assert found(text, seg(after="x"))[0].start == 1
    assert found(text, seg("one", after="missing"))[0].start == -1


def test_clip():
    assert clipped([(0, 10, "a"), (5, 12, "b"), (6, 9, "c")]) == ([(0, 10, "a"), (10, 12, "b")], True)
    assert clipped([(5, 5, "a"), (-1, 3, "b"), (3, 5, "c")]) == ([(3, 5, "c")], False)


def test_batch_unit_keeps_a_lone_end_if_asked():
    text, specs = "tail of it. rest", [seg(None, "tail of it.")]
    for keep, end in ((True, 111), (False, -1)):
        f = found(text, *specs)
        assert batch_unit({"status": "truncated_at_start"}, specs, f, text, 100, keep).end == end


def test_continuation_closes_the_open_unit():
    s = Stitcher("x" * 100)
    s.add([unit(0, -1, "truncated_at_end", partial=True)], 1, 0, 100)
    s.add([unit(-1, 40, "truncated_at_start")], 2, 30, 100)
    (u,) = s.finish(100)
    assert (u.start, u.end, u.sequence, u.status, u.source_chunk_ids, u.end_resolved) == (0, 40, 1, "complete", [1, 2], True)


def test_sequence_numbers_go_to_units_with_a_start():
    s = Stitcher("x" * 100)
    s.add([unit(0, 20), unit(-1, -1), unit(20, 40)], 1, 0, 100)
    assert [u.sequence for u in s.finish(100)] == [1, 0, 2]
    assert s.units[1].n_segments == 1 and not s.units[1].verbatim_match


def test_end_inferred_from_the_next_start():
    s = Stitcher("x" * 100)
    s.add([unit(0, -1, specs=[seg("s", None)], end_quote=None), unit(50, 60)], 1, 0, 100)
    u = s.units[0]
    assert (u.end, u.end_inferred_from_next_start, u.end_resolved, u.segments_partial) == (50, True, True, False)
    s = Stitcher("x" * 100)
    s.add([unit(0, -1), unit(50, 60)], 1, 0, 100)
    u = s.units[0]
    assert (u.end, u.end_resolved, u.end_quote_unresolved, u.segments_partial, u.verbatim_match) == (50, False, True, True, False)


def test_interrupted_units():
    s = Stitcher("x" * 100)
    two = [seg("a", "b"), seg("c", "d")]
    s.add([unit(0, 10, "truncated_at_end", two, True, [(0, 10, "requirement")])], 1, 0, 100)
    s.add([unit(50, 60)], 2, 40, 100)
    u = s.units[0]
    assert (u.segments, u.status, u.segments_partial, u.n_segments) == ([(0, 10, "requirement")], "truncated_at_end", True, 2)
    s = Stitcher("x" * 100)
    s.add([unit(0, -1, "truncated_at_end")], 1, 0, 100)
    s.add([unit(50, 60)], 2, 40, 100)
    assert (s.units[0].end, s.units[0].end_quote, s.units[0].end_resolved) == (50, None, False)


def test_open_unit_is_flushed_at_the_end():
    s = Stitcher("x" * 100)
    s.add([unit(10, -1, "truncated_at_end")], 1, 0, 100)
    (u,) = s.finish(100)
    assert (u.start, u.end, u.status, u.end_resolved, u.segments_partial) == (10, 100, "truncated_at_end", False, True)


def test_orphan_continuation():
    s = Stitcher("x" * 100)
    s.add([unit(-1, 30, "truncated_at_start")], 1, 10, 100)
    u = s.units[0]
    assert (u.start, u.end, u.sequence, u.start_quote) == (10, 30, 1, None)


def test_state_survives_serialization():
    s = Stitcher("x" * 100)
    s.add([unit(0, -1, "truncated_at_end")], 1, 0, 100)
    t = restored("x" * 100, json.loads(json.dumps(state_of(s))))
    t.add([unit(-1, 40, "truncated_at_start")], 2, 30, 100)
    assert [(u.start, u.end, u.sequence) for u in t.finish(100)] == [(0, 40, 1)]


@pytest.mark.parametrize("item, reason", [(7, "not-a-dict"), ({"segments": [1]}, "invalid_segment_item"), ({}, "missing_quotes"), ({"segments": [], "status": "complete"}, "missing_quotes")])
def test_malformed_items(item, reason):
    assert specs_of(item) == ([], reason)


def test_payloads():
    assert specs_of({"status": "truncated_at_start"})[1] is None
    assert specs_of({"segments": [{"role": " x ", "metadata": {"a": [1]}}]})[0][0] | {"x": 1} == seg(role="x", metadata={"a": [1]}) | {"x": 1}
    assert items_of(json.dumps({"requirements": json.dumps([{"a": 1}])})) == ([{"a": 1}], [])
    assert items_of(json.dumps({"requirements": "no json"}))[1] == []
    assert items_of(json.dumps({"requirements": 7}))[1] == ["not-a-list"]
    assert items_of("{")[1] == ["not-json"] and items_of(None) == ([], [])
    assert [batch_status(*x) for x in ((1, 1, 1, None), (0, 0, 0, "max_tokens"), (2, 1, 0, None), (0, 0, 0, None), (1, 1, 0, None))] == ["json_error", "overflow", "verbatim_failure", "empty", "ok"]


def test_suffixes_find_every_place():
    rng = random.Random(2)
    for alphabet, n in (("ab", 60), ("a", 30), ("abc d", 200), ("é𝄞x ", 80)):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        index = Suffixes(text)
        for _ in range(100):
            a = rng.randrange(n)
            piece = text[a : a + rng.randint(1, 9)] if rng.random() < 0.7 else "".join(rng.choice(alphabet) for _ in range(5))
            assert sorted(index.places(piece).tolist()) == [i for i in range(n) if text.startswith(piece, i)]
    assert Suffixes("").places("a").tolist() == []


def plain_shortened(text, quote, low, high, from_front):
    words = quote.split(" ")
    for n in range(len(words), 3, -1):
        part = " ".join(words[-n:] if from_front else words[:n])
        if len(part) < 24:
            return None
        at = text.find(part, low, high)
        if at >= 0:
            return None if text.find(part, at + 1, high) >= 0 else (at, at + len(part))
    return None


@pytest.mark.parametrize("scans", [0, 10**9])
def test_shortened_quotes(monkeypatch, scans):
    """By halving and by suffixes as by trying every length."""
    monkeypatch.setattr(occurrences, "SCANS", scans)
    rng, hits = random.Random(4), 0
    for _ in range(40):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(120)]
        text, index = " ".join(words), Occurrences(" ".join(words))
        for _ in range(30):
            a, n = rng.randrange(100), rng.randint(1, 14)
            quote = " ".join(words[a : a + n] + ["zzz"] * rng.randint(0, 2)) if rng.random() < 0.5 else " ".join(["zzz"] * rng.randint(0, 2) + words[a : a + n])
            low, high, front = rng.randrange(0, 300), rng.randrange(300, len(text) + 1), rng.random() < 0.5
            got = index.shortened(quote, low, high, front)
            assert got == plain_shortened(text, quote, low, high, front)
            hits += got is not None
    assert hits > 100


def test_pieces_are_found_in_one_pass(monkeypatch):
    monkeypatch.setattr(occurrences, "TOGETHER", 0)
    rng = random.Random(6)
    text = "".join(rng.choice("ab c") for _ in range(400))
    pieces = [text[a : a + rng.randint(1, 8)] for a in range(0, 390, 7)] + ["zz", "a", ""]
    one, other = Occurrences(text), Occurrences(text)
    one.prepare(pieces)
    assert one.known and not other.known
    for p in pieces:
        low, high = rng.randrange(200), rng.randrange(200, 401)
        assert one.exact(p, low, high) == other.exact(p, low, high)
