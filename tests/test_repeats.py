"""Quotes that occur more than once, and what a task holds."""

import json

import pyarrow as pa

from spanloom.kernel_queries import Scripted
from spanloom.operators.occurrences import Occurrences
from spanloom.plans.engine import ANSWERS, batch_units, rows_of
from spanloom.plans.providers import RuleBased

TAIL = "and the others went to sea"
TEXTS = [
    f"First words of a turn here, {TAIL}. then some more of it came, {TAIL}",
    f"Start of another turn now is said. Start of a third turn now is said. {TAIL} again and {TAIL}",
    f"Start of a third turn now is said. And {TAIL} twice, {TAIL}",
]


def blocks(texts):
    return [{"text": t, "role": "requirement", "label": f"{n}.0", "block_idx": 0} for n, t in enumerate(texts)]


def spans(texts):
    at, out = 0, []
    for t in texts:
        out.append((at, at + len(t)))
        at += len(t) + 1
    return out


def test_rule_based_units_are_whole_blocks():
    made = batch_units(RuleBased().propose("", "\n".join(TEXTS), blocks(TEXTS))["payload_json"], "\n".join(TEXTS), 0, True, None)[0]
    assert [(u.start, u.end) for u in made] == spans(TEXTS) and all(u.verbatim for u in made)


def test_scripted_kinds():
    """A shortened start that comes twice, both halves of a block, an exclusive end, and a window's end."""
    words = " ".join(f"word{i}" for i in range(8))
    late = f"{words} and on. {words} {TAIL}, {TAIL}"
    given = [{"text": late, "role": "context", "label": "7.0", "block_idx": 0}]  # kind late
    u = batch_units(Scripted().propose("", late, given)["payload_json"], late, 0, True, None)[0][0]
    assert (u.start, u.end, u.fallback, u.ambiguous) == (0, len(late), True, False)
    two = "a b c d e f g a b c d e f g h i j k"
    given = [{"text": two, "role": "context", "label": "5.0", "block_idx": 0}]  # kind two
    u = batch_units(Scripted().propose("", two, given)["payload_json"], two, 0, True, None)[0][0]
    assert [s[:2] for s in u.segments] == [(0, 17), (18, len(two))]
    end = "a b c d e f g x y z w e f x y z w"
    given = [{"text": end, "role": "context", "label": "3.0", "block_idx": 0}]  # kind exclusive
    u = batch_units(Scripted().propose("", end, given)["payload_json"], end, 0, True, None)[0][0]
    assert (u.start, u.end) == (7, len(end) - 7)
    u = batch_units(Scripted().propose("exactly one item", TEXTS[0], [])["payload_json"], TEXTS[0], 0, True, None)[0][0]
    assert (u.start, u.end) == (0, len(TEXTS[0]))


def test_a_number_is_optional():
    """Without one, or with what is none, a quote is found where it comes first; one beyond what there is finds nothing."""
    text = "alpha beta x alpha beta y end z end"
    item = lambda **n: json.dumps({"requirements": [{"start_quote": "alpha beta", "end_quote": "end"} | n]})
    at = lambda **n: [(u.start, u.end) for u in batch_units(item(**n), text, 0, True, None)[0]]
    assert at() == at(start_nth=True, end_nth="2") == at(start_nth=0, end_nth=None) == [(0, 29)]
    assert at(start_nth=2, end_nth=2) == [(13, len(text))]
    assert at(end_nth=3) == [(0, -1)]


def test_numbers_with_an_automaton(monkeypatch):
    from spanloom.operators import occurrences

    monkeypatch.setattr(occurrences, "TOGETHER", 0)
    o = Occurrences("ab ab ab")
    o.prepare(["ab"])
    assert [o.exact("ab", 1, 8, n) for n in (1, 2, 3)] == [(3, 5), (6, 8), None] == [Occurrences("ab ab ab").exact("ab", 1, 8, n) for n in (1, 2, 3)]


def test_few_rows_are_taken_up_at_a_time(monkeypatch):
    """However many rows come in a batch, ANSWERS at most are Python objects."""
    batch = pa.RecordBatch.from_pylist([{"n": i} for i in range(3 * ANSWERS + 5)])
    taken = []

    class Watched:
        num_rows = batch.num_rows

        def slice(self, at, n):
            taken.append(len(batch.slice(at, n)))
            return batch.slice(at, n)

    rows = rows_of(iter([Watched()]))
    assert next(rows) == {"n": 0} and taken == [ANSWERS]
    assert sum(1 for _ in rows) == batch.num_rows - 1 and max(taken) == ANSWERS
