"""Kernel: join the units of a document's batches, in order, into units of the document.

``Stitcher`` is the fold over batches. ``step`` is what one batch does, whatever came before it: batches
are worked on apart from each other, and what they do composes, as only one unit can be open between two of them.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from spanloom.operators.resolve import BatchUnit, clipped, role_texts

Segment = tuple[int, int, str]


@dataclass
class Unit:
    """A unit of the document. Positions are -1 where they are unresolved."""

    status: str
    sequence: int
    start: int
    end: int
    segments: list[Segment]
    specs: list[dict]
    n_segments: int
    start_quote: str | None
    end_quote: str | None
    end_resolved: bool
    segments_partial: bool
    source_chunk_id: int
    source_chunk_ids: list[int]
    end_inferred_from_next_start: bool = False
    end_quote_unresolved: bool = False
    start_via_fallback: bool = False
    ambiguous: bool = False
    verbatim_match: bool = False
    texts: dict[str, str] = field(default_factory=dict)
    segment_texts: list[str] = field(default_factory=list)
    model_parts: list[object] = field(default_factory=list)


@dataclass
class Pending:
    """A unit that its batch's end cut; at most one is open."""

    unit: BatchUnit
    sequence: int
    chunk_id: int
    chunk_ids: list[int]
    parts: list[object]


class Stitcher:
    """The fold's state: finished units, the open one and the next sequence number."""

    def __init__(self, text: object):
        self.text, self.units, self.pending, self.next = text, [], None, 1

    def _number(self) -> int:
        self.next += 1
        return self.next - 1

    def _emit(self, u: BatchUnit, segments: list[Segment], expected: int, end_resolved: bool, *, status: str | None = None,
        sequence: int | None = None, chunk_ids: list[int], chunk_id: int, partial: bool = False, parts: list[object] | None = None,
        forward: bool = True, **flags: object) -> None:
        kept, cut = clipped(segments)
        partial |= cut
        texts = role_texts(self.text, kept)
        start, end = (kept[0][0], kept[-1][1]) if kept else (flags.pop("at", -1), -1)
        flags.pop("at", None)
        body = texts["requirement"]
        if max(expected, len(kept)) == 1 and not partial:
            exact = end_resolved and start >= 0 and bool(body)
        else:
            exact = not partial and end_resolved and len(kept) == expected > 0 and bool(body)
        end_quote = flags.pop("end_quote", u.end_quote)
        start_quote = flags.pop("start_quote", u.start_quote)
        more = {"start_via_fallback": u.fallback, "ambiguous": u.ambiguous} if forward else {}
        number = self._number() if sequence is None else sequence
        self.units.append(Unit(
            status or u.status, number, start, end, kept, u.specs, expected, start_quote, end_quote, end_resolved, partial, chunk_id, sorted(set(chunk_ids)),
            verbatim_match=exact, texts=texts, segment_texts=[self.text[a:b] for a, b, _ in kept], model_parts=parts if parts is not None else [u.model], **more, **flags,
        ))

    def add(self, batch: list[BatchUnit], chunk_id: int, batch_start: int, range_end: int) -> None:
        """Take in one batch's units."""
        for j, u in enumerate(batch):
            has_start, has_end = u.start >= 0, u.end >= 0
            if self.pending is not None:
                p = self.pending
                if u.status == "truncated_at_start" or not has_start:
                    p.chunk_ids.append(chunk_id)
                    p.parts += [m for m in [u.model] if m not in p.parts]
                    if has_end and u.end > p.unit.start:
                        self._close(p, u)
                        self.pending = None
                    continue
                self._interrupt(p, u.start if has_start else range_end)
                self.pending = None
            own = {"chunk_ids": [chunk_id], "chunk_id": chunk_id}
            if j == len(batch) - 1 and u.status == "truncated_at_end" and has_start:
                self.pending = Pending(u, self._number(), chunk_id, [chunk_id], [u.model])
            elif u.status == "truncated_at_start":
                span = [(batch_start, u.end, "requirement")] if has_end else []
                self._emit(u, u.segments or span, len(u.specs), has_end and not u.partial, start_quote=None, partial=u.partial and bool(u.segments), **own)
            elif has_start and has_end and u.end > u.start:
                if len(u.specs) > 1 or (u.segments and not u.partial):
                    self._emit(u, u.segments, len(u.specs), u.end_resolved, partial=u.partial, **own)
                else:
                    self._emit(u, [(u.start, u.end, "requirement")], 1, True, status="complete", **own)
            elif has_start:
                nxt = next((x.start for x in batch[j + 1 :] if x.start > u.start), None)
                if nxt is None:
                    self.pending = Pending(u, self._number(), chunk_id, [chunk_id], [u.model])
                else:
                    lost = bool(u.end_quote)
                    role = u.specs[-1]["role"] if u.specs else "requirement"
                    self._emit(u, [(u.start, nxt, role)], 1, not lost, partial=lost, forward=False, end_inferred_from_next_start=True, end_quote_unresolved=lost, **own)
            else:
                self._emit(u, [], 1, False, sequence=0, partial=u.partial, forward=False, **own)

    def _close(self, p: Pending, u: BatchUnit) -> None:
        expected = len(p.unit.specs)
        known = {"sequence": p.sequence, "chunk_id": p.chunk_id, "chunk_ids": p.chunk_ids, "parts": p.parts, "end_quote": u.end_quote}
        if expected > 1 or p.unit.segments:
            merged, cut = clipped([*p.unit.segments, *(u.segments or [(p.unit.segments[-1][1] if p.unit.segments else p.unit.start, u.end, (u.specs or p.unit.specs)[-1]["role"])])])
            self._emit(p.unit, merged, expected, len(merged) >= expected and not cut, status="complete", partial=cut, **known)
        else:
            self._emit(p.unit, [(p.unit.start, u.end, p.unit.specs[0]["role"])], 1, True, status="complete", **known)

    def _interrupt(self, p: Pending, bound: int) -> None:
        u, known = p.unit, {"sequence": p.sequence, "chunk_id": p.chunk_id, "chunk_ids": p.chunk_ids, "parts": p.parts}
        if len(u.specs) > 1:
            self._emit(u, u.segments, len(u.specs), False, status="truncated_at_end", partial=True, at=u.start, **known)
        elif u.segments:
            *front, last = u.segments
            self._emit(u, [*front, (last[0], max(bound, last[0]), last[2])], len(u.specs), False, status="truncated_at_end", partial=True, **known)
        else:
            role = u.specs[-1]["role"] if u.specs else "requirement"
            self._emit(u, [(u.start, bound, role)], 1, False, status="truncated_at_end", end_quote=None, partial=True, **known)

    def finish(self, range_end: int) -> list[Unit]:
        """Flush the open unit and return all."""
        if self.pending is not None:
            p, self.pending = self.pending, None
            known = {"sequence": p.sequence, "chunk_id": p.chunk_id, "chunk_ids": p.chunk_ids, "parts": p.parts}
            role = p.unit.specs[-1]["role"] if p.unit.specs else "requirement"
            self._emit(p.unit, p.unit.segments or [(p.unit.start, range_end, role)], len(p.unit.specs) or 1, False, status="truncated_at_end", partial=True, at=p.unit.start, **known)
        return self.units


class TextWindow:
    """A part of a document's text, addressed by document positions."""

    def __init__(self, base: int, text: str):
        self.base, self.text = base, text

    def __getitem__(self, span: slice) -> str:
        return self.text[max(span.start - self.base, 0) : max(span.stop - self.base, 0)]


@dataclass
class Step:
    """What a batch does to a unit that is open when it comes, and what it leaves.

    The first ``used`` items go to the open unit, if there is one: they go on with it. Then it is closed by
    ``closes``, or interrupted at ``bound``; or it stays open, if the batch ``passes``. Without an open unit these items
    are units of their own: the first ``used`` of ``units``, which take ``n_lead`` sequence numbers. All that follows is the same in
    both cases, but for its numbers; so a batch that doesn't pass decides alone what is open behind it.
    """

    units: list[Unit]  # of a document that starts here; sequences count from 1
    used: int
    n_lead: int
    n_total: int
    closes: BatchUnit | None
    bound: int | None
    passes: bool
    parts: list[object]  # what the model sent for the first ``used`` items
    open: Pending | None


def step(batch: list[BatchUnit], chunk_id: int, batch_start: int, text: object) -> Step:
    """One batch's transition. Batches of a document must not overlap: then any end closes a unit that was opened before."""
    lead = next((i for i, u in enumerate(batch) if u.status != "truncated_at_start" and u.start >= 0), len(batch))
    closing = next((i for i in range(lead) if batch[i].end >= 0), None)
    used = lead if closing is None else closing + 1
    alone = Stitcher(text)
    alone.add(batch, chunk_id, batch_start, batch_start)
    interrupted = closing is None and lead < len(batch)
    return Step(
        alone.units, used, sum(u.sequence > 0 for u in alone.units[:used]), alone.next - 1, None if closing is None else batch[closing],
        batch[lead].start if interrupted else None, closing is None and not interrupted, [u.model for u in batch[:used]], alone.pending,
    )


def finished(p: Pending, closes: BatchUnit | None, bound: int | None, range_end: int, text: object) -> Unit:
    """A unit that was open between batches: closed, interrupted or, if neither, flushed."""
    s = Stitcher(text)
    if closes is not None:
        s._close(p, closes)
    elif bound is not None:
        s._interrupt(p, bound)
    else:
        s.pending = p
        s.finish(range_end)
    return s.units[0]


def unit_state(u: BatchUnit) -> dict:
    return asdict(u)


def restored_unit(u: dict) -> BatchUnit:
    return BatchUnit(**(u | {"segments": [tuple(x) for x in u["segments"]]}))


def pending_state(p: Pending) -> dict:
    return asdict(p)


def restored_pending(p: dict) -> Pending:
    return Pending(restored_unit(p["unit"]), p["sequence"], p["chunk_id"], list(p["chunk_ids"]), list(p["parts"]))


def state_of(s: Stitcher) -> dict:
    """What a stream keeps between batches: the open unit and the counter, as plain values."""
    return {"next": s.next, "pending": pending_state(s.pending) if s.pending else None}


def restored(text: object, state: dict | None) -> Stitcher:
    s = Stitcher(text)
    if state:
        s.next = state["next"]
        s.pending = restored_pending(state["pending"]) if state["pending"] else None
    return s
