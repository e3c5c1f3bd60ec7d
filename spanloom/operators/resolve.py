"""Kernel: find a batch's quotes in its text and turn items into units of the batch."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from spanloom.functions.text import CONFUSABLES, KNOWN_ROLES, WS_CODES
from spanloom.operators.occurrences import Occurrences, count_until
from spanloom.operators.payloads import FIELDS

_FOLD = str.maketrans(CONFUSABLES)
_BLANK = np.zeros(max(WS_CODES) + 2, dtype=bool)
_BLANK[list(WS_CODES)] = True


def folded(text: str) -> str:
    """Typography folded; ASCII text has none."""
    return text if text.isascii() else text.translate(_FOLD)


class Searchable:
    """A text with white space collapsed and typography folded, and where each of its characters was."""

    def __init__(self, raw: str):
        codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        blank = _BLANK[np.minimum(codes, len(_BLANK) - 1)]
        keep = ~(blank & np.r_[False, blank[:-1]]) if len(codes) else np.zeros(0, dtype=bool)
        self.at = np.r_[np.flatnonzero(keep), len(codes)]
        shown = np.where(blank, np.uint32(32), codes)[keep]
        self.text = folded(shown.tobytes().decode("utf-32-le", "surrogatepass"))
        self.occurrences = Occurrences(self.text)

    def raw(self, position: int) -> int:
        return int(self.at[position])

    def exact(self, quote: str | None, low: int, high: int, nth: int | None = None) -> tuple[int, int] | None:
        """First occurrence inside [low, high), or the nth."""
        return self.occurrences.exact(folded(quoted(quote)), low, high, nth) if quote else None

    def shortened(self, quote: str | None, low: int, high: int, from_front: bool = False, nth: int | None = None) -> tuple[int, int] | None:
        """The longest shortened quote that occurs in [low, high), if it occurs there once or ``nth`` tells which it is."""
        return self.occurrences.shortened(folded(quoted(quote)), low, high, from_front, nth) if quote else None


def quoted(quote: str) -> str:
    """A quote with its white space collapsed and stripped."""
    return " ".join(quote.split())  # split() knows just the same white space


@dataclass
class Found:
    """Where one segment's bounds are: raw positions, and the normalized ones of the start's match."""

    start: int = -1
    end: int = -1
    at: int = -1
    at_end: int = -1
    fallback: bool = False
    ambiguous: bool = False


def resolve(text: Searchable, specs: list[dict]) -> list[Found]:
    """Three passes over a batch's segments in the order sent: exact starts, shortened starts, ends.

    A quote is found at its first place in reach, unless ``start_nth`` or ``end_nth`` of its segment counts further from there.
    """
    out, size = [Found() for _ in specs], len(text.text)
    cursor = 0
    text.occurrences.prepare(folded(quoted(s[f])) for s in specs for f in FIELDS if s[f])
    for s, f in zip(specs, out, strict=True):
        after = bool(s["start_after_quote"])
        hit = text.exact(s["start_after_quote"] if after else s["start_quote"], cursor, size, s.get("start_nth"))
        if hit:
            f.at, f.at_end = hit
            f.start = text.raw(hit[1] if after else hit[0])
            cursor = hit[0] + 1
    later = [size] * (len(out) + 1)  # normalized start of the next segment found exactly
    for i in range(len(out) - 1, -1, -1):
        later[i] = out[i].at if out[i].at >= 0 else later[i + 1]
    low = 0
    for i, (s, f) in enumerate(zip(specs, out, strict=True)):
        if f.at < 0 and s["start_quote"] and not s["start_after_quote"]:
            hit = text.shortened(s["start_quote"], low, later[i + 1], nth=s.get("start_nth"))
            f.ambiguous = hit is None
            if hit:
                f.at, f.at_end, f.fallback, f.start = *hit, True, text.raw(hit[0])
        if f.at >= 0:
            low = f.at + 1
    following: Found | None = None
    bounds: list[Found | None] = [None] * len(out)
    for i in range(len(out) - 1, -1, -1):
        bounds[i] = following
        following = out[i] if out[i].at >= 0 else following
    for s, f, nxt in zip(specs, out, bounds, strict=True):
        since = f.at_end if f.at >= 0 else 0
        if s["end_before_quote"]:
            hit = text.exact(s["end_before_quote"], since, nxt.at_end if nxt else size, s.get("end_nth"))
            if hit and text.raw(hit[0]) > f.start:
                f.end = text.raw(hit[0])
        elif s["end_quote"]:
            high = nxt.at if nxt else size
            nth = s.get("end_nth")
            hit = text.exact(s["end_quote"], since, high, nth) or text.shortened(s["end_quote"], since, high, True, nth)
            if hit:
                f.end = text.raw(hit[1])
    return out


class Numbering:
    """For providers that know which words they quote: numbers quotes that occur before that, too, as ``resolve`` counts them.

    Segments must come in the order sent.
    """

    def __init__(self, texts: list[str]):
        shown = [folded(quoted(t)) for t in texts]
        self.text, self.spans, at = " ".join(shown), [], 0
        for t in shown:
            self.spans.append((at, at + len(t)))
            at += len(t) + 1
        self.cursor = self.low = 0

    def segment(self, sent: dict, start: int, end: int) -> dict:
        """A segment whose quotes are the first and last words of [start, end), with numbers where it needs them."""
        text, made, since = self.text, dict(sent), 0
        quote = folded(quoted(sent.get("start_after_quote") or sent.get("start_quote") or ""))
        if quote and text.startswith(quote, start):
            n = count_until(text, quote, self.cursor, start)
            made |= {"start_nth": n} if n > 1 else {}
            self.cursor = self.low = start + 1
            since = start + len(quote)
        elif quote:  # it goes wrong somewhere: its longest right part
            words = quote.split(" ")
            n = next((n for n in range(len(words) - 1, 0, -1) if text.startswith(" ".join(words[:n]), start)), 0)
            part = " ".join(words[:n])
            if part and count_until(text, part, self.low, len(text)) > 1:
                made["start_nth"] = count_until(text, part, self.low, start)
            self.low, since = start + 1, start + len(part)
        quote = folded(quoted(sent.get("end_before_quote") or sent.get("end_quote") or ""))
        if quote and text.endswith(quote, 0, end):
            n = count_until(text, quote, since, end - len(quote))
            made |= {"end_nth": n} if n > 1 else {}
        return made


def clipped(segments: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, str]], bool]:
    """Valid segments by start, later ones cut where they overlap; whether any was cut."""
    out, cut, reach = [], False, -1
    for start, end, role in sorted((s for s in segments if s[0] >= 0 and s[1] > s[0]), key=lambda s: s[0]):
        cut |= start < reach
        start = max(start, reach)
        if end > start:
            out.append((start, end, role))
            reach = end
        reach = max(reach, end)
    return out, cut


def role_texts(text: object, segments: list[tuple[int, int, str]]) -> dict[str, str]:
    return {role: "\n\n".join(text[a:b] for a, b, r in segments if r == role and b > a) for role in KNOWN_ROLES}


@dataclass
class BatchUnit:
    """One item of a batch with its bounds in the batch's text and in the document's."""

    status: str
    specs: list[dict]
    segments: list[tuple[int, int, str]]  # document positions
    start: int
    end: int
    start_quote: str | None
    end_quote: str | None
    partial: bool
    end_resolved: bool
    verbatim: bool
    fallback: bool
    ambiguous: bool
    model: object = field(default=None)


def batch_unit(item: dict, specs: list[dict], found: list[Found], text: str, shift: int, keep_lone_ends: bool = True) -> BatchUnit:
    """Judge one item. ``keep_lone_ends``: an item that goes on from an earlier batch keeps an end found without a start."""
    parts, partial = [], False
    for s, f in zip(specs, found, strict=True):
        wants_start = bool(s["start_after_quote"] or s["start_quote"])
        if f.start >= 0 and f.end > f.start:
            parts.append((f.start, f.end, s["role"]))
        else:
            partial |= (wants_start and f.start < 0) or (f.start >= 0 and f.end < 0)
    resolved = len(parts)
    parts, overlap = clipped(parts)
    partial |= overlap
    start = parts[0][0] if parts else next((f.start for f in found if f.start >= 0), -1)
    end = parts[-1][1] if parts else -1
    if not parts and keep_lone_ends and start < 0 and item.get("status") == "truncated_at_start":
        end = next((f.end for f in reversed(found) if f.end >= 0), -1)
    if len(specs) == 1:
        s, f = specs[0], found[0]
        sides = (f.start >= 0 or not (s["start_after_quote"] or s["start_quote"])) and (f.end >= 0 or not (s["end_before_quote"] or s["end_quote"]))
        verbatim = sides and (f.start < 0 or f.end < 0 or f.end > f.start)
    else:
        verbatim = resolved == len(specs) and not partial and bool(role_texts(text, parts)["requirement"])
    move = lambda x: x + shift if x >= 0 else -1
    return BatchUnit(
        str(item.get("status") or "complete"), specs, [(a + shift, b + shift, r) for a, b, r in parts], move(start), move(end), specs[0]["start_quote"],
        specs[-1]["end_before_quote"] or specs[-1]["end_quote"], partial, resolved == len(specs) and not partial, verbatim, any(f.fallback for f in found), any(f.ambiguous for f in found), item,
    )
