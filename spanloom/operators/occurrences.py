"""Where pieces of a text occur, from an index that is made once."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable

import numpy as np

try:
    import ahocorasick
except ImportError:  # pieces are searched one by one then
    ahocorasick = None

#: Pieces times characters from which on all pieces are searched in one pass.
TOGETHER = 1 << 22
#: Searches of one text after which an index is worth its making.
SCANS = 64
#: A shortened quote keeps at least so many words and characters.
MIN_WORDS, MIN_CHARS = 4, 24


def count_until(text: str, piece: str, since: int, at: int) -> int:
    """How many places of a piece begin in [since, at]."""
    n, place = 0, text.find(piece, since) if piece else -1
    while 0 <= place <= at:
        n, place = n + 1, text.find(piece, place + 1)
    return n


class Suffixes:
    """A text's suffixes in sorted order. Any piece of the text begins a run of them, found by two binary searches."""

    def __init__(self, text: str):
        self.text = text
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        _, rank = np.unique(codes, return_inverse=True)
        rank, n, width = rank.astype(np.int64), len(codes), 1
        order = np.argsort(rank, kind="stable")
        while n and width < 2 * n:  # ranks by twice as many characters each time
            behind = np.zeros(n, dtype=np.int64)
            behind[: max(n - width, 0)] = rank[width:] + 1
            key = rank * (n + 1) + behind
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.r_[0, np.cumsum(sorted_key[1:] != sorted_key[:-1])]
            if rank[order[-1]] == n - 1:
                break
            width *= 2
        self.order = order

    def places(self, piece: str) -> np.ndarray:
        """Where a piece occurs, in no order."""
        at, size, text = self.order, len(piece), self.text
        low, high = 0, len(at)
        while low < high:
            mid = (low + high) // 2
            if text[at[mid] : at[mid] + size] < piece:
                low = mid + 1
            else:
                high = mid
        first, high = low, len(at)
        while low < high:
            mid = (low + high) // 2
            if text[at[mid] : at[mid] + size] == piece:
                low = mid + 1
            else:
                high = mid
        return at[first:low]


class Occurrences:
    """Searches of one text for pieces in a window: by scanning at first, by its suffixes if there are many."""

    def __init__(self, text: str):
        self.text, self.scans, self.suffixes = text, 0, None
        self.known: dict[str, list[int]] = {}

    def prepare(self, pieces: Iterable[str]) -> None:
        """Find every place of all pieces in one pass over the text, by an automaton, where searching them apart would take longer."""
        wanted = {p for p in pieces if p}
        if ahocorasick is None or len(wanted) * len(self.text) < TOGETHER:
            return
        automaton = ahocorasick.Automaton()
        for p in wanted:
            automaton.add_word(p, p)
        automaton.make_automaton()
        self.known = {p: [] for p in wanted}
        for end, p in automaton.iter(self.text):
            self.known[p].append(end - len(p) + 1)

    def exact(self, piece: str, low: int, high: int, nth: int | None = None) -> tuple[int, int] | None:
        """The first place in [low, high), or the nth."""
        if not piece:
            return None
        if (places := self.known.get(piece)) is not None:
            i = bisect_left(places, low) + (nth or 1) - 1
            at = places[i] if i < len(places) and places[i] + len(piece) <= high else -1
        else:
            at = self.text.find(piece, low, high)
            for _ in range((nth or 1) - 1):
                if at < 0:
                    break
                at = self.text.find(piece, at + 1, high)
        return (at, at + len(piece)) if at >= 0 else None

    def first_two(self, piece: str, low: int, high: int) -> list[int]:
        """The first place in [low, high), and the next one, if there are any."""
        self.scans += 1
        if self.suffixes is None and self.scans > SCANS:
            self.suffixes = Suffixes(self.text)
        if self.suffixes is not None:
            places = self.suffixes.places(piece)
            places = places[(places >= low) & (places + len(piece) <= high)]
            return sorted(places.tolist())[:2] if len(places) <= 64 else np.partition(places, 1)[:2].tolist()
        at = self.text.find(piece, low, high)
        again = self.text.find(piece, at + 1, high) if at >= 0 else -1
        return [x for x in (at, again) if x >= 0]

    def shortened(self, quote: str, low: int, high: int, from_front: bool = False, nth: int | None = None) -> tuple[int, int] | None:
        """The longest shortened quote that occurs in [low, high), if it occurs there once or ``nth`` tells which it is: where it begins and ends.

        Words are dropped from the end, or from the front. What occurs does so, too, when a word less is asked for, so the
        longest is found by halving.
        """
        words = quote.split(" ") if quote else []
        part = lambda n: " ".join(words[-n:] if from_front else words[:n])
        few, many, found = MIN_WORDS, len(words), None
        while few <= many:
            n = (few + many) // 2
            if places := self.first_two(part(n), low, high):
                found, few = (n, places), n + 1
            else:
                many = n - 1
        if found is None or len(part(found[0])) < MIN_CHARS:
            return None
        if nth:
            return self.exact(part(found[0]), low, high, nth)
        if len(found[1]) > 1:
            return None
        return found[1][0], found[1][0] + len(part(found[0]))
