"""Words, word-shingle hashes and MinHash signatures over whole Arrow text columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}
#: Bytes of text worked on at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def normalized(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Lower-case words joined by single spaces; a word is a run of letters, their marks and digits. Null gives ''."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    words = pc.replace_substring_regex(pc.utf8_lower(texts), pattern=r"[^\p{L}\p{M}\p{N}]+", replacement=" ")
    return pc.ascii_trim(words, characters=" ")


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name][:n]


@dataclass
class Words:
    """The words of a slice of texts: byte spans, and a prefix hash that gives any span's hash."""

    data: np.ndarray
    texts: np.ndarray  # byte offsets of the texts, one more than texts
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word, one more than texts

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from each ``begin`` to each ``end``."""
        n = len(self.data)
        if not hasattr(self, "prefix"):
            self.prefix = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTES[self.data] * _power("up", _BASE, n), out=self.prefix[1:])
        return mixed((self.prefix[end] - self.prefix[begin]) * _power("down", _INVERSE, n + 1)[begin])

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words, and each text's first one (one more than texts).

        A text of fewer words has one shingle of all its words; a text without words none.
        """
        count = np.diff(self.first)
        made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
        bound = np.r_[0, np.cumsum(made)]
        text = np.repeat(np.arange(len(count)), made)
        begin = np.arange(bound[-1]) - bound[:-1][text] + self.first[:-1][text]
        last = np.minimum(begin + width, self.first[1:][text]) - 1
        return self.hashes(self.starts[begin], self.ends[last]), bound


def words_of(texts: pa.Array) -> Words:
    """Index the words of normalised texts."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    gaps = np.flatnonzero(data == 32)
    full = np.diff(offsets) > 0
    starts = np.sort(np.r_[offsets[:-1][full], gaps + 1])
    ends = np.sort(np.r_[offsets[1:][full], gaps])
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of about SLICE_BYTES; a longer text stands alone."""
    size = np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))] if len(texts) else np.zeros(1)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, size[at] + SLICE_BYTES, side="right")) - 1)
        yield at, to
        at = to


def permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors of n 32-bit hash permutations; more of them begin with the same ones."""
    drawn = np.random.default_rng(seed).integers(0, 1 << 32, (n, 2), dtype=np.uint32) | np.uint32(1)
    return drawn[:, 0], drawn[:, 1]


def minhashes(hashes: np.ndarray, bound: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The n MinHash values of each text that has shingles, one row a text; others have zeros."""
    out = np.zeros((len(bound) - 1, n), dtype=np.uint32)
    full = np.flatnonzero(np.diff(bound))
    if len(full):
        low = (hashes >> np.uint64(32)).astype(np.uint32)
        at = bound[:-1][full]
        for j, (a, b) in enumerate(zip(*permutations(n, seed), strict=True)):
            value = low * a
            value ^= value >> np.uint32(15)
            value *= b
            out[full, j] = np.minimum.reduceat(value, at)
    return out


def digests(texts: pa.Array) -> list[bytes]:
    return [hashlib.md5(memoryview(x.as_buffer())).digest() for x in texts]
