"""Token ids of whole texts by public tokenizers, with a bounded cache of words."""

from __future__ import annotations

import base64
import functools
import os
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers before it starts a new generation.
CACHE = 400_000

# Python's split() also parts at U+001C to U+001F, which the tokenizer keeps as symbols; the lower
# case of two capitals depends on the context or adds a mark. Texts with any of these are special.
_SPECIAL = ("\x1c", "\x1d", "\x1e", "\x1f", "Σ", "İ")
# A stop or comma that belongs to a longer run of symbols.
_RUNS = r"[^\p{L}\p{N}\s][.,][ \n]"
#: Words encoded in one string.
TOGETHER = 500


class WordTokenizer:
    """Ids of a tokenizer that never joins across white space, as little-endian unsigned 32-bit bytes.

    Each white-space word is encoded by the tokenizer itself, once, and then
    remembered; words that no longer occur are forgotten with their generation.
    Strings of special tokens are encoded as these, as the tokenizer does by itself; with
    ``plain`` they are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.marks = [] if plain else [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a run of letters
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, words: list[str]) -> None:
        letters = [w for w in words if w.isalpha()]  # each is one run, and its last id says so
        raw = b"".join(self._encode([" ".join(letters[i : i + TOGETHER]) for i in range(0, len(letters), TOGETHER)]))
        ends = (4 * np.flatnonzero(self.last[np.frombuffer(raw, dtype="<u4")]) + 4).tolist()
        if len(ends) == len(letters):
            self.now.update((w, raw[a:b]) for w, a, b in zip(letters, [0, *ends], ends, strict=False))
            words = [w for w in words if not w.isalpha()]
        self.now.update(zip(words, self._encode(words), strict=True))

    def lists(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow column in a row, null as empty, and where each text's ids start, with their end.

        Give it a few MB of text at a time: its distinct words are looked up once, and Arrow puts
        their ids in the places of the words.
        """
        texts = [x or "" for x in array.to_pylist()]
        runs = pc.fill_null(pc.match_substring_regex(array, _RUNS), False)
        odd = pc.fill_null(functools.reduce(pc.or_, [pc.match_substring(array, x) for x in _SPECIAL]), False).to_pylist()
        apart: dict[int, np.ndarray] = {}
        for i, text in enumerate(texts):
            low = text.lower()
            if odd[i] or any(x in low for x in self.marks):
                apart[i], texts[i] = np.frombuffer(self._encode([text])[0], dtype="<u4"), ""
            elif text.isascii() or _composed(text):
                texts[i] = low
        plain = parted = pa.array(texts, pa.large_string())
        for sign, space in ((".", " "), (",", " "), (".", "\n"), (",", "\n")):
            parted = pc.replace_substring(parted, sign + space, f" {sign} ")
        # outside of longer runs of symbols, a stop or comma before white space is a run of its own
        parts = pc.utf8_split_whitespace(pc.if_else(runs, plain, parted))
        words = parts.flatten().dictionary_encode()
        known = self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        held = pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(sizes)], np.frombuffer(b"".join(known), dtype="<u4"))
        ids = held.take(words.indices).flatten().to_numpy()
        after = np.r_[0, np.cumsum(sizes[words.indices.to_numpy()])]
        first = after[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        if apart:
            rows = [apart.get(i, ids[first[i] : first[i + 1]]) for i in range(len(texts))]
            ids, first = np.concatenate(rows), np.r_[0, np.cumsum([len(x) for x in rows])]
        return ids, first

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words. The empty one, before or behind white space or all of an empty text, has none."""
        if len(self.now) > CACHE:
            self.before, self.now = self.now, {}
        self.now[""] = b""
        known = list(map(self.now.get, words))
        new = [w for w, ids in zip(words, known, strict=True) if ids is None]
        self.now.update((w, self.before[w]) for w in new if w in self.before)
        if miss := [w for w in new if w not in self.now]:
            self._remember(miss)
        return list(map(self.now.__getitem__, words)) if new else known


def _composed(text: str) -> bool:
    return unicodedata.is_normalized("NFC", text)


@functools.lru_cache(maxsize=4)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@functools.lru_cache(maxsize=4)
def byte_tokenizer(path: str, pattern: str):
    """A byte-level BPE from a file of ranks; call its encode_ordinary()."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
