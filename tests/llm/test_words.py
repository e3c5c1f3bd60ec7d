"""Decontamination, spelling variants and alignment against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from spanloom.llm import alignment, decontaminate, spelling

EXTRA = "row long, term string, pos int, word string, n long, w long, start int, id string, kind string, chunk long, key string, part int"
CLASH = (1, "t", 2, "w", 3, 4, 5, "i", "k", 6, "y", 7)


def frame(spark, rows, kind="doc_id long, text string"):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], f"{kind}, {EXTRA}").repartition(3)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def exact(docs, items, width):
    """For each document its words, hit places and items."""
    out = []
    for d, text in docs:
        v, hit, found = words(text), set(), set()
        for item, t in items:
            u = words(t)
            for i in range(max(len(u) - width, 0) + 1 if u else 0):
                g = u[i : i + width]
                for s in range(len(v) - len(g) + 1):
                    if v[s : s + len(g)] == g:
                        hit |= set(range(s, s + len(g)))
                        found.add("" if item is None else str(item))
        out.append((d, len(v), len(hit), sorted(found)))
    return sorted(out, key=str)


def near(docs, items, width, slop):
    """Starts at which each word of a window stands within ``slop`` of where its rarest word puts it."""
    texts = {d: words(t) for d, t in docs}
    count = Counter(w for v in texts.values() for w in v)
    out = set()
    for item, t in items:
        u = words(t)
        for i in range(max(len(u) - width, 0) + 1 if u else 0):
            g = u[i : i + width]
            if not all(count[w] for w in g):
                continue
            off = min(range(len(g)), key=lambda k: (count[g[k]], k))
            for d, v in texts.items():
                for p in (p for p, w in enumerate(v) if w == g[off]):
                    if all(any(v[q] == w for q in range(max(p - off + k - slop, 0), min(p - off + k + slop, len(v) - 1) + 1)) for k, w in enumerate(g) if k != off):
                        out.add((d, p - off, item))
    return out


def passages(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(9)] + ["É", "naïve", "x1"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([2, 5, 9])))) for i in range(8)] + [(None, "W1 w2, w3."), (3, "w1 w1 w1 w1"), (9, None), (10, " ?! ")]
    docs = [(i, " ".join(rng.choice([rng.choice(vocab), rng.choice(items)[1] or ""]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    return [*docs, (60, None), (61, ""), (61, docs[3][1]), (None, docs[4][1]), (62, "w1 " * 3000)], items


@pytest.mark.parametrize("block", [1_000_000, 3])
def test_passages_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    docs, items = passages(3)
    got = decontaminate.hits(frame(spark, docs), frame(spark, items, "item_id long, text string"), width=4)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=str) == exact(docs, items, 4)
    assert decontaminate.hits(frame(spark, docs).where("false"), frame(spark, items, "item_id long, text string")).count() == 0
    none = decontaminate.hits(frame(spark, docs), frame(spark, items, "item_id long, text string").where("false"))
    assert none.where("n_hit > 0 OR size(items) > 0").count() == 0 and none.count() == len(docs)


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_proximity(spark, slop):
    docs, items = passages(4)
    docs = [(d, t) for d, t in docs if d is not None and d < 60]
    items = [(i, t) for i, t in items if i is not None and i < 3]
    df, tests = frame(spark, docs), frame(spark, items, "item_id long, text string")
    vocab = decontaminate.vocabulary(tests)
    postings = decontaminate.index(df, vocab)
    found = decontaminate.windows(tests, postings, vocab, 4)
    at = decontaminate.occurrences(postings, found, slop)
    ids = postings.where("term = -1").select("row", "id")
    got = at.join(ids, "row").join(found.select("w", F.explode("items").alias("item")), "w")
    assert {(r.id, r.start, int(r.item)) for r in got.collect()} == near(docs, items, 4, slop)


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=10):
    out, near_of = {}, defaultdict(list)
    for a in counts:
        for b in counts:
            if a != b and edits(a, b):
                near_of[a].append(b)
    form = {a: min(near_of[a], key=lambda b: (-counts[b], b), default=None) for a in counts}
    form = {a: b if b and counts[b] >= ratio * counts[a] else None for a, b in form.items()}
    for a in counts:
        root = a
        while form[root]:
            root = form[root]
        out[a] = (form[a], root, counts[a], len(near_of[a]), counts[form[a]] if form[a] else None)
    return out


@pytest.mark.parametrize("seed, size, alphabet", [(1, 7, "ab"), (2, 40, "abcé"), (3, 100_000, "abÿ"), (4, 3, "a")])
def test_variants_are_found(spark, monkeypatch, seed, size, alphabet):
    monkeypatch.setattr(spelling, "RANGE", size)
    rng = random.Random(seed)
    counts = {"".join(rng.choice(alphabet) for _ in range(rng.randint(3, 7))): rng.choice([2, 3, 25, 300, 4000]) for _ in range(250)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, least=3).collect()}
    assert got == plain_variants(counts)
    assert seed == 4 or any(v[1] != v[0] and v[0] for v in got.values())


def test_words_of_texts(spark):
    rng = random.Random(9)
    vocab = ["letters", "straße", "naïveté", "ÉCLAIRS", "wordlist", "x" * 5000, "short", "l'allemand", "ÀÿÀÿÀÿÀ"]
    docs = [(i, rng.choice([" ", "9", "\n"]).join(rng.choice(vocab) for _ in range(30))) for i in range(80)] + [(80, None), (81, ""), (None, "letters letters"), (80, "letters")]
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            counts[run] += len(run) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}
    assert {r.word: r.n for r in spelling.lexicon(frame(spark, docs)).collect()} == counts
    assert {r.word for r in spelling.variants(spelling.lexicon(frame(spark, docs))).collect()} == set(counts)
    assert spelling.variants(spelling.lexicon(frame(spark, docs).where("false"))).count() == 0


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts(seed):
    rng = random.Random(seed)
    bits = ["the", "The", " ", "  ", "\n", "\n\n", "\t", "\r\n", "don't", "x1", "é", "日本", " ", "　", "😀", "<|endoftext|>", "<s>", "<0x41>", "end.", ");", "\x1c", "\x00", "word", "aaaa" * 50, "-", " \n "]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    return [*made, *made[:5], "a ▁ b", "▁", "the end", " ", "\n", "  x", "x  ", "word " * 4000, "z" * 5000]


@pytest.mark.parametrize("most", [400_000, 20])
def test_alignment(spark, paths, most):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    pair = alignment.Pair(*paths)
    docs = list(enumerate(texts(5))) + [(500, None), (501, ""), (0, "the end"), (None, "the word")]
    made, count = [], Counter()
    for d, t in docs:
        ids = ([], [])
        if t:
            ids = (a.encode(f" {t}", add_special_tokens=False).ids, b.encode(t))
        parts = [[table[i] for i in x] for x, table in zip(ids, (pair.bytes_a, pair.bytes_b), strict=True)]
        if not t or any(b"".join(p) != f" {t}".encode() for p in parts):
            made.append((d, None))
            continue
        ends = [list(accumulate(map(len, p))) for p in parts]
        groups, at = [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            to = [x.index(e, k) + 1 for x, k in zip(ends, at, strict=True)]
            groups.append(tuple(x[k:n] for x, k, n in zip(ids, at, to, strict=True)))
            at = to
        made.append((d, groups))
        count.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    want = []
    for d, groups in made:
        if groups is None:
            want.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        want.append((d, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[k] == top[k[0]] for k in links), sum(count[k] for k in links), text))
    assert sum(g is None for _, g in made) == 4
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = alignment.align(frame(spark, docs), *paths, most=most)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(want, key=str)
    digest = {r.doc_id: r.groups for r in alignment.align(frame(spark, docs), *paths, digest=True).where("doc_id BETWEEN 10 AND 20").collect()}
    assert digest == {w[0]: hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for w in want if w[0] is not None and 10 <= w[0] <= 20}


def test_alignment_of_nothing(spark, paths):
    assert alignment.align(frame(spark, [(1, "a")]).where("false"), *paths).count() == 0
    got = alignment.align(frame(spark, [(1, None), (2, "")]), *paths).collect()
    assert [(r.n_a, r.n_groups, r.groups) for r in got] == [(0, 0, "")] * 2


def test_large_groups_are_paired_by_distinct_ids(monkeypatch):
    raw = [b"1,2,1|5,6,5,6;3|4", b"7|8", b""]
    whole = alignment.Chunk([alignment.parcel([0, 1], raw[:2]), alignment.parcel([2], raw[2:])])
    monkeypatch.setattr(alignment, "LARGE", 2)
    other = alignment.Chunk([alignment.parcel([2, 0], [raw[2], raw[0]]), alignment.parcel([1], raw[1:2])])
    import numpy as np

    for c in (whole, other):
        pairs, times = c.links(np.array([0, 1, 0]))
        assert {(int(p) >> 32, int(p) & 0xFFFFFFFF): int(t) for p, t in zip(c.pairs[pairs], times, strict=True)} == {(1, 5): 8, (1, 6): 8, (2, 5): 4, (2, 6): 4, (3, 4): 2, (7, 8): 1}
        assert c.bad.tolist() == [False, False, True] and c.n_links.tolist() == [13, 1, 0]


def test_cuts_are_checked(paths):
    pair = alignment.Pair(*paths)
    assert alignment.segments("a b\n c\td") == [" a", " b", "\n c\td"] and alignment.segments("  b") == ["   b"] and alignment.segments(None) == []
    assert pair.aligned([" ▁"]) == [""] and pair.aligned([" "])[0]
