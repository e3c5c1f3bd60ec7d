"""The whole pipeline against a plain version of its stages, one document at a time."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import regex as re
from tokenizers import Tokenizer

import corpus_pipeline
from spanloom.llm import mixing, packing

SF = "/root/testdata/sf0.001"
BUCKETS, CHUNK = 1 << 16, 2048


def words(text):
    return re.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())


def features(text):
    """Hashed byte n-grams of the words, spaced."""
    data = f" {' '.join(words(text))} ".encode()
    for order in (2, 3, 4):
        for i in range(len(data) - order + 1):
            h = 0
            for byte in data[i : i + order]:
                h = (h * 0x01000193 ^ byte) % 2**32
            yield (h + order) * 0x9E3779B1 % 2**32 >> 16


def plain_languages(docs):
    """Documents with a recognised language, and that language; at most five languages are expected."""
    seen = defaultdict(Counter)
    for d in docs:
        if d["text"] is not None and d["lang"] is not None and (d["doc_id"] is None or zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2):
            seen[d["lang"]].update(features(d["text"]))
    names = sorted(seen)
    assert 2 <= len(names) <= 5
    size = {k: sum(seen[k].values()) + BUCKETS / 2 for k in names}
    chance = {k: [(seen[k][g] + 0.5) / size[k] for g in range(BUCKETS)] for k in names}
    bits = []
    for split in range(1, 1 << (len(names) - 1)):
        side = [k for i, k in enumerate(names) if split >> i & 1]
        other = [k for k in names if k not in side]
        up, down = ([sum(chance[k][g] for k in part) / len(part) for g in range(BUCKETS)] for part in (side, other))
        weight = [math.log(u / d) for u, d in zip(up, down)]
        bits.append((side, weight, sum((u - d) * w for u, d, w in zip(up, down, weight)) / 2))
    trust = sum(t for _, _, t in bits)
    for d in docs:
        if d["text"] is None or not re.search(r"\p{L}", d["text"]):
            continue
        grams = list(features(d["text"]))
        loss = dict.fromkeys(names, 0.0)
        for side, weight, t in bits:
            margin = min(40, max(-40, sum(weight[g] for g in grams) / math.sqrt(len(grams))))
            for k in names:
                loss[k] += t / trust * math.log1p(math.exp(-margin if k in side else margin))
        odds = {k: math.exp((min(loss.values()) - x) * len(bits)) for k, x in loss.items()}
        first, second = sorted(odds.values())[:-3:-1]
        if len(d["text"]) < 50 or (first - second) / sum(odds.values()) >= 0.2:
            yield d | {"lang": min(names, key=loss.get)}


def plain_copies(docs):
    """The document with the smallest id of each group of texts linked at a Jaccard similarity of 0.8."""
    sets, root = [], list(range(len(docs)))
    for d in docs:
        w = words(d["text"])
        sets.append({tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                root[top(i)] = top(j)
    groups = defaultdict(list)
    for i, d in enumerate(docs):
        groups[top(i)].append(d)
    return [min(g, key=lambda d: d["doc_id"]) for g in groups.values()]


def plain_mixture(docs):
    """Documents, once for each time that their source's budget takes them."""
    size = lambda d: len(re.findall(r"[^ \t\n\r]+", d["text"]))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    own = defaultdict(list)
    for d in docs:
        own["-" if d["source"] is None else "=" + d["source"]].append(d)
    total = {s: sum(map(size, ds)) for s, ds in own.items()}
    everything = sum(total.values())
    share = {s: n / everything for s, n in total.items()}

    def enough(a):
        return max(q ** (a - 1) for q in share.values()) / sum(q**a for q in share.values()) <= mixing.MAX_REPEAT

    low, high = 0.0, 1.0
    for _ in range(20):
        low, high = (low, (low + high) / 2) if enough((low + high) / 2) else ((low + high) / 2, high)
    power = 0.0 if enough(0.0) else high
    for s, ds in own.items():
        budget = math.floor(share[s] ** power / sum(q**power for q in share.values()) * everything + 0.5)
        full = total[s] / mixing.BLOCK_TOKENS
        count = max(1, math.ceil(min(full, math.sqrt(full * mixing.MAX_BLOCKS))))
        blocks = defaultdict(list)
        for d in sorted(ds, key=lambda d: (md5(f"17:{d['doc_id']}"), d["doc_id"])):
            blocks[int(md5(f"17:{d['doc_id']}")[:12], 16) % count].append(d)
        for turn in range(budget // total[s] + 1):
            left = total[s] if turn < budget // total[s] else budget % total[s]
            for b in sorted(blocks, key=lambda b: (md5(f"17:{s}:{turn}:{b}"), b)):
                inside = 0
                for d in blocks[b]:
                    inside += size(d)
                    if inside <= left:
                        yield d
                left -= inside


def plain_pieces(docs):
    """Whole windows and a remainder of each document's ids."""
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokenizer.encode_special_tokens = True
    for d in docs:
        ids = [*tokenizer.encode(d["text"], add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), CHUNK):
            part = ids[at : at + CHUNK]
            yield d["doc_id"], at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), len(ids)


def test_pipeline_equals_a_plain_version(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 500)  # several blocks a source
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 4)  # and more than their number grows evenly to
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS)
    rows = docs.collect()
    by_lang = {r.lang: r for r in rows if r.lang is not None and r.text}
    two = [r.text for r in by_lang.values()][:2]
    long = " ".join([r.text for r in rows if r.lang == rows[0].lang and r.text][:40])
    rng, said = random.Random(8), rows[0].text.split()
    small = [(91000 + i, " ".join(rng.choice(said) for _ in range(12)), None, "small", 0) for i in range(15)]
    odd = [
        (90000, None, "en", "s", 0), (90001, "", "en", None, 0), (90002, "12 34 !!", "en", "s", 8), (90003, "x y z", None, "small", None),
        (90004, " ".join(two), None, "s", 9), (90005, long, rows[0].lang, "web", None), (90006, long + " more", None, None, None),
        (90007, rows[0].text, rows[0].lang, "a source of its own", 1), (90008, rows[0].text + " 7", rows[0].lang, None, 1),
    ]
    full = docs.unionByName(spark.createDataFrame(odd + small, docs.schema))
    clash = ["row", "class_id", "lang_pred", "ambiguous", "tokens", "block", "length", "piece", "id", "_s"]
    full.selectExpr("*", *[f"'x' AS {c}" for c in clash]).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    recognised = list(plain_languages([r.asDict() for r in full.collect()]))
    assert len(recognised) >= len(rows) and not {90000, 90001, 90002} & {d["doc_id"] for d in recognised}
    kept = plain_copies(recognised)
    assert 0.5 * len(recognised) < len(kept) < len(recognised) - 2 and 90006 not in {d["doc_id"] for d in kept}
    taken = list(plain_mixture(kept))
    assert Counter(d["doc_id"] for d in taken).most_common(1)[0][1] > 1 and len({d["doc_id"] for d in taken}) < len(kept)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == Counter(plain_pieces(taken))
    assert any(r.start for r in got)

    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= CHUNK
    assert sum(r.length for r in got) > 0.9 * CHUNK * len(sequences)
