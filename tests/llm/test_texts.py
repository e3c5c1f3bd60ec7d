"""Text operators against brute force, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex as re
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import jaccard, langid, licenses, mixing, packing, sharding, shingles, token_counts
from spanloom.llm.tokens import WordTokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, _p string, _s int, piece int, rep string, label int, tokens string, size string, lang_pred int, score string, task string, block string"
EXTRA = ("x", "y", 1, 2, "r", 3, "t", "s", 4, "c", "k", "b")


def messy(spark):
    long = " ".join(f"word{i % 977}" for i in range(30000))
    same = "the same words stand here again and again"
    texts = [None, "", " \n", "!!", "short text", same, same.upper() + "!", long, long, "naïve café 𝄞 ümlaut " * 9, "a" * 20000]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 2}", None, *EXTRA) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, same, "en", "s0", 1, *EXTRA), (None, None, None, None, None, *EXTRA)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def documents(spark, seed, n=160):
    """Random texts with exact and near copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        base = rng.choice(texts).split() if texts and rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randint(1, 90))]
        for _ in range(rng.randint(0, 3) if rng.random() < 0.7 else 0):
            base[rng.randrange(len(base))] = rng.choice(words)
        texts.append(" ".join(base))
    texts += ["", None, *texts[:20]]
    return spark.createDataFrame([(3 * i, t, f"s{i % 5}") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(5)


def words(text):
    return re.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())


def shingled(text, width=5):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


@pytest.mark.parametrize("seed, block", [(1, 512), (2, 3)])
def test_jaccard_join_is_exact(spark, seed, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", block)
    df = documents(spark, seed)
    sets = {r.doc_id: shingled(r.text) for r in df.collect()}
    links = defaultdict(set)
    for a, x in sets.items():
        for b, y in sets.items():
            if a != b and x and y and len(x & y) >= 0.8 * len(x | y):
                links[a].add(b)
    root = {a: a for a in sets}
    for _ in sets:
        root = {a: min([root[a], *(root[b] for b in links[a])]) for a in sets}
    got = {r.doc_id: r for r in jaccard.jaccard_join(df).collect()}
    assert {a: (r.n_links, r.class_id, r.kept) for a, r in got.items()} == {a: (len(links[a]), root[a], root[a] == a) for a in sets}
    assert sum(map(len, links.values())) > 50


def test_jaccard_join_edges(spark):
    got = {r.doc_id: r for r in jaccard.jaccard_join(messy(spark)).collect()}
    assert set(got) == {None, *range(11)}
    assert (got[6].class_id, got[6].copy_id, got[6].n_links, got[6].kept) == (5, 5, 1, False)
    assert (got[8].class_id, got[8].n_links) == (7, 1)
    assert all(got[i].n_links == 0 and got[i].kept for i in (None, 0, 1, 2, 3, 4, 9, 10))
    assert jaccard.jaccard_join(messy(spark).where("false")).count() == 0


def test_jaccard_join_checks_the_text_it_signed(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    stands = min(one, two, key=lambda t: hashlib.md5(t.encode()).digest())
    for pair in ([one, two], [two, one]):
        rows = [(1, pair[0]), (1, None), (1, pair[1]), (2, one + " more"), (3, two + " more")]
        got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
        assert got == {1: (1, 1), 2: (1, 1) if stands == one else (2, 0), 3: (3, 0) if stands == one else (1, 1)}


def similarities(df):
    sets = [(r.doc_id, shingled(r.text)) for r in df.collect()]
    return {(a, b): len(x & y) / len(x | y) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :]}


@pytest.mark.parametrize("edits, block", [(1, 40), (5, 40)])
def test_large_families_are_linked_exactly(spark, edits, block, monkeypatch):
    """Hundreds of different near copies: tight ones, whose links distances decide, and loose ones, compared as differences."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(edits)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(150)] = f"x{rng.randrange(4000)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, f"{rows[i % 7][1]} {'tail ' * (i % 3)}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    links = Counter()
    for (a, b), s in similarities(df).items():
        if s >= 0.8:
            links[a] += 1
            links[b] += 1
    got = jaccard.jaccard_join(df).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: links[i] for i, _ in rows}
    assert sum(links.values()) > 4000


def test_texts_of_a_large_family_travel_once(spark, monkeypatch):
    """20,000 near copies of one text: no pair of blocks is dealt, so the rows that are shuffled grow linearly."""
    seen = {}
    keep = jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, name: seen.setdefault(name, []).append(keep(df, name)) or seen[name][-1])
    base = F.array(*[F.lit(f"b{i}") for i in range(120)])
    text = F.array_join(F.transform(base, lambda w, i: F.when(i == F.col("id") % 120, F.concat(F.lit("x"), F.col("id"))).otherwise(w)), " ")
    df = spark.range(20000).select(F.col("id").alias("doc_id"), text.alias("text"))
    got = jaccard.jaccard_join(df).agg(F.min("n_links"), F.max("n_links"), F.max("class_id"), F.count_if("kept")).first()
    assert tuple(got) == (19999, 19999, 0, 1)
    assert seen["meetings"][0].count() == 0 and sum(x.count() for x in seen["measured"]) == 20000


def test_crowded_prefixes_keep_whole_paths(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    assert jaccard.spare_trees(0.8, 20, 6, 4, 0.9998) == 9 and jaccard.spare_trees(0.8, 20, 6, 4, 0.99998) == 0
    df = documents(spark, 7)
    signed = jaccard.signatures(df, "doc_id", "text", 5, 20, 6)
    classes = signed.selectExpr("id AS rep", "size", "high", "low").cache()
    plain = {r.rep: r.labels for r in jaccard._forest(classes, 4, 0)[1].collect()}
    for spare in (3, 20):
        members, labels = jaccard._forest(classes, 4, spare)
        changed = {r.rep: sum(a != b for a, b in zip(r.labels, plain[r.rep], strict=True)) for r in labels.collect()}
        assert 0 < max(changed.values()) <= spare
        assert all(r.n > 1 for r in members.select("n").collect())
    classes.unpersist()


def test_forest_depth():
    assert jaccard.prefix_length(0.8, 16, 8, 0.9995) == 4 and jaccard.prefix_length() == 4
    assert jaccard.prefix_length(0.99, 16, 8, 0.9) == 8 and jaccard.prefix_length(0.1, 2, 8, 0.999) == 1


def test_marks_belong_to_words(spark):
    hindi = "हिन्दी भाषा"
    assert shingles.normalized(pa.array([hindi + "! ab"])).to_pylist() == [hindi + " ab"] and words(hindi) == hindi.split()


def test_minhash_estimates_similarity():
    a, b = [str(i) for i in range(400)], [str(i) for i in range(40, 440)]
    h, at = shingles.words_of(shingles.normalized(pa.array([" ".join(a), " ".join(b)]))).shingles(1)
    m = shingles.minhashes(h, at, 512, 1)
    assert abs((m[0] == m[1]).mean() - 360 / 440) < 0.05


def test_packing_holds_every_id_once(spark):
    df = messy(spark)
    path = packing.tokenizer_path()
    plain = Tokenizer.from_file(path)
    got = packing.pack(df, path).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id, r.doc_tokens].append(r)
    wanted = Counter()
    for r in df.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        wanted[r.doc_id, tuple(ids)] += 1
    have = Counter()
    for (doc, total), pieces in by_doc.items():
        copies = sum(p.start == 0 for p in pieces)
        starts = sorted({p.start for p in pieces})
        ids = [i for s in starts for i in next(p for p in pieces if p.start == s).ids]
        assert len(ids) == total and len(pieces) == copies * len(starts)
        have[doc, tuple(ids)] += copies
    # null ids with the same number of tokens can't be told apart here
    assert {k: v for k, v in have.items() if k[0] is not None} == {k: v for k, v in wanted.items() if k[0] is not None}
    assert sum(p.length for p in got) == sum(len(k[1]) * v for k, v in wanted.items())
    spots = defaultdict(list)
    for p in got:
        spots[p.sequence_id].append((p.offset, p.length))
    assert sorted(spots) == list(range(len(spots)))
    for parts in spots.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 2048
    sums = {(r.doc_id, r.start, r.length, r.ids_crc32) for r in packing.pack(df, path, shown=packing.DIGEST).collect()}
    assert sums == {(r.doc_id, r.start, r.length, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
    assert packing.pack(df.where("false"), path).count() == 0


def test_plan_holds_the_histogram_with_little_padding():
    rng = random.Random(4)
    for lengths in ([rng.randint(1, 128) for _ in range(5000)], [128] * 50, [1] * 777, [65] * 100, [rng.choice((30, 50)) for _ in range(999)], []):
        made = packing.plan(Counter(lengths), 128)
        used = Counter()
        for shape, times in made:
            assert sum(shape) <= 128 and times > 0
            used.update({k: v * times for k, v in Counter(shape).items()})
        assert used == Counter(lengths)
    mixed = [rng.randint(1, 128) for _ in range(50000)]
    assert sum(t for _, t in packing.plan(Counter(mixed), 128)) < 1.01 * sum(mixed) / 128 + 2


def test_short_pieces_are_packed_by_the_token(spark):
    """Copies of short texts, alone and beside longer ones, leave little of a sequence empty."""
    rng = random.Random(11)
    path = packing.tokenizer_path()
    tiny = [None] * 3000 + ["a"] * 3000 + ["a b c d e"] * 4000
    for texts in (tiny, tiny + [" ".join("ab"[: rng.randint(1, 2)] for _ in range(rng.randint(1, 900))) for _ in range(300)]):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
        got = packing.pack(df, path, shown=packing.DIGEST).collect()
        assert Counter(r.doc_id for r in got) == Counter(range(len(texts)))
        spots = defaultdict(list)
        for r in got:
            spots[r.sequence_id].append((r.offset, r.length))
        assert sorted(spots) == list(range(len(spots)))
        for parts in spots.values():
            parts.sort()
            assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 2048
        assert len(spots) <= 1.03 * sum(r.length for r in got) / 2048 + 1


def test_layout_holds_the_histogram():
    rng = random.Random(5)
    for window, unit in ((2048, 16), (64, 4), (16, 4), (8, 8)):
        short = Counter(rng.randint(1, max(1, window // 16)) for _ in range(500)) if window >= 16 else Counter()
        bins = Counter(rng.randint(1, window // unit) for _ in range(rng.choice((0, 300))))
        made = packing.layout(short, bins, window, unit)
        assert set(made.short) == set(short)
        bundled = Counter()
        for n, (first, each, k, base, _) in made.short.items():
            ends = [*first[1:], short[n]]
            assert first[0] == 0 and all((b - a) % e == 0 for a, b, e in zip(first, ends, each, strict=True))
            bundled.update({(int(kk), int(bb) + t): n * int(e) for a, b, e, kk, bb in zip(first, ends, each, k, base, strict=True) for t in range((b - a) // e)})
        assert all(size <= k * unit and rank >= bins[k] for (k, rank), size in bundled.items())
        assert made.sequences * window >= sum(bundled.values())


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12) * 5
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and slope.max() < 1e-6 and abs(slope[x > 1e-9]).max(initial=0) < 1e-6


def test_word_tokenizer_equals_the_tokenizer():
    rng = random.Random(8)
    pool = ["Don't", "it's.", "!!.", "x,,", "Σας", "İstanbul", "A\x1cb", "<|endoftext|>", "naïve,", "1,000.5", "é", "é", "...", "_.", "ﬁ", "　", "𝄞.", "end."]
    texts = [rng.choice(" \n\t").join(rng.choice(pool) for _ in range(40)) + rng.choice([".", ",", ". ", ""]) for _ in range(200)] + ["", None]
    texts += ["<|startoftext|> <|endoftext|> hello", "a<|EndOfText|>b", "a<|endoftext|>b"]
    for as_text in (False, True):
        t, own = WordTokenizer(packing.tokenizer_path(), plain=as_text), Tokenizer.from_file(packing.tokenizer_path())
        own.encode_special_tokens = as_text
        plain = [np.array(own.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
        for _ in range(2):
            ids, first = t.lists(pa.array(texts))
            assert [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)] == plain
        assert (49406 in np.frombuffer(plain[-3], "<u4")) != as_text


def test_sharding_edges(spark):
    df = messy(spark)
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 8
    got = sharding.shard_by_bytes(df.drop("size"), size, 4, ["doc_id"], [F.col("doc_id"), F.col("text")]).collect()
    assert len(got) == 15
    per = defaultdict(list)
    for r in got:
        assert r.size == len((r.text or "").encode()) + 8
        per[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in per.values()) and set(per) <= set(range(4))
    ordered = [r.doc_id if r.doc_id is not None else -1 for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert ordered == sorted(ordered)
    assert sharding.shard_by_bytes(df.drop("size").where("false"), size, 4, ["doc_id"], [F.col("doc_id")]).count() == 0


def test_shards_are_balanced(spark):
    df = spark.createDataFrame([(7 if i % 3 == 0 else i, "x" * (i % 50)) for i in range(5000)], "doc_id long, text string").repartition(7)
    got = sharding.shard_by_bytes(df, F.octet_length("text"), 24, ["doc_id"], [F.col("doc_id")]).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    total = sum(i % 50 for i in range(5000))
    assert len(got) == 24 and all(abs(r.s - total / 24) <= 50 for r in got)


def test_prefix_sums_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 3)
    df = spark.range(1000).select((F.col("id") % 10).alias("_p"), "id", F.lit(2).alias("v"))
    got = sharding.with_prefix(df, ["id"], {"before": "v"}).orderBy("_p", "id").collect()
    assert [r.before for r in got] == list(range(0, 2000, 2))


def test_mixing_keeps_budgets_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), "abc"[min(2, int(rng.expovariate(1.2)))]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    total, size = Counter(), {i: len(t.split()) for i, t, _ in rows}
    for i, _, s in rows:
        total[s] += size[i]
    got = mixing.mix(df, max_repeat=1.5).collect()
    whole = sum(total.values())
    taken, weight = defaultdict(list), {}
    for r in got:
        taken[r.mix_source].append(r)
        weight[r.mix_source] = r.weight
    assert abs(sum(weight.values()) - 1) < 1e-9
    alpha = got[0].exponent
    share = {s: (n / whole) ** alpha for s, n in total.items()}
    for s, rs in taken.items():
        assert abs(weight[s] - share[s] / sum(share.values())) < 1e-9
        budget = weight[s] * whole
        used = sum(r.tokens for r in rs)
        assert budget - 31 <= used <= budget + 1 and budget / total[s] <= 1.5 + 1e-9
        at = 0
        for r in sorted((r for r in rs if r.tokens), key=lambda r: r.mix_start):
            assert r.mix_start >= at
            at = r.mix_start + r.tokens
        times = Counter(r.doc_id for r in rs)
        assert max(times.values()) - min(times[i] for i, _, src in rows if src == s) <= 1
    assert {(r.doc_id, r.mix_start) for r in mixing.mix(df.repartition(9), max_repeat=1.5).collect()} == {(r.doc_id, r.mix_start) for r in got}


def test_mixing_to_an_entropy(spark):
    totals = spark.createDataFrame([("a", 8000), ("b", 1500), ("c", 500)], "s string, tokens long")
    a = mixing.exponent(totals, 10000, entropy=0.9)
    w = np.array([0.8, 0.15, 0.05]) ** a
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() / np.log(3) - 0.9) < 1e-4
    assert mixing.exponent(totals, 10000, entropy=0.0) == 1.0 or mixing.exponent(totals, 10000, entropy=0.0) > 0.99
    assert mixing.exponent(totals, 10**9, max_repeat=1.0) == 1.0
    assert mixing.exponent(totals, 10000, max_repeat=2.0, entropy=0.9) == max(a, mixing.exponent(totals, 10000, max_repeat=2.0))
    with pytest.raises(ValueError):
        mixing.exponent(totals, 10000)


def test_mixing_to_an_entropy_row_by_row(spark):
    rows = [(i, "w " * 20, "a") for i in range(200)] + [(1000 + i, "w " * 10, "b") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    free, held = (mixing.mix(df, entropy=0.95, max_repeat=limit).collect() for limit in (None, 3.0))
    for got, most in ((free, 10**9), (held, 3)):
        times = Counter(r.doc_id for r in got)
        weight = {r.mix_source: r.weight for r in got}
        share = np.array(list(weight.values()))
        for s, size in (("a", 4000), ("b", 200)):
            used = sum(r.tokens for r in got if r.mix_source == s)
            assert weight[s] * 4200 - 20 <= used <= weight[s] * 4200 + 1 and used <= most * size
        assert max(times[1000 + i] for i in range(20)) <= most
        if most > 3:
            assert abs(-(share * np.log(share)).sum() / np.log(2) - 0.95) < 1e-3 and max(times.values()) > 3


def test_mixing_edges(spark):
    df = messy(spark).drop("_s", "_p")
    got = mixing.mix(df, max_repeat=1.0, keep=["doc_id", "text", "n_chars", "tokens"]).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in df.collect()) and {r.tokens for r in got if r.doc_id == 7} == {30000}
    assert mixing.mix(df.where("false"), max_repeat=1.0).count() == 0
    assert mixing.mix(df.where("text IS NULL"), max_repeat=1.0).count() == 2


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        w = [f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 60))]
        for name in rng.sample(sorted(licenses.TEMPLATES), rng.randint(0, 2)):
            notice = licenses.TEMPLATES[name].split()
            if rng.random() < 0.4:
                notice[rng.randrange(len(notice))] = "changed"
            at = rng.randint(0, len(w))
            w = [*w[:at], *notice, *w[at:]]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(set)
    for r in licenses.license_scan(df).collect():
        got[r.doc_id].add(r.template)
        assert r.matched == " ".join(words(rows[r.doc_id][1])[r.start_word : r.end_word]) and 0.8 <= r.containment <= 1
    wanted = defaultdict(set)
    spread = defaultdict(set)
    for name, template in licenses.TEMPLATES.items():
        t = shingled(template)
        for i, doc in rows:
            w = words(doc)
            own = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
            if any(len(t & set(own[k : k + len(t)])) >= 0.8 * len(t) for k in range(len(own))):  # every start, a template's length
                wanted[i].add(name)
            if len(t & set(own)) >= 0.8 * len(t):  # anywhere in the text
                spread[i].add(name)
    assert all(wanted[i] <= got[i] <= spread[i] for i, _ in rows) and sum(map(len, wanted.values())) > 60
    # the same windows, by hand: templates that share a minimum are all retrieved
    twice = {"a": licenses.TEMPLATES["unlicense"], "b": licenses.TEMPLATES["unlicense"] + " Yes."}
    both = licenses.license_scan(spark.createDataFrame([(1, twice["b"])], "doc_id long, text string"), twice).collect()
    assert sorted(r.template for r in both) == ["a", "b"]


def test_license_scan_edges(spark):
    df = messy(spark).withColumn("text", F.when(F.col("doc_id") == 4, F.lit("x " * 9 + licenses.TEMPLATES["unlicense"] + licenses.TEMPLATES["unlicense"])).otherwise(F.col("text")))
    assert [(r.doc_id, r.template, r.start_word) for r in licenses.license_scan(df).orderBy("start_word").collect()] == [(4, "unlicense", 9), (4, "unlicense", 20)]
    assert licenses.license_scan(df, {}).count() == 0 and licenses.license_scan(df.where("false")).count() == 0


def test_short_notices_match_inside_longer_texts(spark):
    def found(text, *own):
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        return sorted((r.template, r.start_word, r.end_word, r.matched) for r in licenses.license_scan(df, *own).collect())

    assert found("First words. All rights reserved. More words stand here.") == [("all-rights-reserved", 2, 5, "all rights reserved")]
    assert found("ALL RIGHTS RESERVED") == [("all-rights-reserved", 0, 3, "all rights reserved")] and found("all rights") == []
    assert [r[0] for r in found("It is licensed under CC BY 4.0 here.")] == ["cc-by-4.0-name"]
    own = {"a": "x y", "b": "X, Y!", "c": "z z", "d": ""}
    assert found("x y x y z z z q", own) == [(k, *r) for k, r in [("a", (0, 2, "x y")), ("a", (2, 4, "x y")), ("b", (0, 2, "x y")), ("b", (2, 4, "x y")), ("c", (4, 6, "z z"))]]


def test_license_copies_in_a_row_give_a_row_each(spark):
    for name, n in [("mit-notice", 5), ("apache-2.0-notice", 8), ("bsd-clauses", 21), ("agpl-3.0-header", 43)]:
        copy = licenses.TEMPLATES[name]
        assert len(words(copy)) == n
        for times in (2, 5):
            df = spark.createDataFrame([(1, "a b c " + " ".join([copy] * times) + " d")], "doc_id long, text string")
            got = licenses.license_scan(df, {name: copy}).orderBy("start_word").collect()
            assert [(r.start_word, r.end_word) for r in got] == [(3 + n * i, 3 + n * i + n) for i in range(times)], name
    # one copy changed near its start, one near its end, and one with words put in
    copy = licenses.TEMPLATES["agpl-3.0-header"].split()
    first, second, third = ["a", *copy[1:]], [*copy[:-1], "z"], [*copy[:20], *(f"q{i}" for i in range(9)), *copy[20:]]
    df = spark.createDataFrame([(1, " ".join([*first, *second])), (2, " ".join(third))], "doc_id long, text string")
    got = licenses.license_scan(df, {"t": " ".join(copy)}).orderBy("doc_id", "start_word").collect()
    assert [(r.doc_id, r.start_word, r.end_word) for r in got] == [(1, 1, 43), (1, 43, 85), (2, 0, 52)]


def test_language_edges(spark):
    df = messy(spark)
    model = langid.fit(df.where("lang IS NOT NULL"), "doc_id", "text", "lang")
    got = langid.predict(df, model).collect()
    assert len(got) == 15 and set(got[0].asDict()) == {*df.columns, "ambiguous"}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {0, 1, 2, 3, None} and all(r.lang_pred == "en" and r.score == 1 for r in got if r.doc_id == 7)
    none = langid.fit(df.where("false"), "doc_id", "text", "lang")
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"} and langid.predict(df.where("false"), model).count() == 0


def test_held_out_accuracy(spark):
    made = langid.op10(spark, "/root/testdata/sf0.01").alias("p").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    own = [r for r in made if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in made)
    assert len(own) > 200 and sum(r.lang == r.lang_pred for r in own) >= 0.98 * len(own)


def test_long_texts_and_many_languages(spark, monkeypatch):
    rng = random.Random(3)
    sounds = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(12)] for k in range(12)}
    said = lambda lang, n: " ".join(rng.choice(sounds[lang]) for _ in range(n))
    rows = [(i * 12 + k, said(lang, 40), lang) for k, lang in enumerate(sounds) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.fit(df, "doc_id", "text", "lang")
    texts = pa.array([said("l03", 9000), said("l07", 5), said("l11", 700)], pa.large_string())
    whole = langid._decoded(texts, model)
    assert [model.languages[k] for k in whole[0]] == ["l03", "l07", "l11"]
    monkeypatch.setattr(langid, "PIECE", 1000)
    monkeypatch.setattr(langid, "WEIGHED", 777)
    monkeypatch.setattr(langid, "SLICE_BYTES", 5000)
    cut = langid._decoded(texts, model)
    assert (cut[0] == whole[0]).all() and np.allclose(cut[1], whole[1], atol=1e-4)
    # 300 languages of a text each are all learned
    many = spark.createDataFrame([(i, f"{chr(97 + i % 26)}{i} " * 9, f"x{i:03d}") for i in range(300)], "doc_id long, text string, lang string")
    assert langid.fit(many, "doc_id", "text", "lang").languages == [f"x{i:03d}" for i in range(300)]
    # decoding by hand: the language whose codeword loses least
    sums = {n: sum(model.weights[g].sum(axis=0, dtype=np.float64) for g, _ in langid._grams(texts.slice(n, 1))) for n in range(3)}
    for n, total in sums.items():
        margin = np.clip(total / np.sqrt(sum(len(g) for g, _ in langid._grams(texts.slice(n, 1)))), -40, 40)
        loss = [sum(t * np.log1p(np.exp(-m * c)) for m, c, t in zip(margin, code, model.trust, strict=True)) for code in model.code]
        assert int(np.argmin(loss)) == whole[0][n]


def test_codewords_are_apart():
    for n in (2, 4, 5, 6, 30):
        code = langid.codewords(n)
        gap = (code.shape[1] - code @ code.T) / 2
        assert code.shape[0] == n and (gap + np.eye(n) * 99).min() >= 1


def test_token_rollup(spark, tmp_path):
    rollup = token_counts.TokenRollup(spark, str(tmp_path / "r"))
    assert rollup.totals().count() == 0
    fields = "op string, doc_id long, source string, lang string, tokenizer string, tokens long, old_source string, old_lang string, old_tokenizer string, old_tokens long, extra int"
    load = [("insert", i, "a" if i % 2 else None, "en", "t1", i, None, None, None, None, 0) for i in range(6)] + [("insert", 9, "b", "en", "t1", None, None, None, None, None, 0)]
    change = [("delete", 1, "a", "en", "t1", 1, None, None, None, None, 0), ("revise", 3, "a", "de", "t2", 30, "a", "en", "t1", 3, 0), ("delete", 9, "b", "en", "t1", None, None, None, None, None, 0)]
    one, two = spark.createDataFrame(load, fields), spark.createDataFrame(change, fields)
    assert rollup.commit("b/1 x", one) and not rollup.commit("b/1 x", one)
    assert rollup.commit("b2", two) and not rollup.commit("b2", one)
    again = token_counts.TokenRollup(spark, str(tmp_path / "r"))
    assert {tuple(r) for r in again.totals().collect()} == {(None, "en", "t1", 3, 6), ("a", "en", "t1", 1, 5), ("a", "de", "t2", 1, 30)}
    with pytest.raises(Exception, match="op must be"):
        rollup.commit("b3", one.withColumn("op", F.lit(None).cast("string")))
    assert rollup.commit("b3", one.where("false")) and len(rollup.batches()) == 3 and again.totals().count() == 3
    before = {tuple(r) for r in again.totals().collect()}
    assert again.compact() and not again.compact() and not rollup.commit("b2", one)
    assert {tuple(r) for r in rollup.totals().collect()} == before
    assert rollup.commit("b4", two) and rollup.compact() and len(rollup._state()[1]) == 0
    assert {tuple(r) for r in again.totals().collect()} == {(None, "en", "t1", 3, 6), ("a", "en", "t1", -1, 1), ("a", "de", "t2", 2, 60), ("b", "en", "t1", -1, 0)}


def test_commits_compact_by_themselves_and_one_of_two_drivers_wins(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_counts, "COMPACT", 2)
    a, b = (token_counts.TokenRollup(spark, str(tmp_path / "r")) for _ in range(2))
    rows = spark.createDataFrame([("insert", "s", "en", "t", 5)], "op string, source string, lang string, tokenizer string, tokens long")
    for i in range(5):
        assert a.commit(f"b{i}", rows)
    assert [tuple(r) for r in b.totals().collect()] == [("s", "en", "t", 5, 25)] and a._state()[0].endswith("000002")
    # the other driver moves its batch into place while this one has written its own aside
    move = a._move
    monkeypatch.setattr(a, "_move", lambda aside, target: b.commit("race", rows) and move(aside, target))
    assert not a.commit("race", rows)
    assert [tuple(r) for r in b.totals().collect()] == [("s", "en", "t", 6, 30)]


def test_token_counts_equal_brute_force(spark):
    import public_tokenizers as public

    from spanloom.llm.tokens import byte_tokenizer

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    enc = byte_tokenizer(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    toxic = {r.doc_id for r in spark.read.parquet(f"{path}/labels.parquet").where("toxic = 1").collect()}
    kept = [d for d in docs if d.doc_id not in toxic]
    wanted = Counter()
    for d in kept:
        for version, n in (("words-2", len(words(d.text))), ("byte_bpe_50k-1", len(enc.encode_ordinary(d.text)))):
            wanted[d.source, d.lang, version] += n
    got = token_counts.op7(spark, path).collect()
    assert {(r.source, r.lang, r.tokenizer): r.n_tokens for r in got} == dict(wanted) and sum(r.n_docs for r in got) == 2 * len(kept) < 2 * len(docs)
    counted = token_counts.byte_bpe_counts(messy(spark), public.path("byte_bpe_50k.tiktoken"), public.PATTERN).collect()
    assert len(counted) == 15 and sum(r.tokens == 0 for r in counted) == 3
