"""Vectors, archives, components, the pipeline and the registered queries."""

import base64
import hashlib
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from spanloom.llm import ann, common, embed_dedup, queries, warc

SF = "/root/testdata/sf0.001"


def vectors(spark, seed=0, n=300, dims=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, dims))
    rows = base[rng.integers(0, 12, n)] + rng.normal(size=(n, dims)) * rng.choice([0.05, 0.4, 1.5], (n, 1))
    rows[n // 2 :: 7] = rows[3]
    rows = (rows * rng.choice([0.5, 1, 30], (n, 1))).astype(np.float32)
    return rows, spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<float>").repartition(6)


ODD = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [float("inf")] + [1.0] * 7), (1080, [None] + [1.0] * 7), (1100, [1.0] * 3), (1120, []), (None, [1.0] * 8)]


@pytest.mark.parametrize("group, block", [(8192, 1024), (64, 17)])
def test_nearest_equals_brute_force(spark, group, block, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATE_GROUP", group)
    monkeypatch.setattr(ann, "QUERY_GROUP", group)
    monkeypatch.setattr(ann, "BLOCK", block)
    rows, df = vectors(spark)
    df = df.unionByName(spark.createDataFrame(ODD, "vec_id long, embedding array<float>")).unionByName(df.where("vec_id = 40"))
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 300, 20))
    exact = rows.astype(np.float64)
    for q, found in got.items():
        score = np.zeros(300)
        for d in range(8):
            score += exact[:, d] * exact[q, d]
        order = [int(i) for i in np.lexsort((np.arange(300), -score)) if i != q][:20]
        assert found == [(k + 1, i, score[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("dims", [1536, 4096])
def test_long_vectors_stay_within_their_bounds(spark, dims, monkeypatch):
    """int8 products of long vectors are summed exactly, and ties survive in slices."""
    monkeypatch.setattr(ann, "PAIRS", 100)
    monkeypatch.setattr(ann, "ROWS", 7)
    rng = np.random.default_rng(dims)
    whole = rng.integers(-127, 128, (60, dims)).astype(np.float64)
    whole[:, 0] = 127
    a = ann.Quantised(whole)
    low, high = a.tile(slice(0, 60), a)
    assert (low <= whole @ whole.T).all() and (whole @ whole.T <= high).all()
    whole[20:] = whole[20:21]  # most pairs tie
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(whole)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.nearest(df, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    score = whole @ whole.T
    assert got == {q: [(int(i), score[q, i]) for i in np.lexsort((np.arange(60), -score[q])) if i != q][:5] for q in (0, 20, 40)}


@pytest.mark.parametrize("size", [1e200, 1e150, 1e-150, 1e-200])
def test_extreme_magnitudes(spark, size):
    """Products that a double can't hold, or can't tell from zero, tie; others are told apart."""
    rng = np.random.default_rng(3)
    whole = rng.random((80, 6)) * size * 10.0 ** rng.integers(-3, 4, (80, 1))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(whole)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in ann.nearest(df, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    with np.errstate(over="ignore"):
        for q in (0, 20, 40, 60):
            score = np.zeros(80)
            for d in range(6):
                score += whole[:, d] * whole[q, d]
            assert got[q] == [(int(i), score[i]) for i in np.lexsort((np.arange(80), -score)) if i != q][:5]
    links = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df).collect()}
    unit = embed_dedup.unit(whole)
    assert links == {i: int((unit @ unit[i] >= 0.95).sum()) - 1 for i in range(80)}


def test_cells_grow_with_the_root():
    assert embed_dedup.cells_for(2) == embed_dedup.cells_for(500) == 2
    assert embed_dedup.cells_for(51282) == 12 and embed_dedup.cells_for(1 << 20) == 256 and embed_dedup.cells_for(1 << 30) == 8192


def test_shared_folder_is_needed_on_a_cluster(spark):
    class Away:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

    with pytest.raises(RuntimeError):
        common.shared_folder(Away)


def test_nearest_edges(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], "c"), (1, [1.0, 0.0], "c"), (2, [0.0, 1.0], "c")], "vec_id long, embedding array<double>, cell string")
    assert [(r.rank, r.vec_id, r.score) for r in ann.nearest(few).orderBy("rank").collect()] == [(1, 1, 1.0), (2, 2, 0.0)]
    assert ann.nearest(few.where("false")).count() == 0 and ann.nearest(few.where("vec_id > 0")).count() == 0


@pytest.mark.parametrize("cells, block", [(1, 1024), (9, 7)])
def test_embedding_links_equal_brute_force(spark, cells, block, monkeypatch):
    monkeypatch.setattr(embed_dedup, "PER_CELL", 300 // cells)
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "ROWS", 10 * block // 7)
    rows, df = vectors(spark, 5)
    df = df.unionByName(spark.createDataFrame(ODD, "vec_id long, embedding array<float>"))
    x = rows.astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    root = np.arange(300)
    for _ in range(300):
        root = np.minimum(root, np.where(near, root[None, :], 999).min(axis=1))
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    assert set(got) == {*range(300), None, *(i for i, _ in ODD)}
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(300)] == [(int(n), int(r), int(r) == i) for i, (n, r) in enumerate(zip(near.sum(1), root, strict=True))]
    assert all(got[i].n_links == 0 and got[i].kept for i, _ in ODD) and near.sum() > 100
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("block, rows", [(6144, 512), (7, 3), (16, 1)])
def test_embedding_chains_are_one_component(spark, block, rows, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "ROWS", rows)
    monkeypatch.setattr(embed_dedup, "PER_CELL", 15)
    ids = list(range(60))
    for seed in range(3):
        random.Random(seed).shuffle(ids)
        angle = [(0 if k < 30 else 50) + 4.7 * k + (3 * seed) for k in range(60)]  # two arcs with a gap
        df = spark.createDataFrame([(i, [float(np.cos(np.radians(a))), float(np.sin(np.radians(a)))]) for i, a in zip(ids, angle)], "vec_id long, embedding array<double>").repartition(4)
        want = {i: min(ids[:30]) if k < 30 else min(ids[30:]) for k, i in enumerate(ids)}
        assert {r.vec_id: r.component_id for r in embed_dedup.near_duplicates(df).collect()} == want


@pytest.mark.parametrize("per_cell", [4096, 20])
def test_vectors_of_every_length_take_part(spark, per_cell, monkeypatch):
    monkeypatch.setattr(embed_dedup, "PER_CELL", per_cell)
    monkeypatch.setattr(ann, "CANDIDATE_GROUP", per_cell)
    sizes = {8: 90, 4: 60, 2: 5}
    parts = [vectors(spark, dims, n, dims)[0] for dims, n in sizes.items()]
    rows = [r.astype(np.float64) for part in parts for r in part]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<float>").repartition(5)
    same = [{j for j, y in enumerate(rows) if j != i and len(y) == len(x)} for i, x in enumerate(rows)]
    got = {}
    for r in ann.nearest(df, every=10, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    score = lambda i, j: sum(float(a) * float(b) for a, b in zip(rows[i], rows[j], strict=True))
    assert got == {i: sorted(same[i], key=lambda j: (-score(i, j), j))[:5] for i in range(0, 155, 10)}
    near = [{j for j in same[i] if score(i, j) / (np.linalg.norm(rows[i]) * np.linalg.norm(rows[j])) >= 0.95} for i in range(len(rows))]
    links = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df).collect()}
    assert links == {i: len(x) for i, x in enumerate(near)} and sum(map(len, near[90:150])) > 10


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(rng.randrange(700, 760), rng.randrange(700, 760)) for _ in range(40)] + [(5, 5), (None, 3)]
    root = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == root and len(got) == len(root)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("split", ["128m", "1000", "61"])
def test_archives_round_trip(spark, tmp_path, split):
    magic = "WARC/1.1\r\n"
    inner = f"{magic}WARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n{magic}WARC-Type: x\r\nContent-Length: 99999\r\n\r\n"
    rows = [(1, "u", "a" + inner), (2, None, None), (3, "v\r\nX: y", ""), (4, "w", "é" + magic * 3), (5, "w", "é" + magic * 3), (None, "w", "é" + magic * 3), (6, "", magic + "\r\n\r\n"), (7, "z", "plain\r\n\r\n\r\n"), (8, "z", "x" * 50000 + magic)]
    rows += [(100 + i, "p", f"page {i % 40}" + inner * (i % 3)) for i in range(200)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, file string, offset int").repartition(3)
    warc.write_warc(df, str(tmp_path / "w"), "page_id", "url", "html")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = warc.read_warc(spark, str(tmp_path / "w"), payloads=True).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    wanted = sorted((str(i), "response" if i is None or first[h or ""] == i else "revisit", len((h or "").encode()), digest(h), None if i is None or first[h or ""] == i else f"<urn:record:{first[h or '']}>") for i, _, h in rows)
    assert sorted((r.record_id[12:-1] or "None", r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in got) == wanted
    bodies = {str(i): (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.payload) == (bodies[r.record_id[12:-1] or "None"] if r.record_type == "response" else b"") for r in got)


def test_small_payloads_are_never_revisits(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    warc.write_warc(df, str(tmp_path / "w"), "page_id", "url", "html", min_revisit_bytes=3)
    assert sorted((r.record_id, r.record_type) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()) == [("<urn:record:1>", "response"), ("<urn:record:2>", "response"), ("<urn:record:3>", "response"), ("<urn:record:4>", "revisit")]
    warc.write_warc(df.where("false"), str(tmp_path / "e"), "page_id", "url", "html")
    assert warc.read_warc(spark, str(tmp_path / "e")).count() == 0


def test_op4_columns(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in warc.op4(spark, SF).collect()}
    assert {(p.page_id, len(p.html.encode()), digest(p.html)) for p in pages} == {(r.page_id, r.payload_bytes, r.payload_digest) for r in got.values()}


def test_op5_shards(spark):
    got = queries.QUERIES["op5_sharding"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    import zlib

    assert dict(zip(got.doc_id, got.text_crc32)) == {d: zlib.crc32(t.encode()) for d, t in zip(docs.doc_id, docs.text)}
    per = got.groupby("shard")["size"].sum()
    assert len(per) == 24 and (per - per.mean()).abs().max() <= got["size"].max()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    made, wanted = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    columns = sorted(made.columns)
    assert columns == sorted(wanted.columns)
    plain = lambda f: sorted(f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None), key=str)
    assert plain(made) == plain(wanted)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (90001, "", "en", None, 0), (90002, "12 34 !!", "en", "s", 8), (90003, "x y z", None, None, None)], docs.schema)
    full = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = common.written(stage(spark, full, SF), name)
        assert made.columns == corpus_pipeline.COLUMNS
        ids = {r.doc_id for r in made.select("doc_id").collect()}
        before = {r.doc_id: r.text for r in full.collect()}
        assert ids <= set(before) and {r.doc_id: r.text for r in made.collect()}.items() <= before.items()
        if name == "language_id":
            assert not ids & {None, 90001, 90002} and 90003 in ids and len(ids) == docs.count() + 1
        if name == "near_duplicates":
            assert 150 < len(ids) < len(before)
        full = made
    packed = corpus_pipeline.STAGES[-1][1](spark, full, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in full.collect()}
    assert sorted(map(tuple, packed)) == sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, full, SF).collect()))
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_pipeline_judges_each_row_by_its_own_text(spark):
    text = lambda seed: " ".join(f"w{random.Random(seed).random()}"[:9] + str(k) for k in range(30))
    rows = [(1, text(1)), (2, text(1)), (2, text(2)), (3, text(3)), (3, text(3)), (None, text(1)), (None, text(4)), (5, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    made = corpus_pipeline.near_duplicates(spark, docs, SF).select("doc_id", "text").collect()
    assert sorted(map(tuple, made), key=str) == sorted([(1, text(1)), (2, text(2)), (3, text(3)), (None, text(4)), (5, None), (5, "")], key=str)


def test_nothing_else_imports_this_package():
    root = Path(corpus_pipeline.__file__).parent
    for path in (root / "spanloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "spanloom.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
