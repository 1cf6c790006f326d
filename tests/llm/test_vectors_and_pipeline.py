from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import embed_dedup, graph, line_dedup, mixing, simhash, toxicity


def brute_links(ids, vectors, cosine):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for v, o in zip(vectors, ok, strict=True)]
    n, root = [0] * len(ids), {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if ok[a] and ok[b] and len(unit[a]) == len(unit[b]) and float(unit[a] @ unit[b]) >= cosine:
                n[a] += 1
                n[b] += 1
                x, y = sorted((find(ids[a]), find(ids[b])))
                root[y] = x
    return [(i, k, find(i), find(i) == i) for i, k in zip(ids, n, strict=True)]


@pytest.mark.parametrize("homes", [embed_dedup.HOMES, 7])
def test_embedding_dedup(spark, homes, monkeypatch):
    monkeypatch.setattr(embed_dedup, "HOMES", homes)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((15, 48))
    vectors = [(c + rng.standard_normal(48) * s).tolist() for c in centres for s in (0.1, 0.3, 0.4, 0.45, 0.5)]
    vectors += [vectors[0]] * 30 + [[0.0] * 48, None, [], [float("nan")] * 48, [1.0, None] * 24, [float("inf")] * 48, [1e-30] * 48, [1e30] * 48, [1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [5.0]]
    vectors = [v if v is None else [None if x is None else float(np.float32(x)) for x in v] for v in vectors]
    ids = rng.permutation(len(vectors)).tolist()
    df = spark.createDataFrame(list(zip(ids, vectors, [1] * len(ids), ["x"] * len(ids), strict=True)), "vec_id long, embedding array<float>, rep long, v string")
    got = sorted(tuple(r) for r in embed_dedup.embedding_report(df).collect())
    assert got == sorted(brute_links(ids, vectors, 0.9))
    assert embed_dedup.embedding_report(df.limit(0)).collect() == []


def test_embedding_grid_prunes(spark, monkeypatch):
    """Vectors whose spread lies in few axes: the grid that is taken for many of them lets few pairs meet, the one for few
    saves rows instead; the links are all found either way."""
    rng = np.random.default_rng(8)
    axes = np.linalg.qr(rng.standard_normal((32, 32)))[0][:, :6]
    v = rng.standard_normal((4000, 6)) @ axes.T + 0.01 * rng.standard_normal((4000, 32))
    u = embed_dedup.unit(v)
    df = spark.createDataFrame([(i, 1, x) for i, x in enumerate(v.tolist())], "rep long, copies long, v array<double>")
    compared = []
    for total in (4000, 10**7):
        grid = embed_dedup.Grid.fitted(u[:1000], total, 0.9)
        monkeypatch.setattr(embed_dedup, "fitted_grids", lambda named, cosine, grid=grid: {32: grid})
        found = embed_dedup.near_vectors(df)
        compared.append(found.where("u IS NULL").agg(F.sum("n")).first()[0] / (4000**2 / 2))
        assert found.where("u IS NOT NULL AND v IS NULL").agg(F.sum("n")).first()[0] == int((u @ u.T >= 0.9).sum()) - 4000
    assert compared[1] < 0.6 and compared[1] < 0.5 * compared[0]


def test_grids_hold_all_near_pairs():
    """Whatever the sample: near pairs are within the radius of some block, and their cells meet."""
    rng = np.random.default_rng(3)
    for dim in (2, 3, 5, 33, 64):
        u = embed_dedup.unit(rng.standard_normal((200, dim)))
        for grid in (embed_dedup.Grid.plain(dim, 0.9), embed_dedup.Grid.fitted(u[:100], 200, 0.9), embed_dedup.Grid.fitted(u[:100] * ([1.0] + [0.01] * (dim - 1)), 10**9, 0.9)):
            assert sum(p.stop - p.start for p in grid.parts) == dim and grid.parts[0].start == 0
            turn = grid.turn / embed_dedup._FIXED
            assert np.abs(turn @ turn.T - np.eye(dim)).max() < 1e-5
            v = embed_dedup.unit(u + rng.standard_normal(u.shape) * 0.45 / np.sqrt(dim))
            near = (u * v).sum(1) >= 0.9
            x, y = embed_dedup.rotated(u[near], grid.turn), embed_dedup.rotated(v[near], grid.turn)
            hit = [((x[:, p] - y[:, p]) ** 2).sum(1) <= r * r for p, r in zip(grid.parts, grid.radii, strict=True)]
            assert near.any() and np.any(hit, axis=0).all()


def test_small_table(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = v.select("vec_id", "embedding").collect()
    got = sorted(tuple(r) for r in embed_dedup.embedding_report(v).collect())
    assert got == sorted(brute_links([r.vec_id for r in rows], [r.embedding for r in rows], 0.9))


def test_components(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 150)]
    edges = spark.createDataFrame([*path, *star, (7, 7), (200, 201), (201, 200)], "u long, v long")
    roots = {r.node: r.root for r in graph.connected_components(edges).collect()}
    assert roots == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}, 200: 200, 201: 200}
    assert graph.connected_components(edges.limit(0)).collect() == []


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus, with copies and odd rows."""
    d = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 10_000))
    odd = spark.createDataFrame([(20_000, None, "en", None, 0), (20_001, "", "en", "web", 0)], docs.schema)
    docs.unionByName(odd).coalesce(3).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_pipeline(spark, folder, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    names, frames = [], [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        names.append(name)
        stage(spark, frames[-1], folder).write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
    assert names == ["toxicity", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    for f in frames[1:-1]:
        assert f.columns == docs.columns
    calm, lines, single, mixed, encoded = frames[1:]

    bad = {r.doc_id for r in toxicity.toxicity_report(docs, labels).where("predicted = 1").collect()}
    every = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in calm.collect()} == every - bad and 0 < len(bad) < 0.2 * len(every)

    dropped = {r.doc_id: r.n_dropped for r in line_dedup.line_report(calm).collect()}
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (calm, lines))
    assert all((before[d] or "").count("\n") + 1 - n == ((after[d] or "").count("\n") + 1 if after[d] or not n else 0) for d, n in dropped.items())
    assert all(before[d] == after[d] for d, n in dropped.items() if not n)

    groups = {r.doc_id: r.component_id for r in simhash.simhash_report(lines).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(groups.values())) and len(set(groups.values())) < len(groups)

    copies = {r.doc_id: r for r in mixing.mix_report(single).collect()}
    taken = Counter(r.doc_id for r in mixed.collect())
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in single.collect()}
    assert all(copies[d].taken == sizes[d] * taken[d] for d in copies)

    import hashlib

    assert Counter((r.doc_id, r.decoded_sha256) for r in encoded.collect()) == Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in mixed.collect())
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(map(tuple, encoded.collect()))
