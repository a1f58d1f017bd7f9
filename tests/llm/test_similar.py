"""Problem 1 against brute force: recall, copies, split shards, edge cases."""

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import hnsw, similar


def frame(spark, ids, x):
    return spark.createDataFrame([(i, None if v is None else [float(a) for a in v]) for i, v in zip(ids, x)], "id string, embedding array<float>")


def brute(ids, x, k=5, least=0.9):
    x = np.asarray(x, np.float64)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = set()
    for i in range(len(ids)):
        near = sorted((j for j in range(len(ids)) if j != i and s[i, j] >= least - 1e-9), key=lambda j: (-round(s[i, j], 7), ids[j]))[:k]
        out |= {tuple(sorted((ids[i], ids[j]))) for j in near}
    return out


def clustered(n, rng, dim=64):
    base = rng.normal(size=(n // 4, dim))
    x = np.repeat(base, 4, axis=0) + rng.normal(size=(n // 4 * 4, dim)) * 0.22
    return x.astype(np.float32), [f"v{i:05}" for i in range(len(x))]


def test_recall_over_many_shards(spark):
    rng = np.random.default_rng(1)
    x, ids = clustered(2000, rng)
    want = brute(ids, x)
    got = {tuple(r) for r in similar.pairs(frame(spark, ids, x), shard_rows=100).collect()}
    assert len(want) > 1000 and not got - want
    assert len(got & want) / len(want) >= 0.97
    # shards over their largest size are cut into parts and lose nothing
    parted = {tuple(r) for r in similar.pairs(frame(spark, ids, x), shard_rows=2000, max_shard=300).collect()}
    assert len(parted & want) / len(want) >= 0.97 and not parted - want


def test_copies_give_bounded_pairs(spark):
    rng = np.random.default_rng(2)
    x, ids = clustered(80, rng)
    x = np.concatenate([x, np.repeat(x[:1], 300, axis=0), np.repeat(x[8:9], 2, axis=0)])
    ids = ids + [f"w{i:05}" for i in range(302)]
    got = {tuple(r) for r in similar.pairs(frame(spark, ids, x)).collect()}
    assert got == brute(ids, x)
    assert len(got) < 6 * len(ids)


def test_unusable_vectors(spark):
    one = np.zeros(64)
    one[0] = 1
    rows = [one, one * 3, None, [1.0] * 3, np.zeros(64), np.full(64, np.nan), np.full(64, np.inf), -one]
    df = frame(spark, [f"r{i}" for i in range(8)], rows)
    assert {tuple(r) for r in similar.pairs(df).collect()} == {("r0", "r1")}
    holed = df.limit(0).unionByName(spark.createDataFrame([("h", [None] + [1.0] * 63)], "id string, embedding array<float>"))
    assert similar.pairs(holed).count() == 0
    assert similar.pairs(df.limit(0)).count() == 0
    assert similar.pairs(df.limit(1)).count() == 0
    extra = df.withColumn("h1", F.lit(1)).withColumn("v", F.lit("x")).withColumn("a", F.lit(2))
    assert similar.pairs(extra).count() == 1


def test_graph_search_from_the_top():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x)
    assert len(g.levels) > 1 and all(a.dtype == np.int32 for _, a in g.levels)
    q = rng.normal(size=(200, 16)).astype(np.float32)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids, sims = g.search(q, 5, beam=48)
    want = np.argsort(-(q @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids, want)]) >= 0.9
    assert np.all(np.diff(sims, axis=1) <= 1e-6)
    assert hnsw.Graph(x[:1]).search(q[:2], 3)[0][0, 0] == 0


def test_oversized_shards_are_parted_by_pivots(spark):
    """One first pivot: all shards come from parting, and their size is bounded."""
    rng = np.random.default_rng(6)
    x, ids = clustered(2400, rng)
    want = brute(ids, x)
    got = {tuple(r) for r in similar.pairs(frame(spark, ids, x), shard_rows=10**6, max_shard=200).collect()}
    assert not got - want and len(got & want) / len(want) >= 0.97


def test_what_pivots_cannot_part_is_cut(spark, monkeypatch):
    """A shard that does not get smaller is compared part with part."""
    monkeypatch.setattr(similar, "LOCAL_PIVOTS", 1)
    rng = np.random.default_rng(7)
    x, ids = clustered(600, rng)
    want = brute(ids, x)
    got = {tuple(r) for r in similar.pairs(frame(spark, ids, x), max_shard=100).collect()}
    assert not got - want and len(got & want) / len(want) >= 0.97


def test_centres_of_pivots():
    rng = np.random.default_rng(8)
    p = rng.normal(size=(3000, 32)).astype(np.float32)
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    x = p[rng.integers(0, 3000, 800)] + 0.1 * rng.normal(size=(800, 32)).astype(np.float32)
    q = similar.Pivots(p)
    near = q.nearest(x, 2)
    exact = np.argsort(-(x @ p.T), axis=1)[:, :2]
    assert q.coarse is not None and (near[:, 0] == exact[:, 0]).mean() >= 0.95 and near.shape == (800, 2)
