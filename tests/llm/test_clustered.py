"""Recall of nearest neighbours on clustered vectors, where pure nearest links fall into closed parts."""

import numpy as np

from framelode.llm import ann


def test_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    n = 4800
    v = (centres[np.arange(n) % 60] + 0.2 * rng.normal(size=(n, 16))).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(n)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = v.astype(np.float64) @ v.astype(np.float64).T
    np.fill_diagonal(s, -np.inf)
    recall = np.mean([len(got[q] & set(np.argsort(-s[q])[:20].tolist())) / 20 for q in range(0, n, 20)])
    print("recall", recall)
    assert recall > 0.95


def test_codes_and_members():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 7)) * rng.uniform(0.1, 9, (40, 1))
    most = np.linalg.norm(v, axis=1).max()
    w, extra = ann.decode(ann.encode(v, most))
    assert np.abs(w - v).max() <= np.abs(v).max() / 127 and np.allclose((v * v).sum(axis=1) + extra**2, most**2)


def test_few_nodes_are_scored(spark, monkeypatch):
    rng = np.random.default_rng(9)
    n = 6000
    v = rng.normal(size=(n, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(n)], "vec_id long, embedding array<float>")
    seen, search = [], ann.search

    def spy(*args):
        out = search(*args)
        seen.extend(len(r.seen) for r in out.select("seen").collect())
        return out

    monkeypatch.setattr(ann, "search", spy)
    got = {}
    for r in ann.nearest(df, every=50).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    s = v.astype(np.float64) @ v.astype(np.float64).T
    np.fill_diagonal(s, -np.inf)
    assert np.mean([len(got[q] & set(np.argsort(-s[q])[:20].tolist())) / 20 for q in range(0, n, 50)]) > 0.9
    assert len(seen) == n // 50 and np.mean(seen) < 0.25 * n
