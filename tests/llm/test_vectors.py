from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import vectors as V


def clusters(n=600, dim=16, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 6, dim))
    x = np.concatenate([base, *[base[: n // 12] + rng.normal(size=(n // 12, dim)) * s for s in (0.02, 0.05, 0.1, 0.12, 0.15)], np.repeat(base[:1], 120, axis=0) + rng.normal(size=(120, dim)) * 0.03]).astype(np.float32)
    return x, (np.arange(len(x)) % 3).astype(int)


def brute(x, label, least=V.THRESHOLD):
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    near = (u @ u.T >= least) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    comp = np.arange(len(x))
    while True:
        low = np.array([min([comp[i], *comp[near[i]]]) for i in range(len(x))])
        if (low == comp).all():
            return near.sum(axis=1), comp
        comp = low


@pytest.mark.parametrize("kw", [{}, {"shard_rows": 60, "query_rows": 50}])
def test_against_brute_force(spark, kw):
    x, label = clusters()
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    rows = {r.vec_id: r for r in V.near_vectors(df, **kw).collect()}
    links, comp = brute(x, label)
    assert links.sum() > 100 and len(rows) == len(x)
    assert sum(r.n_links for r in rows.values()) >= 0.99 * links.sum()
    assert sum(rows[i].component_id == c for i, c in enumerate(comp.tolist())) >= 0.99 * len(x)
    assert all(rows[i].n_links <= n for i, n in enumerate(links.tolist()))
    assert all(0.99 <= r.recall <= 1 for r in rows.values())


def test_audit_widens():
    x, _ = clusters(1200)
    s = V.Shard(np.arange(len(x)), x, np.ones(len(x), np.int64))
    s.beam = 1
    found, edges = s.answer(np.arange(len(x)), x)
    links, comp = brute(x, np.zeros(len(x), int))
    beam, hits, real = s.audits[-1]
    assert found.sum() >= 0.99 * links.sum() and beam >= 1 and hits >= V.RECALL * real > 0
    assert len(edges) <= len(x) - len(set(comp.tolist()))


def test_a_dense_cluster_is_counted_in_full():
    """20,000 vectors that all link: 400 million links, 19,999 edges."""
    import time

    rng = np.random.default_rng(1)
    x = (np.ones(64) + rng.normal(size=(20000, 64)) * 0.02).astype(np.float32)
    start = time.time()
    s = V.Shard(np.arange(len(x)), x, np.ones(len(x), np.int64))
    n, edges = 0, []
    for at in range(0, len(x), 4096):
        w, e = s.answer(np.arange(at, min(at + 4096, len(x))), x[at : at + 4096])
        n += int(w.sum())
        edges += e
    assert n == 20000 * 19999 and len(edges) == 19999 and time.time() - start < 120


def test_doubles_stay_doubles_and_labels_may_be_words(spark):
    eps = 1e-9
    near, far = [1.0, np.sqrt(1 / (0.98 + eps) ** 2 - 1)], [1.0, np.sqrt(1 / (0.98 - eps) ** 2 - 1)]
    rows = [(1, [1e300, 1e300], "p"), (2, [1e300, 1.0000001e300], "p"), (3, [1e-200, 0.0], "q"), (4, [1e200, 1e198], "q"), (5, [1.0, 0.0], "r"), (6, near, "r"), (7, [1.0, 0.0], "s"), (8, far, "s")]
    df = spark.createDataFrame([(i, [float(c) for c in x], k) for i, x, k in rows], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in V.near_vectors(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8)}


def test_edges(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 1), (2, a, 1), (3, a, 2), (4, a, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 0.0], 1), (8, [float("nan"), 0.0, 1.0], 1), (9, [float("inf"), 0.0, 0.0], 1), (10, [], 1), (11, [1.0, 0.0], 1), (12, b, 1), (13, [2.0, 0.0, 0.0], 1), (14, a, 1)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<float>, label int, n long, rep long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.near_vectors(df).collect()}
    assert got == {1: (3, 1, True), 2: (3, 1, False), 13: (3, 1, False), 14: (3, 1, False), **{k: (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12)}}
    assert V.near_vectors(df.where(F.lit(False))).count() == 0
