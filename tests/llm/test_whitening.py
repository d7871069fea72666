from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from corvane.llm import whitening as W


def brute(rows, components=W.COMPONENTS):
    """vec_id -> (deviation, whitened up to sign), and n, explained; plain numpy and integers."""
    rows = [(i, e) for i, e in rows if e is not None and len(e) and all(c is not None and math.isfinite(c) for c in e)]
    x = np.array([[math.floor(64 * float(c)) + 1000000 for c in e] for _, e in rows], np.int64)
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    centred = np.array([[float(Fraction(int(v)) - Fraction(s, n)) for v, s in zip(r, sums, strict=True)] for r in x])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    white = centred @ vectors[:, :k] / np.sqrt(values[:k])
    dev = [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    return [i for i, _ in rows], n, dev, white, values[:k] / np.trace(cov)


def check(got, rows, components=W.COMPONENTS):
    ids, n, dev, white, explained = brute(rows, components)
    k = white.shape[1]
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(by) == len(ids) * k
    for c in range(k):
        mine = np.array([by[i, c + 1].whitened for i in ids])
        sign = np.sign(mine[np.abs(white[:, c]).argmax()] * white[np.abs(white[:, c]).argmax(), c])
        assert np.abs(mine * sign - white[:, c]).max() < 1e-8
        assert abs(by[ids[0], c + 1].explained / explained[c] - 1) < 1e-9
    for i, d in zip(ids, dev, strict=True):
        assert by[i, 1].deviation == d and by[i, 1].n == n
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8


def test_whole_table(spark, small):
    t = pq.read_table(f"{small}/embeddings.parquet")
    check(W.op11(spark, small).collect(), list(zip(t.column("vec_id").to_pylist(), t.column("embedding").to_pylist(), strict=True)))


def test_edges(spark):
    draw = np.random.default_rng(4)
    good = [(k, [float(v) for v in draw.normal(size=5)]) for k in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [1.0, float("inf"), 0.0, 0.0, 0.0]), (105, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in [*good, *odd]], f"{schema}, x string, n int, white double")
    check(W.whitened(df).collect(), good)
    check(W.whitened(df, components=2).collect(), good, 2)
    twice = W.whitened(spark.createDataFrame([*good, *good, (None, good[0][1])], schema)).collect()
    assert len(twice) == 81 * 5 and {r.n for r in twice} == {81}
    assert W.whitened(spark.createDataFrame([], schema)).collect() == []
    assert W.whitened(spark.createDataFrame(odd[:5], schema)).collect() == []
    assert W.whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []


def test_dependent_dimensions_have_no_component(spark):
    rows = [(k, [float(k), float(2 * k), 7.0, float(k * k % 13)]) for k in range(30)]
    got = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2}
    assert got[0].identity_error < 1e-8


def test_huge_entries(spark):
    rows = [(k, [1e300 if k == 0 else float(k), -1e30 if k == 1 else 0.5 * k, float(k % 3)]) for k in range(9)]
    got = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len({r.vec_id for r in got}) == 9 and all(math.isfinite(r.whitened) for r in got)


def test_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(W, "MOST_PAIRS", 4)
    rows = [(k, [float(k), float(k * k % 7), float(k % 5)]) for k in range(20)]
    check(W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows)


@pytest.mark.parametrize("n", [1, 10**9, 10**13])
def test_deviations_are_exact(n):
    w = W.Whitener(n, [n * 1000003 + n // 3, n * 999990], np.eye(2))
    x = np.array([[1000005, 1000000], [999999, 999990]])
    want = [sum((n * int(v) - s) ** 2 for v, s in zip(r, [n * 1000003 + n // 3, n * 999990], strict=True)) for r in x]
    assert w.project(x)[1] == [v if v < 1 << 63 else None for v in want]
