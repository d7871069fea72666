"""Exact quantiles against sorting."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import profile as P

PROBABILITIES = [0.0, 0.1, 0.5, 0.75, 1.0]


def want(values, p):
    v = sorted(values)
    at = p * (len(v) - 1)
    low, part = math.floor(at), at - math.floor(at)
    return v[low] * (1 - part) + v[math.ceil(at)] * part


@pytest.mark.parametrize(("bins", "few"), [(1 << 16, 1 << 16), (4, 3)])
def test_columns_of_all_kinds(spark, monkeypatch, bins, few):
    """Even, skewed, huge, repeated and single values; small bins take many rounds."""
    monkeypatch.setattr(P, "BINS", bins)
    monkeypatch.setattr(P, "FEW", few)
    draw = random.Random(2)
    columns = {
        "even": [draw.random() for _ in range(301)], "skewed": [10.0 ** draw.uniform(-12, 12) for _ in range(200)], "huge": [1.7e308, -1.7e308, 1e300, 0.0, 5.0, -3.0], "same": [2.5] * 50,
        "two": [1.0] * 70 + [9.0] * 30, "one": [4.0], "ties": [float(draw.randint(0, 5)) for _ in range(100)],
    }
    rows = [(c, v) for c, vs in columns.items() for v in vs] + [("even", None), ("even", float("nan")), ("none", None)]
    draw.shuffle(rows)
    got = {(r.column, r.probability): r.value for r in P.quantiles(spark.createDataFrame(rows, "column string, value double"), PROBABILITIES).collect()}
    assert set(got) == {(c, p) for c in columns for p in PROBABILITIES}
    for (c, p), v in got.items():
        assert math.isclose(v, want(columns[c], p), rel_tol=1e-12, abs_tol=1e-300), (c, p)


def test_no_values(spark):
    assert P.quantiles(spark.createDataFrame([], "column string, value double"), [0.5]).collect() == []


def test_medians_of_many_rows(spark):
    df = spark.range(200_001).select(F.lit("x").alias("column"), F.pow((F.col("id") * 7919 % 200_001) / 1000.0, 3).alias("value"))
    assert P.medians(df).first().median == pytest.approx((100_000 / 1000.0) ** 3, rel=1e-12)
