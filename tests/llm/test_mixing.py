from __future__ import annotations

import contextlib
import io
from collections import Counter

import edges
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from corvane.llm import mixing as M


def test_against_sql(spark, medium):
    assert assert_same(M.op10(spark, medium), M.OP10_SQL, medium) > 0


def test_target_weights(spark):
    docs = spark.range(12000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "big").otherwise("small").alias("source"), F.lit("x" * 10).alias("text"))
    got = Counter(r.source for r in M.mixed(docs, weights={"big": 1.0, "small": 3.0}).select("source").collect())
    assert got["big"] == pytest.approx(3000, rel=0.06) and got["small"] == pytest.approx(9000, rel=0.06)
    assert set(Counter(r.source for r in M.mixed(docs, weights={"small": 1.0}).collect())) == {"small"}


def test_copies_follow_poisson(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("abc").alias("text"))
    n = Counter(Counter(r.doc_id for r in M.replicate(docs).select("doc_id").collect()).values())
    for k, share in ((1, 0.3679), (2, 0.1839), (3, 0.0613)):
        assert n[k] / 20000 == pytest.approx(share, abs=0.01)


def test_high_rates(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 20, "rare").otherwise("rest").alias("source"), F.lit("abc").alias("text"))
    n = M.mixed(docs, weights={"rare": 1.0, "rest": 1.0}).where("source = 'rare'").count()
    assert n == pytest.approx(500, abs=90)


def test_odd_weights_are_refused(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1, "rare").otherwise("rest").alias("source"), F.when(F.col("id") < 1, "a").otherwise(F.lit("abc" * 1000)).alias("text"))
    for w in ({"rare": -1.0}, {"rare": float("nan")}, {"rare": float("inf")}):
        with pytest.raises(ValueError, match="weight of rare"):
            M.mixed(docs, weights=w)
    docs = docs.union(docs.select("doc_id", F.lit("rest"), F.repeat(F.lit("abc"), F.lit(100000))))
    with pytest.raises(ValueError, match="source rare"):
        M.mixed(docs, weights={"rare": 1.0})


def test_order_is_mixed_and_repeatable(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("abc").alias("text"))
    a, b = [[r.doc_id for r in M.mixed(docs).collect()] for _ in range(2)]
    assert a == b and a != sorted(a)
    assert sum(x < 1500 for x in a[: len(a) // 4]) / (len(a) // 4) == pytest.approx(0.5, abs=0.1)


def test_no_python_in_the_plan(spark, small):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        M.op10(spark, small).explain(True)
    assert not any(x in out.getvalue() for x in ("Python", "Pandas", "Arrow"))


def test_edges(spark):
    docs = edges.documents(spark)
    out = M.mixed(docs)
    assert out.columns == docs.columns
    known = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(r.doc_id, r.text) for r in out.collect()} <= known
    n = Counter(r.doc_id for r in M.replicate(docs).where("doc_id = 2").collect())
    assert n[2] % 3 == 0  # its three rows draw alike
    assert M.mixed(edges.empty(spark)).count() == 0
