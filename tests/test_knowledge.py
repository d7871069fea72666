"""The knowledge base: what is shuffled and what goes through the driver."""

from __future__ import annotations

from corvane.operators import index as I
from corvane.operators.knowledge import content_hash


def _ran(df) -> tuple[list, str]:
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_texts_of_ids_with_one_row_are_not_shuffled(spark):
    rows = [(1, "a", "x"), (2, None, None), (None, "n", "n"), (3, "c", "z")]
    found, plan = _ran(content_hash(spark.createDataFrame(rows, "doc_id long, title string, text string")))
    assert {tuple(r)[:3] for r in found} == {(1, "a", "x"), (2, "", ""), (3, "c", "z")}
    assert "Exchange hashpartitioning" not in plan
    found, _ = _ran(content_hash(spark.createDataFrame([*rows, (1, "b", "w"), (1, "b", "v"), (3, "c", "z")], "doc_id long, title string, text string")))
    assert sorted(tuple(r)[:3] for r in found) == [(1, "b", "w"), (2, "", ""), (3, "c", "z")]


def test_many_ids_are_not_broadcast(spark):
    n = I.FEW + 1000
    old = spark.range(100).selectExpr("id AS source", "id + 1 AS target", "'x' AS type", "1L AS weight", "'t' AS details")
    postings = spark.createDataFrame([("x", "t", n + 1), ("x", "t", n + 2)], "kind string, term string, doc_id long")
    touched = spark.range(1, n).toDF("doc_id")
    merged = I.merge_relations(old.union(spark.createDataFrame([(n + 1, n + 2, "x", 1, "t")], old.schema)), postings, touched.where("false"), touched)
    assert "LeftAnti, BuildRight" not in merged._jdf.queryExecution().sparkPlan().toString()
    assert [tuple(r) for r in merged.collect()] == [(n + 1, n + 2, "x", 1, "t")]
