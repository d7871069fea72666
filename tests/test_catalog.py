"""Counts of relations without their rows."""

from __future__ import annotations

from corvane.operators import index as I


def test_relations_of_copies_are_counted_by_classes(spark):
    rows = [(k, t, d) for k, t, d in [("x", "a", 1), ("x", "a", 2), ("x", "b", 2), ("x", "c", 3), ("y", "a", 1), ("y", "a", 3), (None, "a", 5), (None, "a", 6), ("x", None, 7), ("x", "c", None), ("x", "a", 1)]]
    rows += [("x", t, d) for d in range(100, 130) for t in ("b", "c")]
    p = spark.createDataFrame(rows, "kind string, term string, doc_id long")
    assert I.relation_count(p).first()[0] == I.relations(p).count() > 435
    assert I.relation_count(p.where("false")).first()[0] == 0
    assert I.relation_count(p.where("doc_id >= 100")).first()[0] == 435


def test_relations_are_counted_without_pairs(spark, monkeypatch):
    def pairs(*_, **__):
        raise AssertionError("pairs of classes were made")

    monkeypatch.setattr(I, "relations", pairs)
    n = 20_000  # classes of several blocks that all share a term, and a term that half of them have besides
    p = spark.range(n).selectExpr("'x' AS kind", "explode(array('all', concat('own', cast(id div 2 as string)), if(id % 2 = 0, 'even', null))) AS term", "id AS doc_id")
    assert I.relation_count(p).first()[0] == n * (n - 1) // 2
    assert I.relation_count(p.where("term <> 'all'")).first()[0] == (n // 2) * (n // 2 - 1) // 2 + n // 2


def test_blocks_count_as_pairs_do(spark, monkeypatch):
    for name, value in (("BITS", 64), ("BITS_TERMS", 40), ("JOINED", 64)):
        monkeypatch.setattr(I, name, value)
    p = spark.range(600).selectExpr("if(id % 5 = 0, 'y', 'x') AS kind", "explode(transform(sequence(1, cast(id % 7 as int)), i -> concat('t', cast(pmod(hash(id div 2, i), 900) as string)))) AS term", "id AS doc_id")
    assert I.relation_count(p, block=50).first()[0] == I.relation_count(p).first()[0] == I.relations(p).count() > 100


def test_keywords_are_counted_over_all_rows_of_an_id(spark):
    rows = [(1, "Alpha alpha, ALPHA alpha alpha beta beta"), (2, "beta beta beta"), (2, "beta beta gamma"), (2, None), (3, "beta " * 4), (None, "zeta " * 3), (None, "zeta " * 2), (4, None), (5, "abc " * 9 + "delta " * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {tuple(r) for r in I.keywords(docs).select("keyword", "doc_id", "frequency").collect()}
    assert found == {("alpha", 1, 5), ("beta", 2, 5), ("zeta", None, 5), ("delta", 5, 6)}
    assert {tuple(r) for r in I.keywords(docs.where("doc_id = 2"), min_length=1, min_count=1).collect()} == {("beta", 2, 5), ("gamma", 2, 1)}
    assert {tuple(r) for r in I.keywords(docs.where("doc_id = 1"), min_length=1, min_count=1).collect()} == {("alpha", 1, 5), ("beta", 1, 2)}
