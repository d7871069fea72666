"""Strongest partners against counting all pairs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from corvane.operators import index as I
from corvane.operators.related import strongest, term_sets

SCHEMA = "kind string, term string, doc_id long, weight int"


def brute(rows, links):
    docs = defaultdict(set)
    for kind, term, doc, _ in rows:
        if term is not None and doc is not None:
            docs[doc].add((kind or "", term))
    out = {}
    for a in docs:
        best = sorted((-len(docs[a] & docs[b]), b) for b in docs if b != a and docs[a] & docs[b])[:links]
        for k, (w, b) in enumerate(best):
            out[a, b] = (-w, k + 1)
    return out


def zipf(draw, n_docs, n_terms, most, copies=0):
    rows = []
    for d in range(n_docs):
        for _ in range(draw.randint(0, most)):
            rows.append((draw.choice(["a", "b", None]), f"t{int(n_terms ** draw.random())}", d - 40, 1))
    same = [(k, t) for k, t, d, _ in rows if d == 3]
    return rows + [(k, t, 10_000 + c, 1) for c in range(copies) for k, t in same]


@pytest.mark.parametrize(("block", "sparse", "held"), [(5, 1e9, 40), (1024, 1e9, 1 << 21), (7, 0, 1), (9, 8, 100)])
def test_relations_of_classes(spark, monkeypatch, block, sparse, held):
    """Classes and their pairs hold the relations of all documents, however classes meet; copies make no pairs but rows of one class."""
    monkeypatch.setattr(I, "HELD", held)
    rows = zipf(random.Random(9), 60, 12, 9, copies=30) + [("b", t, d, 1) for d in (900, 901) for t in ("é", "z", "\U0001f600", "\uffee")] + [("a", None, 1, 1), ("a", "t1", None, 1), ("c", "alone", 7, 1)]
    frame = spark.createDataFrame(rows + rows[:9], SCHEMA)
    got = I.class_relations(frame, details=3, block=block, sparse=sparse).collect()
    of = defaultdict(dict)
    for r in got:
        if r.same:
            of[r.type][r.target] = r.source
    assert len({(r.source, r.target, r.type) for r in got}) == len(got) and not any(x in of[r.type] for r in got for x in ((r.source,) if r.same else (r.source, r.target)))
    pair = {(r.type, r.source, r.target): (r.weight, r.details) for r in got if not r.same}
    within = {(r.type, r.source): (r.weight, r.details) for r in got if r.same}
    want = I.relations(frame, details=3).collect()
    for r in want:
        a, b = sorted(of[r.type].get(x, x) for x in (r.source, r.target))
        assert (within[r.type, a] if a == b else pair[r.type, a, b]) == (r.weight, r.details)
    own = {(r.type, r.source, r.target) for r in want}
    assert {(r.type, r.source, r.target) for r in got} <= own and len(got) < len(own) - 400


def test_wide_parts_relate_as_narrow_ones(spark, monkeypatch):
    """Parts of several blocks give the same rows, and classes are copied less often."""
    rows = zipf(random.Random(4), 150, 40, 6, copies=3)
    frame = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, I.class_relations(frame, block=8, sparse=1e9).collect()))
    monkeypatch.setattr(I, "MANY", 2)
    monkeypatch.setattr(I, "DEALT", 4)
    monkeypatch.setattr(I, "HELD", 200)
    assert sorted(map(tuple, I.class_relations(frame, block=8, sparse=1e9).collect())) == want != []


@pytest.mark.parametrize(("seed", "docs", "terms", "most", "copies", "links", "seeds"), [(1, 200, 50, 6, 0, 15, 16), (2, 150, 400, 20, 0, 3, 1), (3, 120, 8, 3, 60, 15, 2), (4, 250, 30, 2, 0, 5, 1), (5, 60, 10, 12, 25, 2, 1)])
def test_all_pairs(spark, seed, docs, terms, most, copies, links, seeds):
    rows = zipf(random.Random(seed), docs, terms, most, copies)
    rows += rows[:5] + [("a", None, 1, 1), ("a", "t1", None, 1), ("a", "alone", 7, 1)]
    got = strongest(spark.createDataFrame(rows, SCHEMA), links, seeds).collect()
    assert {(r.doc_id, r.related): (r.weight, r.rank) for r in got} == brute(rows, links)
    assert len(got) == len({(r.doc_id, r.related) for r in got})


def test_no_postings(spark):
    assert strongest(spark.createDataFrame([], SCHEMA)).collect() == []
    assert strongest(spark.createDataFrame([("a", "x", 1, 1), ("a", "y", 2, 1)], SCHEMA)).collect() == []


def test_a_common_term_shows_few_entries(spark):
    """3000 documents share one term, most of them nothing else: candidates grow with the documents, not with their square."""
    rows = [("a", "all", d, 1) for d in range(3000)] + [("a", f"own{d % 1500}", d, 1) for d in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    sets, members = term_sets(df, 16)
    assert sets.count() == 1500 and members.count() == 3000
    got = strongest(df)
    counts = Counter(r.weight for r in got.collect())
    assert counts == {2: 3000, 1: 3000 * 14}
    assert got.where("rank = 2").selectExpr("max(related)").first()[0] <= 2


def test_every_pair_of_a_small_corpus(spark):
    rows = [("a", f"{min(p)}-{max(p)}", d, 1) for p in combinations(range(12), 2) for d in p]
    got = {(r.doc_id, r.related): (r.weight, r.rank) for r in strongest(spark.createDataFrame(rows, SCHEMA), 4, 1).collect()}
    assert got == brute(rows, 4)


@pytest.mark.parametrize("block", [2000, 3])
def test_changed_relations_equal_a_rebuild(spark, block):
    """Documents come, change and go; relations of the rest are taken over."""
    from corvane.operators import index as I

    draw = random.Random(9)
    post = lambda docs: [(draw.choice("ab"), f"t{draw.randint(0, 14)}", d) for d in docs for _ in range(draw.randint(0, 6))]
    schema = "kind string, term string, doc_id long"
    before = post(range(40))
    gone, new = [*range(30, 40)], [*range(30, 35), *range(50, 58)]
    after = [r for r in before if r[2] < 30] + post(new)
    frame = lambda rows, s=schema: spark.createDataFrame(rows, s)
    ids = lambda rows: frame([(r,) for r in rows], "doc_id long")
    rows = lambda df: sorted(map(tuple, df.select("source", "target", "type", "weight", "details").collect()))
    want = rows(I.relations(frame(after)))
    assert rows(I.merge_relations(I.relations(frame(before)), frame(after), ids(new), ids(gone))) == want
    some = rows(I.relations_of(frame(after), ids(new), block=block))
    assert some == [r for r in want if r[0] in new or r[1] in new] and 0 < len(some) < len(want)
