"""Every registered query of the core against its SQL, or against expectations written down here."""

from __future__ import annotations

import pytest
from oracle import assert_same

from corvane.operators import match as M
from corvane.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, medium, name):
    assert assert_same(QUERIES[name](spark, medium), SQL[name], medium) > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def ratio(a, b):
    """Ratcliff and Obershelp: twice the matched characters over all, by the longest common block and recursion to its sides."""
    def matched(x, y):
        best = (0, 0, 0)
        for i in range(len(x)):
            for j in range(len(y)):
                k = 0
                while i + k < len(x) and j + k < len(y) and x[i + k] == y[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        k, i, j = best[0], -best[1], -best[2]
        return k and k + matched(x[:i], y[:j]) + matched(x[i + k :], y[j + k :])

    return 2 * matched(a, b) / (len(a) + len(b))


def by_hand(scores):
    """{(listing, l): [(score, r)]} -> greedy pairs."""
    out, used = {}, set()
    for (k, left), options in sorted(scores.items()):
        free = [(-s, r) for s, r in options if (k, r) not in used]
        if free:
            s, r = min(free)
            used.add((k, r))
            out[k, left] = (r, round(-s, 6))
    return out


LEFT_FILES = "('a', 'report_01.docx'), ('a', 'report_02.docx'), ('a', 'notes final.txt'), ('a', 'budget 2024 v7.xlsx'), ('b', 'minutes of may.txt'), ('b', 'minutes of june.txt'), ('c', 'abcdef'), ('c', 'ghijkl'), ('d', 'report_01.docx')"
RIGHT_FILES = "('a', 'summary_01.pdf'), ('a', 'summary_3_02.pdf'), ('a', 'final notes.md'), ('a', '7_of_9.csv'), ('a', 'report_02_copy_5.docx'), ('b', 'june minutes.txt'), ('b', 'may minutes.txt'), ('c', 'ghijkx'), ('c', 'xabcdef'), ('d', 'other.docx')"


def listings():
    import ast

    return ast.literal_eval(f"[{LEFT_FILES}]"), ast.literal_eval(f"[{RIGHT_FILES}]")


def files(spark):
    from corvane.sources.tables import values

    return values(spark, "listing, name", LEFT_FILES), values(spark, "listing, name", RIGHT_FILES)


def test_similar_names_by_hand(spark):
    left, right = listings()
    scores = {(k, a): [(ratio(a, b), b) for m, b in right if m == k and ratio(a, b) > 0.5] for k, a in left}
    got = {(r.listing, r.l): (r.r, r.score) for r in M.match_similar(*files(spark)).collect()}
    assert got == by_hand(scores) and len(got) > 3


def test_auto_matching_by_hand(spark):
    """Numbers pair three of four in listing a; tokens are more in b; in c similarity alone pairs; in d the suffix is a shared token."""
    left, right = listings()
    likeness = by_hand({(k, a): [(ratio(a, b), b) for m, b in right if m == k and ratio(a, b) > 0.5] for k, a in left})
    rows = M.auto(*files(spark)).collect()
    assert {(r.listing, r.strategy) for r in rows} == {("a", "number" if sum(k == "a" for k, _ in likeness) <= 3 else "similarity"), ("b", "keyword"), ("c", "similarity"), ("d", "keyword")}
    assert {(r.listing, r.l): (r.r, r.score) for r in rows if r.listing == "c"} == {x: v for x, v in likeness.items() if x[0] == "c"}
    assert len({(r.listing, r.l) for r in rows}) == len({(r.listing, r.r) for r in rows}) == len(rows)


def test_bounds_lose_no_similar_pair(spark):
    import random

    draw = random.Random(7)
    names = ["".join(draw.choice("aab bc.1") for _ in range(draw.randint(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(n,) for n in sorted(set(names))], "name string")
    got = {(r.l, r.r): r.score for r in M.similarity_scores(df, df).collect()}
    from difflib import SequenceMatcher

    want = {(a, b): round(SequenceMatcher(None, a, b).ratio(), 6) for a in set(names) for b in set(names)}
    assert got == {k: v for k, v in want.items() if v > 0.5}


def test_incremental_index_equals_rebuild(spark, small):
    from pyspark.sql import functions as F

    from corvane.operators import index as I
    from corvane.sources.tables import load

    docs = load(spark, small, "documents")
    rebuilt = I.keyword_index(I.keywords(docs.where("doc_id % 10 <> 2")))
    merged = I.keyword_index(I.merge_postings(I.keywords(docs.where("doc_id % 10 <> 1")), I.keywords(docs.where("doc_id % 10 in (1, 3)")), docs.where("doc_id % 10 = 2").select("doc_id")))
    assert merged.exceptAll(rebuilt).count() == rebuilt.exceptAll(merged).count() == 0
    assert rebuilt.agg(F.count("*")).first()[0] > 0
