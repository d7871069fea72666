"""The operation-list compiler, empty and odd inputs of table operators."""

from __future__ import annotations

import pytest

from corvane.operators import compare as C
from corvane.operators import profile as P
from corvane.plans.operations import compile_operations


def test_formulas(spark):
    df = spark.createDataFrame([(1, 2.0), (3, 0.0)], "a int, b double")
    got = compile_operations(df, [{"type": "compute", "column": "c", "formula": "-(a + 2) * 3 - a / b"}]).select("c").collect()
    assert [r.c for r in got] == [-9.5, None]


@pytest.mark.parametrize("op", [{"type": "exec"}, {"type": "compute", "column": "c", "formula": "a + __import__"}, {"type": "compute", "column": "c", "formula": "a +"}, {"type": "compute", "column": "c", "formula": "(a"}, {"type": "filter", "column": "a", "condition": "a or 1"}])
def test_what_is_not_allowed(spark, op):
    with pytest.raises(ValueError):
        compile_operations(spark.createDataFrame([(1,)], "a int"), [op])


def test_bins_of_a_constant_column(spark):
    assert [(r.bin, r.n) for r in P.equal_width_bins(spark.createDataFrame([(5,), (5,), (None,)], "x int"), "x").collect()] == [(1, 2)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, v string")
    assert C.compare(C.clean_pairs(empty, "k", "v"), C.clean_pairs(empty, "k", "v")).count() == 0
    assert P.numeric_stats(spark.createDataFrame([], "x double"), ["x"]).count() == 0
    assert P.column_profile(empty, ["k", "v"], "k").count() == 0


def test_failed_manifest_keeps_all(spark):
    m = spark.createDataFrame([("a", "failed"), ("b", "failed")], "id string, status string")
    assert C.successful(m).count() == 2


def test_median_of_one_value(spark):
    r = P.numeric_stats(spark.createDataFrame([(2.0,)], "x double"), ["x"]).first()
    assert (r["count"], r["median"], r["std"]) == (1, 2.0, None)


def test_relations_of_all_shared_terms(spark):
    """A term in every document, another kind with the same names, terms once and twice; whole and dealt over blocks."""
    from itertools import combinations

    from corvane.operators import index as I

    terms = {i: {"all", f"third{i % 3}", f"own{i}"} for i in range(30)}
    works = {i: {"all"} if i % 10 == 0 else set() for i in range(30)}
    rows = [("t", t, i) for i, ts in terms.items() for t in sorted(ts)] + [("w", t, i) for i, ts in works.items() for t in ts] + [("t", "all", 3), ("t", None, 4), ("t", "all", None)]
    want = {(i, j, k): ts[i] & ts[j] for k, ts in (("t", terms), ("w", works)) for i, j in combinations(terms, 2) if ts[i] & ts[j]}
    for block in (4, 2000):
        got = I.relations(spark.createDataFrame(rows, "kind string, term string, doc_id long"), block=block).collect()
        assert len(got) == len(want) and {(r.source, r.target, r.type): (r.weight, r.details) for r in got} == {k: (len(v), ",".join(sorted(v))) for k, v in want.items()}
    few = I.relations(spark.createDataFrame(rows, "kind string, term string, doc_id long"), max_df=10).collect()
    assert {r.details for r in few} == {"third0", "third1", "third2", "all"} and all(r.type == "w" for r in few if r.details == "all")


def test_reachability_of_a_long_chain(spark):
    from corvane.operators import workflow as W

    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(25)] + [("n25", "n0"), ("x", "y"), (None, "z"), ("n3", None)], "source string, target string")
    roots = spark.createDataFrame([("n0",), ("n0",), (None,)], "part string")
    assert {r.part for r in W.reachable(roots, edges).collect()} == {f"n{k}" for k in range(26)}
    with pytest.raises(RuntimeError, match="still growing"):
        W.reachable(roots, edges, most_rounds=5)


def test_exact_medians(spark):
    import random
    import statistics

    draw = random.Random(2)
    cols = {"few": [draw.randint(0, 3) for _ in range(5000)], "many": [draw.random() for _ in range(5001)], "even": [float(k) for k in range(4000)], "hot": [7.0] * 3000 + [draw.random() for _ in range(2000)], "two": [1.0, 4.0], "one": [3.0]}
    rows = [(k, float(v)) for k, vs in cols.items() for v in vs] + [("few", None), ("none", None)]
    got = {r.column: r.median for r in P.medians(spark.createDataFrame(rows, "column string, value double")).collect()}
    assert got == {k: statistics.median(v) for k, v in cols.items()}


def test_language_of_held_out_texts(spark, medium):
    """Profiles of one half of the documents tell the language of the other; texts without letters have none."""
    from corvane.operators import language as N

    docs = spark.read.parquet(f"{medium}/documents.parquet")
    known = N.profiles(docs.where("doc_id % 2 = 0"))
    got = N.detect(docs.where("doc_id % 2 = 1"), known).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars > 50").collect()
    assert len(got) > 400 and sum(r.language == r.lang for r in got) >= 0.99 * len(got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "漢字")], "doc_id long, text string")
    assert {r.doc_id: r.language for r in N.detect(odd, known).collect()} == {1: None, 2: None, 3: None, 4: None}


def test_knowledge_base_verbs(spark, tmp_path):
    from corvane.operators import index as I
    from corvane.operators.knowledge import KnowledgeBase, entity_relations

    text = "graph " * 5 + "Graph Theory and Graph Theory of 《Essays》"
    docs = [(1, "a", text, "success"), (2, "b", text + " " + "tree " * 6, "success"), (3, "c", "words " * 7, "failed"), (2, "A", "older", "success"), (None, "x", "y", "success")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, title string, text string, status string")
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb")
    assert kb.version() == 0 and kb.status().count() == 0
    with pytest.raises(ValueError, match="not completed"):
        kb.init(frame(docs), status="running")
    assert kb.update(frame(docs)) == 1  # no version yet: built
    assert {(r.doc_id, r.title, r.added) for r in kb.table("documents").collect()} == {(1, "a", 1), (2, "b", 1)}
    assert {(r.source, r.target, r.type, r.weight, r.details) for r in kb.table("relations").collect()} == {(1, 2, "shared_terms", 1, "Graph Theory"), (1, 2, "shared_works", 1, "Essays")}
    assert kb.update(frame(docs)) == 1 and kb.version() == 1  # nothing changed
    more = [(2, "b", "changed " * 6, "success"), (4, "d", text, None), (5, "e", text, "success")]
    assert {(r.doc_id, r.state) for r in kb.pending(frame(more)).collect()} == {(1, "removed"), (2, "changed"), (5, "new")}
    assert kb.update(frame(more)) == 2
    rebuilt = KnowledgeBase(spark, f"file://{tmp_path}/other")
    rebuilt.init(frame(more))
    for name, keys in (("keywords", ["keyword", "doc_id", "frequency"]), ("entities", ["doc_id", "type", "name", "count"]), ("relations", ["source", "target", "type", "weight", "details"])):
        a, b = kb.table(name).select(keys), rebuilt.table(name).select(keys)
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert {(r.doc_id, r.added, r.updated) for r in kb.table("documents").collect()} == {(2, 1, 2), (5, 2, 2)}
    assert kb.register(frame(more), "other") == 3  # loose: no status counts as success
    assert {(r.agent, r.doc_count, r.last_version) for r in kb.sources().collect()} == {("documents", 2, 2), ("other", 1, 3)}
    assert [tuple(r) for r in kb.table("log").orderBy("version").collect()] == [(1, "init", "documents", 2, 0, 0), (2, "update", "documents", 1, 1, 1), (3, "register", "other", 1, 0, 0)]
    assert [(r.source, r.target) for r in kb.query("relations", "5").collect()] == [(4, 5), (4, 5)]
    assert [r.keyword for r in kb.query("keywords", "GRA").collect()] == ["graph"] and [r.doc_id for r in kb.query("documents", "E").collect()] == [5]
    assert {(r.type, r.name, r["count"]) for r in kb.query("entities", "ess").collect()} == {("work", "Essays", 2)}
    with pytest.raises(ValueError, match="unknown kind"):
        kb.query("other", "x")
    assert entity_relations(kb.table("entities").where("false")).count() == 0
    empty = KnowledgeBase(spark, f"file://{tmp_path}/empty")
    assert empty.init(frame([])) == 1 and [tuple(r) for r in empty.status().collect()] == [(1, 0, 0, 0, 0)] and I.keyword_index(empty.table("keywords")).count() == 0


def test_fix_loop_stops_after_its_rounds(spark):
    from corvane.operators import rules as R

    rows = [(1, k, "left", 2.0, 0.0, 0.0) for k in range(9)] + [(2, 0, "both", 1.5, 0.0, 2.0), (3, 0, "left", 1.5, 0.0, 2.0)]
    p = spark.createDataFrame(rows, "doc_id long, pos int, alignment string, line double, first_line double, first_line_chars double")
    docs, rounds = R.inspect_and_fix(p, R.paragraph_issues, R.fix_paragraphs)
    assert [tuple(r) for r in rounds.orderBy("round").collect()] == [(1, 1, "indent", 9), (1, 2, "alignment", 9), (1, 3, "line", 9)]
    assert docs.columns == p.columns and {(r.doc_id, r.grade) for r in R.grade(R.paragraph_issues(docs)).collect()} == {(3, "A-")}
    docs, rounds = R.inspect_and_fix(p, R.paragraph_issues, R.fix_paragraphs, most_rounds=1)
    assert rounds.count() == 1 and {(r.doc_id, r.grade) for r in R.grade(R.paragraph_issues(docs)).collect()} == {(1, "B"), (3, "A-")}
    assert R.inspect_and_fix(p.where("doc_id = 2"), R.paragraph_issues, R.fix_paragraphs)[1].count() == 0
