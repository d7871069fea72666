from __future__ import annotations

import edges
from oracle import assert_same

from corvane.llm import templates as T


def test_against_sql(spark, medium):
    assert assert_same(T.op3(spark, medium), T.OP3_SQL, medium) > 0


def corpus(spark, n=40):
    say = lambda i, k: " ".join(f"t{chr(97 + (i * 13 + k * 7 + j) % 26)}{chr(97 + (i + j * 5) % 26)}" for j in range(11))
    rows = [(i, f"Posted by user{i} on the page {i * 3} of this site\n{say(i, 1)}\n{say(i, 2)}\nAll rights reserved here always") for i in range(n)]
    copy = "\n".join(f"the copied line number {chr(97 + k)} of one single document" for k in range(6))
    rows += [(1000 + i, copy) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_templates_generalise_and_copies_stay(spark):
    rows = {r.doc_id: r for r in T.line_dedup(corpus(spark)).collect()}
    assert all(rows[i]._cv_dropped == [0, 3] for i in range(40))
    assert all(rows[i]._cv_text == "\n".join(rows[i].text.split("\n")[1:3]) for i in range(40))
    assert all(rows[1000 + i]._cv_dropped is None for i in range(60))


def lines_dropped(spark, tail, n=40, more=()):
    """The tail stands at the end of n otherwise different documents."""
    own = lambda i: "\n".join(" ".join(f"w{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + j)}" for j in range(12)) for k in range(4))
    rows = [(i, f"{own(i)}\n{tail(i)}") for i in range(n)] + [(5000 + k, t) for k, t in enumerate(more)]
    return {r.doc_id: r._cv_dropped or [] for r in T.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_inner_lines_of_a_passage_go_and_near_copies_stay(spark):
    copies = ["\n".join(f"line {'abcdef'[k]} of the copied document" if k != i % 6 else f"changed{chr(97 + i)} words{chr(97 + i)}" for k in range(6)) for i in range(20)]
    got = lines_dropped(spark, lambda i: "All rights reserved here\nTerms of use apply\nContact the editors\nBack to top", more=copies)
    assert all(got[i] == [4, 5, 6, 7] for i in range(40)) and all(got[5000 + k] == [] for k in range(20))


def test_fields_and_single_words_go(spark):
    got = lines_dropped(spark, lambda i: f"Page {i} of {i + 9}\nCopyright {1990 + i} Foo Inc\nShare")
    assert all(got[i] == [4, 5, 6] for i in range(40))


def test_threshold_does_not_grow_with_the_table(spark):
    more = [f"other{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} words" for k in range(2000)]
    got = lines_dropped(spark, lambda i: "All rights reserved here" if i < 12 else f"own{chr(97 + i % 26)} last{chr(97 + i // 26)}", more=more)
    assert all(got[i] == ([4] if i < 12 else []) for i in range(40))


def test_repeated_rows_and_ties_against_sql(spark, tmp_path):
    """Equal rows, texts of one id, templates in exactly as many documents as are needed and in one fewer."""
    own = lambda i: "\n".join(f"x{chr(97 + i % 26)}{chr(97 + k)} y{chr(97 + i // 26)} z{chr(97 + k)}{chr(97 + i % 26)} and more of it" for k in range(5))
    rows = []
    for i in range(60):
        t = own(i) + ("\nTerms of use" if i < T.MIN_DOCS else "\nTerms of sale" if i < 2 * T.MIN_DOCS - 1 else "") + (f"\n{i} 2 3\nShare\nPage {i}, <*> x" if i % 2 else "")
        rows += [(i // 2 if i > 50 else i, t)] * (3 if i % 5 == 0 else 1)
    rows += [(None, own(1) + "\nShare"), (100, None), (101, ""), (102, "\n\n")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/parts")
    next(iter((tmp_path / "parts").glob("*.parquet"))).rename(tmp_path / "documents.parquet")
    assert assert_same(T.op3(spark, str(tmp_path)), T.OP3_SQL, str(tmp_path)) == len(rows)
    dropped = {r.doc_id: r.dropped_lines for r in T.op3(spark, str(tmp_path)).collect()}
    assert dropped[0] == "5" and dropped[1] == "5,7,8" and dropped[12] == ""


def test_edges(spark):
    docs = edges.documents(spark)
    out = T.line_dedup(docs)
    assert out.count() == len(edges.texts())
    assert all(r._cv_text == r.text for r in out.collect())
    assert [r._cv_lines for r in out.collect() if r.text is None] == [0]
    back = T.without_recurring_lines(docs)
    assert back.columns == docs.columns and back.dtypes == docs.dtypes and back.exceptAll(docs).count() == 0
    assert T.without_recurring_lines(edges.empty(spark)).count() == 0
