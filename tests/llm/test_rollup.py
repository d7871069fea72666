from __future__ import annotations

import edges
import pytest
from oracle import assert_same

from corvane.llm import rollup as R

EVENTS = "event_id string, op string, source string, lang string, tokenizer_version string, n_tokens long, old_tokens long"


def test_against_sql(spark, medium):
    assert assert_same(R.op8(spark, medium), R.OP8_SQL, medium) > 0


def totals(r):
    return {(x.source, x.lang, x.tokenizer_version): (x.n_docs, x.n_tokens) for x in r.totals().collect()}


def test_signed_batches_commit_once(spark, tmp_path):
    r = R.Rollup(spark, f"file://{tmp_path}/r")
    assert totals(r) == {}
    first = spark.createDataFrame([("1", "insert", "a", "en", "v", 10, None), ("1", "insert", "a", "en", "v", 10, None), ("2", "insert", "a", "en", "v", 5, None), ("3", "insert", None, None, "v", 7, None), ("4", "insert", "b", "en", "v", None, None)], EVENTS)
    assert r.commit("1", first) and not r.commit("1", first)
    assert totals(r) == {("a", "en", "v"): (2, 15), (None, None, "v"): (1, 7), ("b", "en", "v"): (1, 0)}
    assert r.commit("2", spark.createDataFrame([("5", "delete", "a", "en", "v", 5, None), ("6", "revise", "a", "en", "v", 12, 10), ("7", "delete", None, None, "v", 7, None)], EVENTS))
    assert totals(R.Rollup(spark, f"file://{tmp_path}/r")) == {("a", "en", "v"): (1, 12), ("b", "en", "v"): (1, 0)}


def test_late_writer_of_a_batch_loses(spark, tmp_path):
    r = R.Rollup(spark, f"file://{tmp_path}/r")
    e = spark.createDataFrame([("1", "insert", "a", "en", "v", 10, None)], EVENTS)
    R.signed(e).write.parquet(f"{tmp_path}/r/_aside-1-late/sums")  # both found the batch uncommitted
    assert r.commit("1", e) and not r._publish("_aside-1-late", "batch=1")
    assert totals(r) == {("a", "en", "v"): (1, 10)}


def test_unfinished_batches_are_unseen(spark, tmp_path):
    r = R.Rollup(spark, f"file://{tmp_path}/r")
    e = spark.createDataFrame([("1", "insert", "a", "en", "v", 10, None)], EVENTS)
    R.signed(e).write.parquet(f"{tmp_path}/r/_aside-9/sums")  # a writer that was lost before its rename
    assert totals(r) == {}
    assert r.commit("9", e) and totals(r) == {("a", "en", "v"): (1, 10)}


def test_unknown_op(spark, tmp_path):
    with pytest.raises(Exception, match="unknown op"):
        R.Rollup(spark, f"file://{tmp_path}/r").commit("1", spark.createDataFrame([("1", "drop", "a", "en", "v", 1, None)], EVENTS))


def test_edges(spark, tmp_path):
    r = R.Rollup(spark, f"file://{tmp_path}/r")
    r.commit("1", R.inserts(edges.documents(spark), {"w": R.COUNTERS["words-1"]}))
    got = totals(r)
    assert got[("b", "de", "w")] == (1, 0) and got[(None, None, "w")] == (1, 0) and got[("c", "fr", "w")][0] == 2
    assert got[("a", "en", "w")][0] == 6  # the repeated row counts once
    empty = R.Rollup(spark, f"file://{tmp_path}/e")
    empty.commit("1", R.inserts(edges.empty(spark)))
    assert totals(empty) == {}


def test_event_ids_count_once_in_all_batches(spark, tmp_path):
    one = spark.createDataFrame([("1", "insert", "a", "en", "v", 10, None), ("2", "insert", "a", "en", "v", 5, None)], EVENTS)
    two = spark.createDataFrame([("2", "insert", "a", "en", "v", 5, None), ("3", "insert", "a", "en", "v", 1, None), ("3", "insert", "b", "en", "v", 2, None)], EVENTS)
    r = R.Rollup(spark, f"file://{tmp_path}/r")
    assert r.commit("1", one) and r.commit("2", two) and totals(r) == {("a", "en", "v"): (3, 16)}
    r = R.Rollup(spark, f"file://{tmp_path}/s", keep_ids=False)
    assert r.commit("1", one) and r.commit("2", two) and totals(r) == {("a", "en", "v"): (4, 21)}


def test_snapshots_add_up_what_they_hold(spark, tmp_path):
    r = R.Rollup(spark, f"file://{tmp_path}/r")
    assert not r.compact()
    for k in range(4):
        e = spark.createDataFrame([(str(k), "insert", "a", "en", "v", 10 + k, None), (f"x{k}", "insert", None, "en", "v", 1, None)], EVENTS)
        assert r.commit(str(k), e) and not r.commit(str(k), e)
        want = {("a", "en", "v"): (k + 1, sum(range(10, 11 + k))), (None, "en", "v"): (k + 1, k + 1)}
        assert totals(r) == want and (k % 2 or r.compact()) and totals(r) == want
    assert len(r.totals().inputFiles()) <= 4


def test_one_text_of_two_sources(spark, tmp_path):
    """Rows that differ in source or language alone are different documents, as the SQL has them; equal rows are one."""
    rows = [(1, "a b", "en", "s1"), (1, "a b", "en", "s2"), (1, "a b", "de", "s1"), (1, "a b", "en", "s1"), (2, "", "en", "s1"), (3, None, None, None), (3, "x, y", None, None), (None, "x, y", "en", "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    import pyarrow.parquet as pq

    pq.write_table(pq.read_table(f"{tmp_path}/documents.parquet"), f"{tmp_path}/one.parquet")
    sql = R.OP8_SQL.replace("FROM documents", "FROM one")
    assert assert_same(R.op8(spark, str(tmp_path)), sql, str(tmp_path)) == 8


def test_counts_of_a_vocabulary_file(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = R.inserts(docs, {}, {"bpe": public_tokenizers.path("word_bpe_49k.json")}).groupBy("source").sum("n_tokens").collect()
    want = {}
    for d in docs.collect():
        want[d.source] = want.get(d.source, 0) + len(tok.encode(d.text or "", add_special_tokens=False).ids)
    assert {r[0]: r[1] for r in got} == want


def test_events_without_an_id_all_count(spark, tmp_path):
    r = R.Rollup(spark, f"file://{tmp_path}/r")
    batch = spark.createDataFrame([(None, "insert", "a", "en", "v", 5, None), (None, "insert", "b", "en", "v", 7, None), (None, "insert", "b", "en", "v", 7, None), ("1", "insert", "a", "en", "v", 1, None), ("1", "insert", "a", "en", "v", 1, None)], EVENTS)
    assert r.commit("1", batch) and not r.commit("1", batch)
    assert totals(r) == {("a", "en", "v"): (2, 6), ("b", "en", "v"): (2, 14)}
    assert r.commit("2", batch)
    assert totals(r) == {("a", "en", "v"): (3, 11), ("b", "en", "v"): (4, 28)}
