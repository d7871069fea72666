"""The trigram index against a scan."""

from __future__ import annotations

import random

import pyarrow.parquet as pq

from corvane.operators.substring import SubstringIndex


def test_searches_equal_a_scan(spark, tmp_path):
    draw = random.Random(4)
    words = sorted({"".join(draw.choice("abcAB é字.") for _ in range(draw.randint(1, 9))) for _ in range(400)}) + ["", "İstanbul", "straße"]
    rows = [(w, k) for k, w in enumerate(words)] + [(words[5], 1000), (None, 7)]
    index = SubstringIndex(spark, f"file://{tmp_path}/i", "word").build(spark.createDataFrame(rows, "word string, n long"))
    for q in ["", "a", "ab", "abc", "ABC", "bca", "a b", "é字", "é字.", "zzz", "aaaa", "raß"]:
        want = sorted((n, w) for w, n in rows if w is not None and q.lower() in w.lower())
        got = [(r.n, r.word) for r in index.search(q, ["n"], 10_000).collect()]
        assert got == want, q
    assert [r.n for r in index.search("a", ["n"], 3).collect()] == [n for n, _ in sorted((n, w) for w, n in rows if w and "a" in w.lower())[:3]]


def test_few_row_groups_are_read(spark, tmp_path):
    """Grams are sorted, so the statistics of row groups leave most of them out."""
    df = spark.range(60_000).selectExpr("concat(conv(id * 7919, 10, 36), '-', id) as word", "id")
    index = SubstringIndex(spark, f"file://{tmp_path}/i", "word").build(df)
    total = hit = 0
    for f in (tmp_path / "i" / "grams").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for k in range(meta.num_row_groups):
            stats = meta.row_group(k).column(0).statistics
            total += 1
            hit += stats.min <= "zz9" <= stats.max
    assert total >= 4 and hit <= 2
    plan = index.candidates("zz9")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "gram" in plan.split("PushedFilters")[1][:120]
