"""Trigrams of texts."""

from __future__ import annotations

from collections import Counter

from corvane.operators import language as N


def test_trigrams_are_counted_by_code_points(spark):
    docs = spark.createDataFrame([(1, "Ab 12 c😀\n\nd"), (1, "ab"), (2, "é"), (None, "zz"), (3, "")], "doc_id long, text string")
    got = Counter()
    for r in N.trigrams(docs, "doc_id").collect():
        got[r.doc_id, "".join(chr(r.gram >> s & 0x1FFFFF) for s in (42, 21, 0))] += r.n
    want = Counter((k, t[i : i + 3]) for k, t in ((1, " ab c😀 d "), (1, " ab "), (2, " é "), (None, " zz ")) for i in range(len(t) - 2))
    assert got == want
