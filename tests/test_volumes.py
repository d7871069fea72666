"""Archives of large projects."""

from __future__ import annotations

from corvane.sources import archives as A


def test_a_large_project_takes_volumes(spark):
    rows = [("p", f"a{i % 3}", "output", f"{i}.txt", bytearray(b"%d" % i * 100)) for i in range(200)] + [("q", "a", "input", "x", bytearray(b"1"))]
    files = spark.createDataFrame(rows, "project string, agent string, folder string, name string, content binary")
    out = A.archives(files, volume=5000)
    per = {r.name: r["count"] for r in out.groupBy("name").count().collect()}
    assert per["p.zip"] > 5 and per["q.zip"] == 1
    back = A.read_archives(out.withColumnRenamed("name", "path")).collect()
    assert not [r.error for r in back if r.error]
    assert sorted((r.project, r.name, bytes(r.content)) for r in back) == sorted((p, f"{a}/{f}/{n}", bytes(c)) for p, a, f, n, c in rows)
