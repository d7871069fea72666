"""Scans of folders."""

from __future__ import annotations

from corvane.sources import files as I


def test_a_table_in_parts_is_one_file(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "in parts.parquet"))
    (tmp_path / "one.parquet").write_bytes(b"123")
    (tmp_path / "sub" / "deep.parquet").mkdir(parents=True)
    (tmp_path / "sub" / "deep.parquet" / "p-0.parquet").write_bytes(b"12")
    (tmp_path / "sub" / "deep.parquet" / "p-1.parquet").write_bytes(b"345")
    (tmp_path / "sub" / "x.txt").write_bytes(b"1")
    flat = I.scan(spark, str(tmp_path), (".parquet",), recursive=False).collect()
    assert [(r.name, r.suffix) for r in flat] == [("in parts.parquet", ".parquet"), ("one.parquet", ".parquet")]
    assert flat[0].bytes == sum(f.stat().st_size for f in (tmp_path / "in parts.parquet").glob("part-*"))
    deep = I.scan(spark, str(tmp_path), (".parquet", ".txt")).collect()
    assert [(r.path.split("/")[-1], r.bytes) for r in deep[2:]] == [("deep.parquet", 5), ("x.txt", 1)] and len(deep) == 4
    assert [(r.name, r.bytes) for r in I.scan(spark, str(tmp_path / "one.parquet"), (".parquet",)).collect()] == [("one.parquet", 3)]
