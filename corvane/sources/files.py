"""File inputs and outputs: scans, listings, text with encoding fallback, typed all-text CSV, JSON, signatures, snapshots."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SUFFIXES = (".xlsx", ".xls", ".csv")


def scan(spark: SparkSession, path: str, suffixes: tuple[str, ...] = TABLE_SUFFIXES, recursive: bool = True) -> DataFrame:
    """(path, name, suffix, bytes, modified), ordered by path; contents are not read. A path to one file gives that file.

    A folder below `path` that has one of the suffixes is one file in parts, as tables are written: its bytes and last
    change are those of its parts. Other folders are looked into if `recursive`.
    """
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.when(F.startswith("path", F.lit(root + "/")), F.substring("path", len(root) + 2, 1 << 30)).otherwise(F.element_at(F.split("path", "/"), -1))
    steps, suffix = F.split(below, "/"), lambda x: F.lower(F.regexp_extract(x, r"(\.[^.]+)$", 1))
    own = F.filter(F.transform(steps, lambda x, i: F.when(suffix(x).isin(*suffixes), i + 1)), lambda x: x.isNotNull())
    found = files.select("path", "length", "modificationTime", steps.alias("_steps"), F.get(own, 0).alias("_n")).where("_n is not null" if recursive else "_n = 1")
    rest = F.size("_steps") - F.col("_n")  # steps from the table down to its part
    parts = F.split("path", "/")
    found = found.select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - rest), "/").alias("path"), F.get("_steps", F.col("_n") - 1).alias("name"), "length", "modificationTime")
    out = found.groupBy("path", "name").agg(F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))
    return out.select("path", "name", suffix(F.col("name")).alias("suffix"), "bytes", "modified").orderBy("path")


def binary(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(path).select("path", "content")


def decoded(content: Column) -> Column:
    """UTF-8 without byte order mark, else GBK, else UTF-8 without its faults; Spark's own decoders cannot fall back."""
    import pandas as pd

    @F.pandas_udf("string")
    def read(contents):
        out = []
        for c in contents:
            for how in (("utf-8-sig", "strict"), ("gbk", "strict"), ("utf-8", "ignore")):
                try:
                    out.append(None if c is None else bytes(c).decode(*how))
                    break
                except UnicodeDecodeError:
                    continue
        return pd.Series(out, dtype=object)

    return read(content)


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", limit: int | None = None) -> DataFrame:
    """All columns as text, head as names; a byte order mark in the first name goes; rows as they come up to `limit`."""
    df = spark.read.option("header", True).option("inferSchema", False).option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.limit(limit) if limit is not None else df


def read_csv_guessing(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """UTF-8, or GBK for a file whose bytes are not UTF-8."""
    bad = binary(spark, path).where(~F.is_valid_utf8(F.col("content").cast("string"))).limit(1).count()
    return read_csv(spark, path, "GBK" if bad else "UTF-8", limit)


def directory_tables(paths: DataFrame, root: str) -> DataFrame:
    """paths(path) -> (path, relative_path, group): the first folder below root, or _root."""
    base = re.escape(root.rstrip("/") + "/")
    rel = F.regexp_replace("path", f"^(file:)?(//)?{base}", "")
    return paths.select("path", rel.alias("relative_path"), F.when(F.contains(rel, F.lit("/")), F.element_at(F.split(rel, "/"), 1)).otherwise("_root").alias("group"))


def text_paragraphs(texts: DataFrame) -> DataFrame:
    """texts(path, content binary) -> (path, pos, text): trimmed lines that are not blank, as plain paragraphs."""
    lines = texts.select("path", F.posexplode(F.split(decoded(F.col("content")), "\r?\n")).alias("pos", "text"))
    return lines.select("path", "pos", F.trim("text").alias("text")).where("text <> ''")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file or folder; a missing path gives none, broken records go."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def write_snapshot(df: DataFrame, path: str) -> str:
    """Write a version aside and rename it to path, whose former version goes last: readers see the old or the new one."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    p = jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p(path)):
        fs.rename(p(path), p(old))
    if not fs.rename(p(new), p(path)):
        raise OSError(f"cannot put {new} in place of {path}")
    fs.delete(p(old), True)
    return path


def file_type(content: Column) -> Column:
    """By the first bytes: legacy office, zip container, PDF, else unknown."""
    head = F.hex(F.substring(content, 1, 5))
    return F.when(head.startswith("D0CF11E0"), "ole").when(head.startswith("504B0304"), "zip").when(head == "255044462D", "pdf").otherwise("unknown")


# fixed values: line patterns that tell Markdown
MARKDOWN_LINE = r"^(#{1,6}\s|[-*+]\s|[0-9]+\.\s|>\s|```|\|.*\|)|\[[^\]]*\]\([^)]*\)|\*\*[^*]+\*\*"


def is_markdown(name: Column, text: Column) -> Column:
    """By suffix, or a .txt of whose first 50 lines (in 5000 characters) three carry a mark."""
    lines = F.slice(F.split(F.substring(text, 1, 5000), "\n"), 1, 50)
    hits = F.size(F.filter(lines, lambda x: x.rlike(MARKDOWN_LINE)))
    return F.lower(name).rlike(r"\.(md|markdown)$") | (F.lower(name).endswith(".txt") & (hits >= 3))


def header_row(rows: DataFrame) -> DataFrame:
    """rows(table, pos, cells) -> (table, header_pos): the first of ten rows with three or more filled cells of which fewer than half start with Unnamed; none: 0."""
    filled = F.filter("cells", lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    unnamed = F.filter(filled, lambda x: x.startswith("Unnamed"))
    ok = (F.col("pos") < 10) & (F.size(filled) >= 3) & (F.size(unnamed) < 0.5 * F.size(filled))
    return rows.groupBy("table").agg(F.coalesce(F.min(F.when(ok, F.col("pos"))), F.lit(0)).alias("header_pos"))


def block_spans(spans: DataFrame) -> DataFrame:
    """spans(page, block, size, bold, x0, y0, x1, y1, text, pos) -> a row a block: mode of sizes, majority bold, union of boxes, joined text."""
    return spans.groupBy("page", "block").agg(
        F.mode("size", True).alias("size"), (F.avg(F.col("bold").cast("int")) > 0.5).alias("bold"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "").alias("text"),
    )


def dispatch(name: Column) -> Column:
    """Which reader takes a file."""
    e = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(e.isin("docx"), "docx").when(e.isin("pptx"), "pptx").when(e.isin("xlsx", "xlsm"), "xlsx").when(e.isin("html", "htm"), "html").when(e.isin("csv", "tsv"), "csv").when(e.isin("txt", "md"), "text").otherwise("unsupported")
