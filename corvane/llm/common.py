"""Shared helpers: session-named shared folder, materialised tables, Arrow row mapping."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that map_rows() turns into Python objects at once.
ROWS = 1024

_made: list[tuple[SparkSession, str]] = []


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the session's checkpoint folder; where neither is set, a local one of a local master alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
    return _own[context.applicationId]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _cleanup() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at interpreter exit
            return


atexit.register(_cleanup)


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends, sizes are known, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path, compression=codec)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by materialise() that nothing reads any more."""
    path = getattr(df, "_corvane_path", None)
    if path:
        _delete(df.sparkSession, path)


def map_rows(df: DataFrame, fn: Callable[..., list], schema: str) -> DataFrame:
    """fn gets a list per column of df and returns a list per column of schema (Arrow batches, no per-row calls)."""
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            cols = fn(*[c.to_pylist() for c in b.columns])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, struct)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_repo(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
