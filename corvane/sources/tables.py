"""Table inputs: parquet by name, literal rows shared by a query and its SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, columns: str, rows: str) -> DataFrame:
    """Literal rows: the same text is a FROM clause for any SQL engine."""
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({columns})")


def values_sql(columns: str, rows: str) -> str:
    return f"(SELECT * FROM (VALUES {rows}) AS t({columns}))"


_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, or in the session's checkpoint folder; where neither is set, in a local one of a local master alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        current = context._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else _own.get(context.applicationId)
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='tables-')}"
    return f"{base}/tables-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written to a scratch path and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def selected(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """Rows of a SELECT over {table} names, in words that any SQL engine reads; selected_sql() is the same as a FROM clause."""
    return spark.sql(sql, **{n: load(spark, sf_dir, n) for n in names})


def selected_sql(sql: str, *names: str) -> str:
    return f"({sql.format(**{n: n for n in names})})"


def _rows_in(rows: str) -> int:
    """How many rows a VALUES list has: the opening brackets outside of all others and of quotes."""
    depth = n = 0
    quoted = False
    for c in rows:
        if c == "'":
            quoted = not quoted
        elif not quoted:
            n += c == "(" and depth == 0
            depth += (c == "(") - (c == ")")
    return n


def woven(columns: str, rows: str, table: str, key: str, mix: dict[str, str], order: str | None = None) -> str:
    """A SELECT for selected() and selected_sql(): each row of a table takes one of the literal rows by its key, and mix says how its columns come into it.

    columns of the literals that mix does not name stay as they are; in mix's expressions v is the literal row.
    """
    names = [c.strip() for c in columns.split(",")]
    picked = ", ".join(f"{mix[c]} AS {c}" if c in mix else f"v.{c} AS {c}" for c in names)
    return f"""SELECT {key} AS {key}, {picked} FROM {{{table}}} JOIN (SELECT *, row_number() OVER (ORDER BY {order or names[0]}) - 1 AS row_number FROM (VALUES {rows.replace("{", "{{").replace("}", "}}")}) AS t({columns})) v ON {key} % {_rows_in(rows)} = v.row_number"""
