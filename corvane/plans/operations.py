"""A small safe compiler from operation lists to DataFrame calls: filter, sort, compute, select, pivot, merge. Nothing is evaluated as code."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_condition = re.compile(r"^\s*(<=|>=|!=|==|=|<|>)\s*(.+?)\s*$")
_term = re.compile(r"\s*(?:([A-Za-z_][A-Za-z0-9_]*)|([0-9]+(?:\.[0-9]+)?)|([-+*/()]))")


def _literal(text: str):
    text = text.strip()
    if re.fullmatch(r"-?[0-9]+", text):
        return int(text)
    if re.fullmatch(r"-?[0-9]+\.[0-9]+", text):
        return float(text)
    return text.strip("'\"")


def condition(column: Column, text: str) -> Column:
    m = _condition.match(text)
    if not m:
        raise ValueError(f"not a condition: {text!r}")
    value = F.lit(_literal(m[2]))
    return {"<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value, "!=": column != value}.get(m[1], column == value)


def formula(text: str, columns: list[str]) -> Column:
    """Sums, differences, products, quotients and brackets of columns and numbers; division by zero is null."""
    tokens, at = [], 0
    while text[at:].strip():
        m = _term.match(text, at)
        if not m:
            raise ValueError(f"not a formula: {text!r}")
        tokens.append(m)
        at = m.end()
    pos = 0

    def peek() -> str | None:
        return tokens[pos][3] if pos < len(tokens) else None

    def atom() -> Column:
        nonlocal pos
        if pos >= len(tokens):
            raise ValueError(f"formula ends early: {text!r}")
        m = tokens[pos]
        pos += 1
        if m[1]:
            if m[1] not in columns:
                raise ValueError(f"no column {m[1]!r}")
            return F.col(m[1]).cast("double")
        if m[2]:
            return F.lit(float(m[2]))
        if m[3] == "-":
            return -atom()
        if m[3] == "(":
            out = total()
            if peek() != ")":
                raise ValueError(f"bracket left open: {text!r}")
            pos += 1
            return out
        raise ValueError(f"not a formula: {text!r}")

    def product() -> Column:
        nonlocal pos
        out = atom()
        while peek() in ("*", "/"):
            op = peek()
            pos += 1
            out = out * atom() if op == "*" else F.try_divide(out, atom())
        return out

    def total() -> Column:
        nonlocal pos
        out = product()
        while peek() in ("+", "-"):
            op = peek()
            pos += 1
            out = out + product() if op == "+" else out - product()
        return out

    out = total()
    if pos != len(tokens):
        raise ValueError(f"not a formula: {text!r}")
    return out


def compile_operations(df: DataFrame, operations: list[dict], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Apply the operations in order. Unknown types, columns and tables are errors."""
    for op in operations:
        kind = op.get("type")
        if kind == "filter":
            df = df.where(condition(F.col(op["column"]), op["condition"]))
        elif kind == "sort":
            c = F.col(op["column"])
            df = df.orderBy(c.asc() if op.get("ascending", True) else c.desc())
        elif kind == "compute":
            df = df.withColumn(op["column"], formula(op["formula"], df.columns))
        elif kind == "select":
            df = df.select(*op["columns"])
        elif kind == "pivot":
            df = df.groupBy(op["index"]).pivot(op["column"], op["values"]).agg(F.sum(op["value"]))
        elif kind == "merge":
            other = (tables or {})[op["table"]]
            df = df.join(other, op["on"], op.get("how", "inner")) if op.get("on") else df.unionByName(other, allowMissingColumns=True)
        else:
            raise ValueError(f"unknown operation {kind!r}")
    return df
