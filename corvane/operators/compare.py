"""Keyed comparison and snapshot differences of tables, unions and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import to_number


def clean_pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value double): keys trimmed, blank and null ones gone, values coerced."""
    return df.select(F.trim(F.col(key).cast("string")).alias("key"), to_number(F.col(value).cast("string")).alias("value")).where("key is not null and key <> ''")


def verdict(left, right):
    d = right - left
    return F.when(d.isNull(), "missing").when(d == 0, "equal").otherwise("mismatch")


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, value) tables -> (key, left_value, right_value, diff, verdict) by full outer join; repeated keys multiply."""
    a, b = left.select("key", F.col("value").alias("left_value")), right.select("key", F.col("value").alias("right_value"))
    out = a.join(b, "key", "full")
    return out.withColumn("diff", F.round(F.col("right_value") - F.col("left_value"), 4)).withColumn("verdict", verdict(F.col("left_value"), F.col("right_value")))


def compare_many(left: DataFrame, right: DataFrame, keys: list[str], values: list[tuple[str, str]]) -> DataFrame:
    """Several keys and value pairs: (keys, field, left_value, right_value, diff, verdict), one join for all fields."""
    a = left.select(*keys, *[F.col(x).cast("double").alias(f"_l{i}") for i, (x, _) in enumerate(values)])
    b = right.select(*keys, *[F.col(y).cast("double").alias(f"_r{i}") for i, (_, y) in enumerate(values)])
    cells = F.array(*[F.struct(F.lit(x).alias("field"), F.col(f"_l{i}").alias("left_value"), F.col(f"_r{i}").alias("right_value")) for i, (x, _) in enumerate(values)])
    out = a.join(b, keys, "full").select(*keys, F.inline(cells))
    return out.withColumn("diff", F.round(F.col("right_value") - F.col("left_value"), 4)).withColumn("verdict", verdict(F.col("left_value"), F.col("right_value")))


def union_files(*tables: DataFrame) -> DataFrame:
    """Rows of all tables by column name; missing columns are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def same_names(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """(name, side): in both, in left or in right only."""
    a = left.select(F.col(name).alias("name"), F.lit(1).alias("_l")).distinct()
    b = right.select(F.col(name).alias("name"), F.lit(1).alias("_r")).distinct()
    return a.join(b, "name", "full").select("name", F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both").alias("side"))


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return sorted(set(a.columns) & set(b.columns))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, content_hash) tables -> (id, change): new, changed, unchanged, removed. Failed rows and rows without summary must be filtered before."""
    a, b = old.select("id", F.col("content_hash").alias("_old")), new.select("id", F.col("content_hash").alias("_new"))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return a.join(b, "id", "full").select("id", change.alias("change"))


def successful(manifest: DataFrame) -> DataFrame:
    """Rows whose status is success, a missing status counting so; where there are none, all rows."""
    ok = F.coalesce(F.col("status"), F.lit("success")) == "success"
    total = manifest.agg(F.coalesce(F.max(ok.cast("int")), F.lit(0)).alias("_any"))
    return manifest.join(F.broadcast(total)).where(ok | (F.col("_any") == 0)).drop("_any")  # one row is broadcast


def upsert(old: DataFrame, new: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    """Old rows that are neither removed nor renewed, and all new rows."""
    gone = new.select(key).union(removed.select(key)).distinct()
    return old.join(gone, key, "left_anti").unionByName(new)


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by `order`."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def first_occurrences(rows: DataFrame, value: str, pos: str) -> DataFrame:
    return rows.groupBy(value).agg(F.min(pos).alias("first_pos"))
