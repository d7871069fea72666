"""Mixing sources to target weights by Poisson replication, in SQL functions only.

Each document draws its number of copies from a Poisson law whose mean is its source's target repetition rate; the
draw inverts the distribution at a uniform hash of seed and document id, so it can be repeated anywhere. A rate
over 8 is drawn as a sum of equal smaller ones, which has the same law.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

SEED = 17
#: Target share of a source: its size to this power, normalised. 1 keeps the mixture, 0 makes sources equal.
ALPHA = 0.5
STEP = 8.0
TERMS = 63
#: The highest rate that is drawn; a sum of more parts would be evaluated in every row.
MAX_RATE = 1e6


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """docs(source, text) -> (_cv_source, _cv_rate, _cv_parts, _cv_cdf), a row a source.

    weights: target weight by source, unnamed sources 0; else size^alpha. Sizes are code points; null sources are a
    source of their own; a source without text has rate 1. The total size stays as it is. Weights below zero or not
    finite, and rates over MAX_RATE, are errors.
    """
    for k, v in (weights or {}).items():
        if not 0 <= v < float("inf"):
            raise ValueError(f"weight of {k}: {v}")
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("size"))
    if weights is None:
        w: Column = F.pow("size", F.lit(float(alpha)))
    else:
        w = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    sizes = materialise(sizes.withColumn("w", F.when(F.col("size") > 0, w).otherwise(F.lit(0.0))), "sizes")
    total = sizes.agg(F.sum("w").alias("tw"), F.sum("size").alias("ts")).first()
    tw, ts = float(total.tw or 0), float(total.ts or 0)
    rate = F.when(F.col("size") > 0, F.col("w") * F.lit(ts) / (F.lit(tw) * F.col("size")) if tw > 0 else F.lit(0.0)).otherwise(F.lit(1.0))
    out = sizes.select(F.col("source").alias("_cv_source"), rate.alias("_cv_rate"))
    high = out.where(F.col("_cv_rate") > MAX_RATE).first()
    if high:
        raise ValueError(f"source {high._cv_source} would be repeated {high._cv_rate:g} times")
    out = out.withColumn("_cv_parts", F.greatest(F.lit(1), F.ceil(F.col("_cv_rate") / STEP)).cast("int")).withColumn("_m", F.col("_cv_rate") / F.col("_cv_parts"))
    cdf = f"""aggregate(sequence(1, {TERMS}), struct(exp(-_m) as p, exp(-_m) as c, array(exp(-_m)) as a),
        (s, k) -> struct(s.p * _m / k as p, s.c + s.p * _m / k as c, concat(s.a, array(s.c + s.p * _m / k)) as a), s -> s.a)"""
    return out.withColumn("_cv_cdf", F.expr(cdf)).drop("_m")


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """docs, any columns with doc_id, source and text -> its rows as often as drawn, with _cv_rate, _cv_copy (from 0) and _cv_key, in random order over all partitions.

    Rows with one id draw alike; null ids draw as the id 'null'. An empty table stays empty. The rates table, a row a
    source, is written first, so that Spark knows its size and broadcasts it only below its threshold.
    """
    r = materialise(rates(docs, weights, alpha), "rates")
    name = F.coalesce(docs["doc_id"].cast("string"), F.lit("null"))
    out = docs.withColumn("_cv_name", name).join(r, docs["source"].eqNullSafe(F.col("_cv_source")))
    draw = f"""aggregate(sequence(0, _cv_parts - 1), 0, (n, j) -> n + size(filter(_cv_cdf, c ->
        c <= cast(conv(substring(md5(concat('{seed}:', _cv_name, ':', cast(j as string))), 1, 13), 16, 10) as double) / 4503599627370496.0D)))"""
    out = out.withColumn("_cv_copies", F.expr(draw)).where("_cv_copies > 0").withColumn("_cv_copy", F.explode(F.expr("sequence(0L, _cv_copies - 1L)")))
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("_cv_name"), F.lit("/"), F.col("_cv_copy").cast("string"))), 1, 13), 16, 10).cast("long")
    out = out.withColumn("_cv_key", key).drop("_cv_name", "_cv_source", "_cv_parts", "_cv_cdf", "_cv_copies")
    return out.repartition(F.col("_cv_key")).sortWithinPartitions("_cv_key")


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """The documents' own columns only."""
    return replicate(docs, **kw).select(*docs.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replicate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.round("_cv_rate", 6).alias("rate"), F.col("_cv_copy").alias("copy"), F.col("_cv_key").alias("shuffle_key"))


OP10_SQL = f"""
WITH sizes AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source),
w AS (SELECT *, CASE WHEN size > 0 THEN pow(size, {ALPHA}) ELSE 0.0 END AS w FROM sizes),
r AS (SELECT source, CASE WHEN size > 0 THEN w * (SELECT sum(size) FROM w) / ((SELECT sum(w) FROM w) * size) ELSE 1.0 END AS rate FROM w),
p AS (SELECT *, CAST(greatest(1, ceil(rate / {STEP})) AS INTEGER) AS parts FROM r),
terms AS (SELECT source, k, exp(-rate / parts) * CASE WHEN k = 0 THEN 1.0 ELSE exp(k * ln(rate / parts) - lgamma(k + 1)) END AS pk FROM p, range({TERMS} + 1) AS t(k)),
cum AS (SELECT source, k, sum(pk) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM terms),
cdf AS (SELECT source, list(c ORDER BY k) AS cs FROM cum GROUP BY source),
drawn AS (SELECT doc_id, d.source, rate, list_sum(list_transform(range(parts), lambda j: len(list_filter(cs, lambda c:
    c <= CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(j AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)))) AS n
  FROM documents d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source),
copies AS (SELECT doc_id, source, rate, unnest(range(CAST(n AS BIGINT))) AS copy FROM drawn)
SELECT doc_id, source, round(rate, 6) AS rate, copy, CAST('0x' || substr(md5('{SEED}/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || CAST(copy AS VARCHAR)), 1, 13) AS BIGINT) AS shuffle_key FROM copies
"""
