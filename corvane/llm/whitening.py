"""Whitening of vectors: column sums, one aggregation over the upper triangle of dimension pairs, LAPACK, projection.

Entries become integers first, x = floor(64 c) + 1000000, so sums are exact in any order. The driver holds the sums and
the matrix of a vector's dimensions alone; rows meet it only as the projection's constants.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Entries beyond this, where doubles have no fraction left, count as this.
MOST = float(1 << 52)
#: Dimension pairs of one aggregation; wider vectors take one aggregation for each so many pairs.
MOST_PAIRS = 4096
#: A component whose eigenvalue is at most this share of the largest has no variance but rounding and is left out.
LEAST_SHARE = 1e-12
_LOW = 20


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vectors(vec_id, embedding) -> (vec_id, x array<long>): rows without null or non-finite entries, of the commonest length above 0.

    Of lengths that are equally common the largest counts. Other columns are ignored; repeated rows stay.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    v = v.where(F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    sizes = v.groupBy(F.size("e").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    held = lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c * SCALE, F.lit(MOST)), F.lit(-MOST))), F.lit(int(MOST))), F.lit(-int(MOST)))
    out = v.where(F.size("e") == (sizes.d if sizes else 0))
    return out.select("vec_id", F.transform("e", lambda c: held(c) + SHIFT).cast("array<long>").alias("x"))


def exact_sums(x: DataFrame) -> tuple[int, list[int]]:
    """(rows, sum of each dimension), exact: low and high bits are summed apart, so no sum leaves the range of longs."""
    first = x.select(F.size("x").alias("d")).first()
    if not first:
        return 0, []
    d = first.d
    at = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(F.shiftright(a, _LOW)) for a in at] + [F.sum(a.bitwiseAND(F.lit((1 << _LOW) - 1))) for a in at]
    row = x.agg(F.count(F.lit(1)), *sums).first()
    return row[0], [(row[1 + i] << _LOW) + row[1 + d + i] for i in range(d)]


def pair_means(rows: DataFrame, centred: list[Column]) -> np.ndarray:
    """The mean of centred[i] * centred[j] for all pairs, a symmetric matrix: an expression a pair of the upper triangle, summed in one aggregation."""
    d = len(centred)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    flat = rows.select(*[c.alias(f"c{i}") for i, c in enumerate(centred)])
    out = np.zeros((d, d))
    for at in range(0, len(pairs), MOST_PAIRS):
        part = pairs[at : at + MOST_PAIRS]
        row = flat.selectExpr(*[f"c{k}" for k in sorted({k for p in part for k in p})]).agg(F.expr("count(1)"), *[F.expr(f"sum(c{i} * c{j})") for i, j in part]).first()
        for (i, j), s in zip(part, row[1:], strict=True):
            out[i, j] = out[j, i] = s / row[0]
    return out


class Whitener:
    """What is fitted: number of rows, exact sums, eigenvalues and unit eigenvectors, the largest first."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int = COMPONENTS):
        self.n, self.floor, self.rest = n, [s // n for s in sums], [s % n for s in sums]
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[:, order]
        keep = int(np.count_nonzero((values > 0) & (values > LEAST_SHARE * values[0])))
        keep = min(keep, components)
        self.values, self.vectors = values[:keep], np.ascontiguousarray(vectors[:, :keep])
        trace = float(np.trace(covariance))
        self.explained = self.values / trace if trace > 0 else self.values

    def project(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """(whitened rows, deviations): x - S/n rounds once; deviations are exact, None where a long cannot hold them."""
        whole = x - np.array(self.floor, np.int64)
        centred = whole - np.array(self.rest, np.float64) / self.n
        white = (centred @ self.vectors) / np.sqrt(self.values)
        most = float(np.abs(whole).max(initial=0) + 1) * self.n
        if most * most * x.shape[1] < 2.0**62:
            dev = whole * self.n - np.array(self.rest, np.int64)
            return white, (dev * dev).sum(axis=1).tolist()
        big = [sum((w * self.n - r) ** 2 for w, r in zip(row, self.rest, strict=True)) for row in whole.tolist()]
        return white, [b if b < 1 << 63 else None for b in big]


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """x(x array<long>), all of one length -> its whitener; None for no rows."""
    n, sums = exact_sums(x)
    if not n:
        return None
    centred = [(F.col("x")[i] - F.lit(s // n)).cast("double") - F.lit((s % n) / n) for i, s in enumerate(sums)]
    return Whitener(n, sums, pair_means(x, centred), components)


def transform(x: DataFrame, w: Whitener) -> DataFrame:
    """x(vec_id, x) -> (vec_id, deviation, white array<double>)."""
    names = ["vec_id", "deviation", "white"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            white, dev = w.project(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            k = white.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (b.num_rows + 1) * k, k) if k else np.zeros(b.num_rows + 1), pa.int32()), pa.array(white.reshape(-1), pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dev, pa.int64()), lists], names=names)

    return x.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, white array<double>")


def identity_error(white: DataFrame, k: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    means = white.agg(*[F.avg(F.col("white")[i]) for i in range(k)]).first()
    cov = pair_means(white, [F.col("white")[i] - F.lit(float(m)) for i, m in enumerate(means)])
    return float(np.abs(cov - np.eye(k)).max())


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors(vec_id, embedding) -> a row for each remaining vector and component (SCHEMA).

    Vectors that are null, empty or hold null or non-finite entries are left out, and those of another length than
    the commonest. Components without variance are left out, so equal vectors, a single vector and an empty table give
    no rows. Null ids and repeated rows stay. A deviation beyond a long is null. Entries beyond 2^46 count as 2^46.
    """
    spark = vectors.sparkSession
    x = materialise(integer_vectors(vectors), "integers")
    w = fit(x, components)
    if w is None or not len(w.values):
        return spark.createDataFrame([], SCHEMA)
    white = materialise(transform(x, w), "whitened")
    error = identity_error(white, len(w.values))
    shares = F.array(*[F.lit(float(s)) for s in w.explained])
    rows = white.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
