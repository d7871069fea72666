"""Substring search over a vocabulary by an index of character trigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a gram; shorter queries read the vocabulary itself.
GRAM = 3
#: Rows of a file's row group at most, so that one gram's rows are few row groups of their own.
GROUP_BYTES = 1 << 20


def grams(c) -> F.Column:
    """The distinct trigrams of a lower-cased text."""
    t = F.lower(c)
    at = F.sequence(F.lit(1), F.length(t) - GRAM + 1)
    return F.when(F.length(t) >= GRAM, F.array_distinct(F.transform(at, lambda i: F.substring(t, i, GRAM)))).otherwise(F.array().cast("array<string>"))


class SubstringIndex:
    """Two tables in a folder: the rows of a vocabulary, and (gram, term) sorted by gram, so that a gram's rows lie in few row groups."""

    def __init__(self, spark: SparkSession, path: str, column: str):
        self.spark, self.path, self.column = spark, path, column

    def build(self, rows: DataFrame) -> SubstringIndex:
        """rows: any columns with the text column; null texts are left out. Rows of a common gram are spread over files by term."""
        own = rows.where(F.col(self.column).isNotNull())
        own.write.parquet(f"{self.path}/rows")
        terms = own.select(F.col(self.column).alias("term")).distinct()
        posted = terms.select(F.explode(grams(F.col("term"))).alias("gram"), "term").repartitionByRange("gram", "term").sortWithinPartitions("gram", "term")
        posted.write.option("parquet.block.size", GROUP_BYTES).parquet(f"{self.path}/grams")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def candidates(self, query: str) -> DataFrame | None:
        """(term): those that hold all trigrams of the query, read from the row groups of these grams alone; None for a query that is too short."""
        low = query.lower()
        wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        if not wanted:
            return None
        posted = self.spark.read.parquet(f"{self.path}/grams").where(F.col("gram").isin(wanted))
        return posted.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(wanted)).select("term")

    def search(self, query: str, order: list, n: int = 10) -> DataFrame:
        """The first n rows in order whose text contains the query, without case: what a scan finds."""
        found = self.candidates(query)
        rows = self.rows()
        if found is not None:
            rows = rows.join(found, rows[self.column] == found["term"], "left_semi")
        return rows.where(F.contains(F.lower(self.column), F.lit(query.lower()))).orderBy(*order).limit(n)
