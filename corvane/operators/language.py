"""Language of a text by its character trigrams, against profiles counted from texts of known language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corvane.sources.tables import written

#: Paragraphs that are looked at, whole.
PARAGRAPHS = 5


#: Texts whose trigrams are counted together.
CHUNK = 200


def _heads(docs: DataFrame, key: str) -> DataFrame:
    """docs(key, text) -> (key, _t): the first paragraphs, lower-cased, white space and digits as one blank; of three characters or more."""
    head = F.array_join(F.slice(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1, PARAGRAPHS), " ")
    clean = F.regexp_replace(F.lower(head), r"[\x20\x09-\x0d0-9]+", " ")
    return docs.select(key, F.concat(F.lit(" "), clean, F.lit(" ")).alias("_t")).where("length(_t) > 2")


def trigrams(docs: DataFrame, key: str) -> DataFrame:
    """docs(key, text) -> (key, gram, n): trigrams of the first paragraphs, counted in chunks of texts, so a key may have a gram in several rows. A gram is its code points, 21 bits each."""
    heads = _heads(docs, key)
    schema = StructType([heads.schema[key], StructField("gram", LongType()), StructField("n", LongType())])

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                codes: dict = {}
                for i, (k, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
                    codes.setdefault(k, (i, []))[1].append(c[:-2] << 42 | c[1:-1] << 21 | c[2:])
                counted = [(i, *np.unique(np.concatenate(cs), return_counts=True)) for i, cs in codes.values()]
                rows = np.repeat([i for i, _, _ in counted], [len(g) for _, g, _ in counted])
                grams, ns = np.concatenate([g for _, g, _ in counted]), np.concatenate([n for _, _, n in counted])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(grams), pa.array(ns.astype(np.int64))], names=[key, "gram", "n"])

    return heads.mapInArrow(count, schema)


def profiles(docs: DataFrame) -> DataFrame:
    """docs(lang, text) -> (lang, gram, gain, base): base: log-likelihood of a trigram that the language has not shown, gain: what a known one has over it."""
    per = trigrams(docs.where("lang is not null and text is not null"), "lang").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    per = written(per, "trigrams")
    total = per.groupBy("lang").agg(F.sum("n").alias("_n"))
    size = per.select("gram").distinct().agg(F.count(F.lit(1)).alias("_v"))
    return per.join(F.broadcast(total), "lang").join(F.broadcast(size)).select("lang", "gram", F.log(F.col("n") + 1.0).alias("gain"), (-F.log(F.col("_n") + F.col("_v"))).alias("base"))  # a row a language, and one row


def detect(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, language): the likeliest by trigrams, the first by name on ties; null for texts without letters to go by."""
    docs_with = docs.where("text is not null")
    known = written(known, "profiles")
    gains = written(known.groupBy("gram").agg(F.collect_list(F.struct("lang", "gain")).alias("_l")), "gains")  # a row a gram: small enough, Spark sends it to the texts' grams
    hits = trigrams(docs_with, "doc_id").join(gains, "gram").select("doc_id", "n", F.inline("_l")).groupBy("doc_id", "lang").agg(F.sum(F.col("n") * F.col("gain")).alias("_gain"))
    size = _heads(docs_with, "doc_id").groupBy("doc_id").agg(F.sum(F.length("_t") - 2).alias("_size"))
    base = known.groupBy("lang").agg(F.min("base").alias("_base"))
    score = hits.join(size, "doc_id").join(F.broadcast(base), "lang").select("doc_id", "lang", F.round(F.col("_gain") + F.col("_size") * F.col("_base"), 6).alias("score"))  # a row a language
    best = score.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "lang")).alias("b"))
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.col("b.lang").alias("language"))
