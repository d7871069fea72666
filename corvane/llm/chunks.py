"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest.

A cut follows a byte where the top bits of the rolling hash are zero. The hash sees the last 16 bytes only, so a
passage is cut alike wherever it stands, and an insertion moves the cuts near it alone.
"""

from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, materialise, table

MIN_CHUNK = 24
MAX_CHUNK = 256
#: Top bits that are zero at a cut: one byte in 2^5 on average.
CUT_BITS = 5
#: Code points of the shortest repeated span that counts.
MIN_SPAN = 80

_draw = random.Random(11)
_GEAR = np.array([0] + [_draw.getrandbits(32) for _ in range(255)], np.uint32)


def _candidates(raw: np.ndarray) -> np.ndarray:
    """Whether a cut may follow each byte: the gear hash by doubling, h = sum of gear(byte k back) << k over 16 bytes."""
    h = _GEAR[raw]
    for k in (1, 2, 4, 8):
        add = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += add
    ok = (h >> np.uint32(32 - CUT_BITS)) == 0
    ok[:-1] &= (raw[1:] & 0xC0) != 0x80  # only between characters
    return ok


def cut_points(data: bytes, candidates: list[int] | None = None) -> list[int]:
    """Ends of the chunks of one text's UTF-8 bytes; none for an empty text."""
    n = len(data)
    if not n:
        return []
    if candidates is None:
        candidates = (np.flatnonzero(_candidates(np.frombuffer(data, np.uint8))) + 1).tolist()
    out, at = [], 0
    for c in [*candidates, n]:
        while c - at > MAX_CHUNK:
            end = at + MAX_CHUNK
            while data[end] & 0xC0 == 0x80:
                end -= 1
            out.append(end)
            at = end
        if c - at >= MIN_CHUNK or c == n and c > at:
            out.append(c)
            at = c
    return out


def _chunk(ids: list, rows: list, texts: list) -> list:
    digest = xxhash.xxh3_128_intdigest
    low = (1 << 64) - 1
    out: list[list] = [[], [], [], [], [], []]
    for at in range(0, len(texts), 256):
        datas = [(t or "").encode("utf-8", "surrogatepass") for t in texts[at : at + 256]]
        gap = bytes(32)
        raw = np.frombuffer(gap.join(datas) + gap, np.uint8)
        cuts = np.flatnonzero(_candidates(raw)) + 1
        heads = np.cumsum([0] + [len(d) + 32 for d in datas])
        place = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        for k, d in enumerate(datas):
            if not d:
                continue
            h = int(heads[k])
            lo, hi = np.searchsorted(cuts, (h + 1, h + len(d)))
            ends = cut_points(d, (cuts[lo:hi] - h).tolist())
            starts = [0, *ends[:-1]]
            marks = (place[np.array([0, *ends]) + h] - place[h]).tolist()
            values = [digest(d[s:e]) for s, e in zip(starts, ends, strict=True)]
            out[0] += [ids[at + k]] * len(ends)
            out[1] += [rows[at + k]] * len(ends)
            out[2] += marks[:-1]
            out[3] += marks[1:]
            out[4] += [(v >> 64) - (1 << 63) for v in values]
            out[5] += [(v & low) - (1 << 63) for v in values]
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, _row, start, end, hi, lo): a row a chunk, in code points, with its 128-bit digest. _row: xxhash64 of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_row"), F.col("text").alias("text"))
    return map_rows(rows, _chunk, "doc_id long, _row long, start long, end long, hi long, lo long")


def repeated_spans(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, _row, start, end, n_chunks, first, source_doc_id, n_sources, n_occurrences): runs of chunks that stand in two or more places, of two documents or of one.

    first: these are the first places, by document and start, which keep the chunks. source_doc_id: the document that
    has most of the run's characters in their first place; n_sources: over how many documents those places are spread.
    n_occurrences: of the run's most frequent chunk. Runs shorter than min_span code points are left out. Null, empty
    and unrepeated texts give no rows; rows with a null id are compared with nothing; equal rows count once, and other
    texts of one id are places of their own.
    """
    found = materialise(chunks(docs.where("doc_id is not null")), "chunks")
    place = F.struct("doc_id", "_row", "start")
    per = found.groupBy("hi", "lo").agg(F.min(place).alias("source"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
    again = materialise(per.where("source < last").select("hi", "lo", "source", "n"), "repeated")
    hits = found.join(again, ["hi", "lo"]).select("doc_id", "_row", "start", "end", "n", F.col("source.doc_id").alias("source"), (F.col("source") == place).alias("first"))
    hits = hits.dropDuplicates(["doc_id", "_row", "start"])
    w = Window.partitionBy("doc_id", "_row").orderBy("start")
    new = (F.lag("end").over(w).eqNullSafe(F.col("start")) & F.lag("first").over(w).eqNullSafe(F.col("first"))).cast("int")
    runs = hits.withColumn("new", 1 - new).withColumn("run", F.sum("new").over(w))
    by_source = runs.groupBy("doc_id", "_row", "run", "source").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.col("end") - F.col("start")).alias("chars"), F.count(F.lit(1)).alias("n_chunks"), F.min("first").alias("first"), F.max("n").alias("n")
    )
    spans = by_source.groupBy("doc_id", "_row", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_chunks").alias("n_chunks"), F.min("first").alias("first"),
        F.min(F.struct((-F.col("chars")).alias("less"), "source")).alias("most"), F.count(F.lit(1)).alias("n_sources"), F.max("n").alias("n_occurrences"),
    )
    spans = spans.select("doc_id", "_row", "start", "end", "n_chunks", "first", F.col("most.source").alias("source_doc_id"), "n_sources", "n_occurrences")
    return spans.where(F.col("end") - F.col("start") >= min_span)


def without_repeats(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """docs with the repeated spans that are not first cut out of text; other columns as they are."""
    gone = repeated_spans(docs, min_span).where("not first").groupBy(F.col("doc_id").alias("_cv_id"), F.col("_row").alias("_cv_row"))
    gone = gone.agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cv_spans"))
    out = docs.join(gone, (docs["doc_id"] == F.col("_cv_id")) & (F.xxhash64(docs["text"]) == F.col("_cv_row")), "left")
    text = F.expr("""if(_cv_spans is null, text, aggregate(_cv_spans, struct('' as t, 0L as at),
        (s, x) -> struct(concat(s.t, substring(text, cast(s.at + 1 as int), cast(x.start - s.at as int))) as t, x.end as at),
        s -> concat(s.t, substring(text, cast(s.at + 1 as int)))))""")
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("_row")
