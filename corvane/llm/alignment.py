"""Alignment of two tokenizers' ids over a corpus, by distinct segments.

Texts are split where neither vocabulary can join anything (see segments.py). A block of documents lists its distinct
segments and keeps its documents as numbers into that list; over all blocks each distinct segment is tokenised and
aligned once, with the list of its places in blocks, by which alignments go back; blocks compose their documents. So
what is shuffled is a row a block and distinct segment, never a row an occurrence; what goes back is packed first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, materialise, release, table
from .segments import byte_level, piece_bpe, splitter

#: Characters of a block; a longer single document is a block of its own.
BLOCK_CHARS = 1 << 24
#: Rows that a task packs at once.
PACKED = 1 << 19
#: Input partitions, as a power of two, whose places a segment lists in one row: that bounds the rows, and a segment is
#: aligned once for each so many partitions.
LISTED = 12
_LOW = (1 << 32) - 1


class Aligner:
    """Segments to groups of ids of both vocabularies between common byte ends, and links of ids whose bytes overlap."""

    def __init__(self, byte_path: str | None = None, piece_path: str | None = None):
        self.a, self.bytes_a = byte_level(byte_path)
        self.b, pieces, self.cuts = piece_bpe(piece_path)
        held = {k: bytes([int(p[3:-1], 16)]) for k, p in enumerate(pieces) if self.b.is_byte(k)}
        self.bytes_b = [held.get(k, p.replace("▁", " ").encode()) for k, p in enumerate(pieces)]
        # A line end before a segment shields it from the space that the encoder puts in front: it joins nothing.
        self.shield = len(self.b.encode("\n"))
        if any("\n" in p for k, p in enumerate(pieces) if k not in held):
            raise ValueError("the vocabulary joins line ends to other characters")

    def ids(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        found = self.b.encode(["\n" + s for s in segments], num_threads=1)
        return list(map(self.a.encode_ordinary, segments)), [x[self.shield :] for x in found]

    def align(self, segments: list[str]) -> list[tuple[bool, int, int, int, str, list[int]]]:
        """(valid, ids of a, ids of b, groups, their text, links as a * 2^32 + b) of each; not valid: the bytes of a or b differ."""
        bytes_a, bytes_b = self.bytes_a, self.bytes_b
        out = []
        for s, a, b in zip(segments, *self.ids(segments), strict=True):
            parts_a, parts_b = [bytes_a[i] for i in a], [bytes_b[i] for i in b]
            raw = s.encode("utf-8", "surrogatepass")
            if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
                out.append((False, 0, 0, 0, "", []))
                continue
            links, groups = [], []
            i = j = end_a = end_b = from_a = from_b = 0
            end_a, end_b = len(parts_a[0]), len(parts_b[0])
            while True:
                links.append(a[i] << 32 | b[j])
                step_a, step_b = end_a <= end_b, end_b <= end_a
                i += step_a
                j += step_b
                if step_a and step_b:
                    groups.append(f"{','.join(map(str, a[from_a:i]))}|{','.join(map(str, b[from_b:j]))}")
                    if i == len(a):
                        break
                    from_a, from_b = i, j
                if step_a:
                    end_a += len(parts_a[i])
                if step_b:
                    end_b += len(parts_b[j])
            out.append((True, len(a), len(b), len(groups), ";".join(groups), links))
        return out


_loaded: list[Aligner] = []


def _aligner() -> Aligner:
    if not _loaded:
        _loaded.append(Aligner())
    return _loaded[0]


CODED = "block long, doc_id long, codes binary, local int, segment string, n long"


def code(docs: DataFrame, make: Callable[[], Aligner] = _aligner, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs(doc_id, text) -> rows of documents (block, doc_id, codes) and of a block's distinct segments (block, local, segment, n).

    A document is space + text; codes are its segments' local numbers, compressed, none for null and empty texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, press = splitter(make().cuts), zstandard.ZstdCompressor(1)
        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.string(), pa.int64()]
        names = ["block", "doc_id", "codes", "local", "segment", "n"]
        ids: list[int | None] = []
        codes: list[bytes] = []
        number: dict[str, int] = {}
        counts = np.zeros(1024, np.int64)
        chars = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(ids), 8192):
                d = min(8192, len(ids) - at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d, block)), pa.array(ids[at : at + d], pa.int64()), pa.array(codes[at : at + d], pa.binary()), *[pa.nulls(d, t) for t in types[3:]]], names=names)
            segments = list(number)
            for at in range(0, len(segments), 8192):
                part = segments[at : at + 8192]
                d = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d, block)), *[pa.nulls(d, t) for t in types[1:3]], pa.array(np.arange(at, at + d), pa.int32()), pa.array(part, pa.string()), pa.array(counts[at : at + d], pa.int64())], names=names)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                for key, text in zip(*[c.to_pylist() for c in b.slice(at, 256).columns], strict=True):
                    if chars and chars + len(text or "") > block_chars:
                        yield from flush()
                        block += 1
                        ids, codes, number, counts, chars = [], [], {}, np.zeros(1024, np.int64), 0
                    parts = split(" " + text) if text else []
                    for s in set(parts).difference(number):
                        number[s] = len(number)
                    ids.append(key)
                    own = np.fromiter(map(number.__getitem__, parts), np.int32, len(parts))
                    if len(number) > len(counts):
                        counts = np.concatenate((counts, np.zeros(len(number), np.int64)))
                    np.add.at(counts, own, 1)
                    codes.append(press.compress(_planes(own)))
                    chars += len(text or "") + 1
        yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, CODED)


PLACES = "array<struct<block: long, local: int>>"


def align_segments(segments: DataFrame, make: Callable[[], Aligner] = _aligner) -> DataFrame:
    """segments(segment, n, places) -> (n, places, valid, n_a, n_b, n_groups, groups, links), a row for each row."""

    schema = f"n long, places {PLACES}, valid boolean, n_a long, n_b long, n_groups long, groups string, links array<long>"
    types = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
    names = ["n", "places", "valid", "n_a", "n_b", "n_groups", "groups", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
            done = zip(*make().align(b.column(0).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *[pa.array(c, t) for c, t in zip(done, types, strict=True)]], names=names)

    return segments.select("segment", "n", "places").mapInArrow(run, schema)


def _lost(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs(block, doc_id, codes) with the bad local numbers of their blocks -> (block, doc_id, codes, lost): documents that hold one lose all codes, and `lost` has them."""

    def run(block: list, doc_id: list, codes: list, gone: list) -> list:
        press = zstandard.ZstdCompressor(1)
        none, kept, lost = press.compress(b""), [], []
        for c, g in zip(codes, gone, strict=True):
            own = _codes(c)
            hit = g is not None and bool(np.isin(own, np.array(g, np.int32)).any())
            kept.append(none if hit else c)
            lost.append(own.tolist() if hit else None)
        return [block, doc_id, kept, lost]

    rows = docs.join(bad.withColumnRenamed("block", "_b"), F.col("block") == F.col("_b"), "left").select("block", "doc_id", "codes", "_bad")
    return map_rows(rows, run, "block long, doc_id long, codes binary, lost array<int>")


def _planes(codes: np.ndarray) -> bytes:
    """The low bytes of all numbers, then the next ones, and so on: they compress better apart."""
    return np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _codes(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompressobj().decompress(packed), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4")[:, 0]


def _without_invalid(rows: DataFrame, aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that hold an invalid segment lose their codes, and their segments those occurrences."""
    bad = aligned.where("not valid").select(F.inline("places")).groupBy("block").agg(F.collect_set("local").alias("_bad"))
    marked = materialise(_lost(rows, bad), "marked")
    lost = marked.where("lost is not null").select("block", F.explode("lost").alias("local")).groupBy("block", "local").agg(F.count(F.lit(1)).alias("lost"))
    lost = aligned.select(F.col("id").alias("_id"), F.inline("places")).join(lost, ["block", "local"]).groupBy("_id").agg(F.sum("lost").alias("lost"))
    aligned = aligned.join(lost, F.col("id") == F.col("_id"), "left").withColumn("n", F.col("n") - F.coalesce("lost", F.lit(0))).drop("_id", "lost")
    return marked.select("block", "doc_id", "codes"), materialise(aligned, "counted")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """aligned segments -> (link, count, best): how many links of the corpus hold the pair, and whether none of its b id is in more."""
    pairs = materialise(aligned.where("n > 0").select(F.explode("links").alias("link"), "n").groupBy("link").agg(F.sum("n").alias("count")), "pairs")
    most = pairs.groupBy(F.col("link").bitwiseAND(F.lit(_LOW)).alias("_b")).agg(F.max("count").alias("_most"))
    out = pairs.join(most, F.col("link").bitwiseAND(F.lit(_LOW)) == F.col("_b")).select("link", "count", (F.col("count") == F.col("_most")).cast("int").alias("best"))
    return materialise(out, "pair_counts")


NUMBERS = ["n_a", "n_b", "n_groups", "n_best", "count_sum"]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, local, NUMBERS, groups) -> (block, packed), a row for each block that a task has rows of, or several."""
    press = zstandard.ZstdCompressor(3)

    def flush(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(waiting)
        blocks = t.column(0).to_numpy()
        order = np.argsort(blocks, kind="stable")
        t, blocks = t.take(order), blocks[order]
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            part = t.slice(s, e - s)
            head = np.array([e - s], "<i8").tobytes() + part.column(1).to_numpy().astype("<i4").tobytes() + b"".join(part.column(2 + k).to_numpy().astype("<i8").tobytes() for k in range(5))
            yield pa.RecordBatch.from_arrays([pa.array([blocks[s]], pa.int64()), pa.array([press.compress(head + "\n".join(part.column(7).to_pylist()).encode())], pa.binary())], names=["block", "packed"])

    waiting, rows = [], 0
    for b in batches:
        waiting.append(b)
        rows += b.num_rows
        if rows >= PACKED:
            yield from flush(waiting)
            waiting, rows = [], 0
    if rows:
        yield from flush(waiting)


def _unpack(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(NUMBERS by local number, groups by local number) of a block's packed rows."""
    parts = []
    for p in packed:
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(p)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        parts.append((np.frombuffer(raw, "<i4", n, 8), np.frombuffer(raw, "<i8", 5 * n, 8 + 4 * n).reshape(5, n), raw[8 + 44 * n :].decode().split("\n")))
    size = 1 + max((int(p[0].max()) for p in parts), default=-1)
    values, groups = np.zeros((5, size), np.int64), np.full(size, "", object)
    for local, numbers, texts in parts:
        values[:, local] = numbers
        groups[local] = texts
    return values, groups


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, kind, doc_id, packed) of a block come together, its segments' first, then its documents."""
    block, packed = None, []
    values, groups = np.zeros((5, 0), np.int64), np.zeros(0, object)
    for b in batches:
        out: list[list] = [[] for _ in range(7)]
        size = 0
        for now, kind, key, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if now != block:
                block, packed = now, []
                values, groups = np.zeros((5, 0), np.int64), np.zeros(0, object)
            if kind == 0:
                packed.append(data)
                continue
            if packed:
                values, groups = _unpack(packed)
                packed = []
            codes = _codes(data)
            text = ";".join(groups[codes].tolist())
            for c, v in zip(out, (key, *(values[:, codes].sum(axis=1).tolist() if len(codes) else [0] * 5), text), strict=True):
                c.append(v)
            size += len(text)
            if size > 1 << 24:
                yield _result(out)
                out, size = [[] for _ in range(7)], 0
        if out[0]:
            yield _result(out)


def _result(cols: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 6 else pa.int64()) for k, c in enumerate(cols)], names=["doc_id", *NUMBERS, "groups"])


def align(docs: DataFrame, make: Callable[[], Aligner] = _aligner, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), a row a row.

    Ids are those of space + text. groups: `a ids|b ids` between bytes where ids of both end, joined by `;`. A link is a
    pair of an a and a b id whose bytes overlap; n_best: links whose pair is in no fewer links of the corpus than any
    other of its b id; count_sum: over links, the links of the corpus that hold the pair. Texts that are null, empty or
    come back from the ids with other bytes have no tokens: zeros and an empty string. Null ids and repeated rows stay,
    other columns are ignored, an empty table gives no rows.
    """
    coded = materialise(code(docs, make, block_chars), "coded", "zstd")
    listed = coded.where("segment is not null").groupBy("segment", F.shiftright("block", 32 + LISTED).alias("part")).agg(F.sum("n").alias("n"), F.collect_list(F.struct("block", "local")).alias("places"))
    aligned = materialise(align_segments(listed, make).withColumn("id", F.monotonically_increasing_id()), "aligned", "zstd")
    rows = materialise(coded.where("segment is null").select("block", "doc_id", "codes"), "codes")
    release(coded)
    if not aligned.where("not valid").isEmpty():
        rows, aligned = _without_invalid(rows, aligned)
    pairs = pair_counts(aligned)
    links = aligned.where("n > 0").select("id", F.explode("links").alias("_link"))
    scores = links.join(pairs, F.col("_link") == F.col("link")).groupBy(F.col("id").alias("_id")).agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    scored = aligned.drop("links").join(scores, F.col("id") == F.col("_id"), "left")
    back = scored.select(F.inline("places"), "n_a", "n_b", "n_groups", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups").mapInArrow(_pack, "block long, packed binary")
    lists = back.select("block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), "packed")
    texts = rows.select("block", F.lit(1).alias("kind"), "doc_id", F.col("codes").alias("packed"))
    dealt = lists.union(texts).repartition("block").sortWithinPartitions("block", "kind")
    out = dealt.mapInArrow(_compose, "doc_id long, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups string")
    return out.select("doc_id", "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"), "n_best", "count_sum", "groups")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(table(spark, sf_dir, "documents"))
    return out.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
