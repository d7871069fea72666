"""SimHash near-duplicates by covering locality-sensitive hashing.

Masks come from a random map of bit positions to vectors of radius + 1 bits: for each non-zero vector v, the mask
holds the positions whose vector has odd inner product with v. Any `radius` differing positions span at most
`radius` dimensions, so some v is orthogonal to all of them and that mask sees none of them: every pair within the
radius shares a bucket in some table, by construction and not by chance.

near_duplicates() links fingerprints alone. near_documents() takes the clusters that fingerprints of word pairs make
within a wider radius as candidates and links those texts whose five-word shingles are similar enough, by exact sets.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS, map_rows, materialise, table
from .components import connected_components

RADIUS = 4
SHINGLE = 4
BLOCK = 4096
#: Near documents: width and radius of the fingerprints that propose candidates, width and least Jaccard similarity of the shingles that decide.
PAIR = 2
PAIR_RADIUS = 6
WORDS = 5
SIMILARITY = 0.8
#: Code points of a cluster that one block holds on average.
BLOCK_CHARS = 1 << 24


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash over XXH64 (seed 42) of word shingles, as a signed long; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - width + 1)
    tails = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(data[s:e], 42) for s, e in zip(starts[:last].tolist(), tails.tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        part = h[i : i + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def masks(radius: int = RADIUS, bits: int = 64, seed: int = 7) -> list[int]:
    """2^(radius+1) - 1 covering masks as signed longs."""
    draw = random.Random(seed)
    side = 1 << (radius + 1)
    vectors = [draw.randrange(1, side) for _ in range(bits)]
    out = []
    for v in range(1, side):
        m = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _forest(fp: np.ndarray, rep: np.ndarray, label: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that join the labels of all pairs within the radius; each row is compared once with the labels not yet reached."""
    edges = []
    left = np.arange(len(fp))
    while len(left) > 1:
        start = label[left] == label[left[0]]
        front, left = left[start], left[~start]
        while len(front) and len(left):
            nxt = []
            for i in front.tolist():
                hit = left[np.bitwise_count(fp[left] ^ fp[i]) <= radius]
                if not len(hit):
                    continue
                names, at = np.unique(label[hit], return_index=True)
                edges += [(int(rep[i]), int(x)) for x in rep[hit[at]].tolist()]
                joined = np.isin(label[left], names)
                nxt.append(left[joined])
                left = left[~joined]
                if not len(left):
                    break
            front = np.concatenate(nxt) if nxt else left[:0]
    return edges


def _runs(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; a bucket may cross batches, and holds 2 * BLOCK rows at most."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held = None

    def flush(cols: list[np.ndarray]) -> pa.RecordBatch:
        keys, fp, label = cols
        cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        edges: list[tuple[int, int]] = []
        for s, e in zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(fp)])).tolist(), strict=True):
            if e - s > 1:
                edges += _forest(fp[s:e].view(np.uint64), fp[s:e], label[s:e], radius)
        edges = sorted(set(edges))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in edges], pa.int64()), pa.array([y for _, y in edges], pa.int64())], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, i, j, fp, label = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        cols = [np.stack([bucket, i.astype(np.int64), j.astype(np.int64)], axis=1), fp, label]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        keys = cols[0]
        change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
        if not len(change):
            held = cols
            continue
        at = int(change[-1]) + 1
        held = [c[at:] for c in cols]
        yield flush([c[:at] for c in cols])
    if held is not None and len(held[1]):
        yield flush(held)


def _fingerprint_edges(prints: DataFrame, radius: int, block: int, tables: slice) -> DataFrame:
    """prints(fp[, label]), one row per fingerprint -> (a, b): fingerprints within the radius that join the labels of every such pair.

    A bucket is a hash of table and masked fingerprint; two buckets of one hash are searched together, which loses
    nothing. Only bucket, fingerprint and label are dealt out. Buckets of one label give nothing.
    """
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labelled = "label" in prints.columns
    buckets = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in list(enumerate(masks(radius)))[tables]])
    own = ["fp", "label"] if labelled else ["fp"]
    rows = prints.select(*own).repartition(parts, "fp")  # a small table, of which much is made
    rows = rows.select(F.explode(buckets).alias("bucket"), *own)
    some = [F.min("label").alias("l0"), F.max("label").alias("l1")] if labelled else []
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *some).where("l0 < l1" if labelled else "n > 1")
    sizes = materialise(sizes.select(F.col("bucket").alias("_bucket"), F.ceil(F.col("n") / block).cast("int").alias("k")), "buckets")
    # counted with partial sums, and joined by sorting at every size: so hot buckets can be split, and plans do not change as tables grow
    rows = rows.join(sizes.hint("merge"), F.col("bucket") == F.col("_bucket"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
    label = F.col("label") if labelled else F.col("fp").alias("label")
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", label)
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "fp")
    return rows.mapInArrow(lambda it: _runs(it, radius), "a long, b long")


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """prints(fp long, rep long), one row per fingerprint -> (a, b): edges between reps that connect every pair within the radius.

    A bucket of more than `block` fingerprints is dealt over pairs of blocks, so no task gets more than 2 * block rows of it.
    """
    edges = _fingerprint_edges(prints.select("fp"), radius, block, slice(None)).select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    at = lambda side: prints.select(F.col("fp").alias(f"_{side}"), F.col("rep").alias(side))
    return edges.join(at("a"), "_a").join(at("b"), "_b").select("a", "b")


#: Masks of a first round of linking, after which buckets whose fingerprints are joined already give no more edges.
FIRST_TABLES = 8


def clusters(prints: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """prints(fp, rep) -> (fp, rep, label): label is the smallest rep that links reach. Two rounds: most pairs are joined by a few masks, the rest need all."""
    for part in (slice(FIRST_TABLES), slice(FIRST_TABLES, None)):
        edges = _fingerprint_edges(prints.drop("rep"), radius, block, part).select(F.col("a").alias("_a"), F.col("b").alias("_b"))
        named = prints if "label" in prints.columns else prints.withColumn("label", F.col("rep"))
        at = lambda side: named.select(F.col("fp").alias(f"_{side}"), F.col("label").alias(side))  # noqa: E731, B023
        comp = connected_components(edges.join(at("a"), "_a").join(at("b"), "_b").select("a", "b"))
        prints = named.join(comp, named["label"] == comp["node"], "left").select("fp", "rep", F.coalesce("component", "label").alias("label"))
        prints = materialise(prints, "labelled")
    return prints


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs -> (doc_id, _row, fp long, component_id): fingerprints link at `radius` or fewer differing bits.

    Null and empty texts have fingerprint 0 and link like any other. Rows with a null id get a fingerprint and no
    component. Equal fingerprints are collapsed before the search, so copies cost one row. _row: xxhash64 of the text.
    Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("_row"), F.col(text_col).alias("text"))
    fps = map_rows(rows, lambda ids, rows, texts: [ids, rows, [fingerprint(t) for t in texts]], "doc_id long, _row long, fp long")
    fps = materialise(fps, "fingerprints")
    prints = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    prints = materialise(prints, "prints")
    named = clusters(prints, radius).select(F.col("fp").alias("_fp"), F.col("label").alias("component_id"))
    return fps.join(named, fps.fp == F.col("_fp"), "left").select("doc_id", "_row", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the lower-cased word shingles; fewer words: of the whole sequence; no words: none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[k : k + width]), 7) for k in range(max(1, len(words) - width + 1))], np.uint64)) if words else np.zeros(0, np.uint64)


def _similar_forest(fp: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs within the radius whose sets are similar; two empty sets are alike.

    Each row is compared once with what is not yet reached, so a group of copies costs a comparison a row.
    """
    sizes = np.array([len(x) for x in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    marked = np.zeros(len(values) + 1, bool)
    edges = []
    left = np.arange(len(fp))
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            nxt = []
            for i in front.tolist():
                near = left[np.bitwise_count(fp[left] ^ fp[i]) <= radius]
                if not len(near):
                    continue
                mine = flat[ends[i] - sizes[i] : ends[i]]
                marked[mine] = True
                counts, at = sizes[near], np.concatenate(([0], np.cumsum(sizes[near])))
                where = np.arange(at[-1]) + np.repeat(ends[near] - sizes[near] - at[:-1], counts)
                common = np.diff(np.concatenate(([0], np.cumsum(marked[flat[where]])))[at])
                marked[mine] = False
                hit = near[common >= similarity * (sizes[i] + counts - common)]
                edges += [(i, j) for j in hit.tolist()]
                if len(hit):
                    nxt.append(hit)
                    left = left[~np.isin(left, hit, assume_unique=True)]
                    if not len(left):
                        break
            front = np.concatenate(nxt) if nxt else left[:0]
    return edges


def _verified(batches: Iterator[pa.RecordBatch], radius: int, similarity: float, width: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (cluster, i, j); of each such group the edges between similar texts."""
    key, fp, nodes, sets = None, [], [], []

    def close() -> pa.RecordBatch:
        edges = _similar_forest(np.array(fp, np.int64).view(np.uint64), sets, radius, similarity) if len(fp) > 1 else []
        out = pa.RecordBatch.from_arrays([pa.array([nodes[e[k]] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])
        for x in (fp, nodes, sets):
            x.clear()
        return out

    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        for c, i, j, f, node, text in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if (c, i, j) != key:
                if len(fp) > 1:
                    yield close()
                close()
                key = (c, i, j)
            fp.append(f)
            nodes.append(node)
            sets.append(shingles(text, width))
    yield close()


def near_documents(docs: DataFrame, similarity: float = SIMILARITY, width: int = WORDS, radius: int = PAIR_RADIUS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, _row, component_id, keeper): texts link if their fingerprints of word pairs differ in at most `radius` bits and their `width`-word shingles reach the similarity.

    component_id: smallest doc_id reachable; keeper: whether this is the component's first text by (doc_id, _row), the
    one to keep. Equal texts are one node, whatever their number; texts without a word are alike. Rows with a null id
    have no component and are keepers. _row: xxhash64 of the text. Repeated rows are treated alike. Other columns are
    ignored. A cluster of candidates is dealt over pairs of blocks by its size, so no task holds more than two blocks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_row"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), F.col("text").alias("text"))
    fps = map_rows(rows, lambda ids, rows, chars, texts: [ids, rows, chars, [fingerprint(t, PAIR) for t in texts]], "doc_id long, _row long, chars long, fp long")
    fps = materialise(fps, "fingerprints")
    nodes = fps.where("doc_id is not null").groupBy("_row").agg(F.min("fp").alias("fp"), F.min("chars").alias("chars"), F.min("doc_id").alias("first_id"))
    nodes = materialise(nodes, "texts")
    prints = materialise(nodes.groupBy("fp").agg(F.min("_row").alias("rep")), "prints")
    named = clusters(prints, radius).select(F.col("fp").alias("_fp"), F.col("label").alias("cluster"))
    member = materialise(nodes.join(named, nodes.fp == F.col("_fp")).select("_row", "fp", "chars", "first_id", "cluster"), "members")
    sizes = member.groupBy(F.col("cluster").alias("_cluster")).agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("total")).where("n > 1")
    sizes = materialise(sizes.select("_cluster", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("total") / block_chars)).cast("int").alias("k")), "clusters")
    member = member.join(sizes, F.col("cluster") == F.col("_cluster")).select("_row", "fp", "first_id", "cluster", "k")
    member = materialise(member, "candidates").withColumnRenamed("_row", "_node")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_t"), F.col("text").alias("text"))
    texts = texts.join(member, (F.col("_id") == F.col("first_id")) & (F.col("_t") == F.col("_node"))).select("cluster", "k", "fp", "_node", "text").dropDuplicates(["_node"])
    texts = texts.withColumn("own", F.pmod(F.xxhash64("_node"), F.greatest("k", F.lit(1))).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, greatest(k, 1) - 1)")))
    texts = texts.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "_node", "text")
    texts = texts.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    edges = materialise(texts.mapInArrow(lambda it: _verified(it, radius, similarity, width), "a long, b long"), "links")
    comp = connected_components(edges)
    named = nodes.join(comp, nodes["_row"] == comp.node, "left").select(F.col("_row").alias("_n"), "first_id", F.coalesce("component", "_row").alias("c"))
    named = materialise(named, "components")
    first = materialise(named.groupBy(F.col("c").alias("_c")).agg(F.min(F.struct("first_id", "_n")).alias("first")), "first")
    named = named.join(first, F.col("c") == F.col("_c")).select("_n", F.col("first.first_id").alias("_first"), F.col("first._n").alias("_kept"))
    out = fps.join(materialise(named, "named"), fps["_row"] == F.col("_n"), "left")
    has = F.col("doc_id").isNotNull()
    keeper = ~has | ((F.col("doc_id") == F.col("_first")) & (F.col("_row") == F.col("_kept")))
    return out.select("doc_id", "_row", F.when(has, F.col("_first")).alias("component_id"), keeper.alias("keeper"))


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """One document of each component of near_documents(): the first by doc_id, once if its row is repeated. Rows with a null id stay."""
    found = materialise(near_documents(docs, **kw).where("doc_id is not null").groupBy("doc_id", "_row").agg(F.first("keeper").alias("keeper"), F.count(F.lit(1)).alias("n")), "keepers")
    named = found.where("not keeper or n > 1").select(F.col("doc_id").alias("_cv_id"), F.col("_row").alias("_cv_row"), F.col("keeper").alias("_cv_keeper"))
    same = (docs["doc_id"].cast("long") == F.col("_cv_id")) & (F.xxhash64(docs["text"]) == F.col("_cv_row"))
    out = docs.join(named, same, "left_anti")
    repeated = named.where("_cv_keeper")
    if repeated.isEmpty():
        return out
    return out.union(docs.join(repeated, same).dropDuplicates(["_cv_id", "_cv_row"]).select(*docs.columns))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
