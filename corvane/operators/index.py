"""Inverted indexes over documents, their incremental merge, search and the co-occurrence graph."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.tables import written


#: Ids that a join may send to every task; more are merged, since a small file of ids is a large table in the driver's memory.
FEW = 1 << 16


def ids(rows: DataFrame, name: str) -> DataFrame:
    """Rows of ids, written; joins with many of them do not broadcast them."""
    out = written(rows, name)
    return out if out.count() <= FEW else out.hint("merge")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id) of several rows, written: mostly none, so that joins with it move no texts. Ids that are null are not among them."""
    return ids(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id"), "repeated")


def keywords(docs: DataFrame, min_length: int = 4, min_count: int = 5, unique: bool = False) -> DataFrame:
    """docs(doc_id, text) -> (keyword, doc_id, frequency): lower-cased letter tokens of a length and frequency; unique: no id has several rows.

    A text that has its id alone settles in its row which words are frequent, so no others are shuffled; words of the
    other texts are counted over all rows of their id.
    """
    tokens = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: F.length(x) >= min_length)
    more = max(min_count, 1) - 1
    frequent = F.transform(F.array(F.sort_array(tokens)), lambda a: F.filter(a, lambda x, i: x == F.get(a, i + more)))  # a word is left out `more` times
    counted = lambda rows, words, n: rows.select("doc_id", F.explode(words).alias("keyword")).groupBy("keyword", "doc_id").agg((F.count(F.lit(1)) + n).alias("frequency"))
    if unique:
        return counted(docs, frequent[0], more)
    several = repeated(docs)
    alone = docs.where("doc_id is not null").join(several, "doc_id", "left_anti")
    others = docs.join(several, "doc_id", "left_semi").select("doc_id", "text").union(docs.where("doc_id is null").select("doc_id", "text"))
    return counted(alone, frequent[0], more).union(counted(others, tokens, 0).where(F.col("frequency") >= min_count))


#: Document ids that one row of a posting list covers, so that a common word's list is many rows and none is unbounded.
BLOCK_IDS = 1024


def posting_lists(postings: DataFrame, key: str, ids: int = BLOCK_IDS) -> DataFrame:
    """(key, block, documents): the sorted documents of a key as text, a row for each range of `ids` document ids."""
    block = F.floor(F.col("doc_id") / ids).alias("block")
    return postings.groupBy(key, block).agg(F.array_join(F.array_sort(F.collect_set("doc_id")).cast("array<string>"), ",").alias("documents"))


def keyword_totals(postings: DataFrame) -> DataFrame:
    """(keyword, frequency, document_count)."""
    return postings.groupBy("keyword").agg(F.sum("frequency").alias("frequency"), F.count(F.lit(1)).alias("document_count"))


def keyword_index(postings: DataFrame) -> DataFrame:
    """(keyword, frequency, document_count, block, documents): totals with the posting lists."""
    return keyword_totals(postings).join(posting_lists(postings, "keyword"), "keyword")


def concept_index(mentions: DataFrame) -> DataFrame:
    """mentions(concept, doc_id, definition, importance, ord) -> last definition that is there, greatest importance, mentions and documents; posting_lists() has which ones."""
    return mentions.groupBy("concept").agg(
        F.max_by("definition", F.when(F.col("definition").isNotNull(), F.col("ord"))).alias("definition"), F.max("importance").alias("importance"),
        F.count(F.lit(1)).alias("mention_count"), F.count_distinct("doc_id").alias("document_count"),
    )


def entity_index(postings: DataFrame) -> DataFrame:
    """postings(type, name, doc_id, count) -> counts by entity, and by type where name is null."""
    return postings.rollup("type", "name").agg(F.sum("count").alias("count"), F.count_distinct("doc_id").alias("document_count"), F.grouping("name").alias("is_total")).where("type is not null")


# fixed values: surnames, words that no person's name holds, and patterns of terms
SURNAMES = (
    "王李张刘陈杨黄赵周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白"
    "崔康毛邱秦江史顾侯邵孟龙万段漕钱汤尹黎易常武乔贺赖龚文庞樊兰殷施陶洪翟安颜倪严牛温芦季俞鲁葛伍韦申尤毕聂丛焦向柳邢骆"
)
NO_NAMES = "中国|人民|社会|国家|历史|哲学|科学"
TERMS = [r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+", r"[\x{4e00}-\x{9fff}]{2,6}(?:观|论|说|学|主义|思想|理论|方法|原则|范畴|概念)", r"《[^》]{2,20}》"]
WORK = r"《([^》]+)》"


def mentions(paragraphs: DataFrame, types: tuple[str, ...] = ("person", "term", "work")) -> DataFrame:
    """paragraphs(doc_id, text) -> (doc_id, type, name), a row a mention of these types: persons are windows of a surname and one or two CJK characters, whole ones only; terms and works are of 2 to 20 characters."""
    t = F.col("text")
    at = F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1)))
    windows = F.concat(F.transform(at, lambda i: F.substring(t, i, F.lit(2))), F.transform(at, lambda i: F.substring(t, i, F.lit(3))))
    persons = F.filter(windows, lambda x: x.rlike(f"^[{SURNAMES}][\\x{{4e00}}-\\x{{9fff}}]{{1,2}}$") & ~x.rlike(NO_NAMES))
    persons = F.when(t.rlike(r"[\x{4e00}-\x{9fff}]"), persons).otherwise(F.array().cast("array<string>"))  # most texts have none; a range is told at once, a long list of characters is not
    terms = F.concat(*[F.regexp_extract_all(t, F.lit(p), 0) for p in TERMS])
    fits = lambda x: F.length(x).between(2, 20)
    kinds = F.array(*[F.struct(F.lit(k).alias("type"), v.alias("names")) for k, v in (("person", persons), ("term", F.filter(terms, fits)), ("work", F.filter(F.regexp_extract_all(t, F.lit(WORK), 1), fits))) if k in types])
    return paragraphs.select("doc_id", F.inline(kinds)).select("doc_id", "type", F.explode("names").alias("name"))


# fixed values: least count and most entities per document of each type
LIMITS = {"person": (2, 30), "term": (2, 50), "work": (1, 30)}


def document_entities(mentions: DataFrame, limits: dict[str, tuple[int, int]] = LIMITS) -> DataFrame:
    """mentions(doc_id, type, name) -> (doc_id, type, name, count, rank): counts over the type's threshold, the best of each document."""
    per = mentions.groupBy("doc_id", "type", "name").agg(F.count(F.lit(1)).alias("count"))
    least, most = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, (a, b) in limits.items():
        least, most = F.when(F.col("type") == k, a).otherwise(least), F.when(F.col("type") == k, b).otherwise(most)
    w = Window.partitionBy("doc_id", "type").orderBy(F.desc("count"), "name")
    return per.where(F.col("count") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def purge(postings: DataFrame, gone: DataFrame) -> DataFrame:
    """Postings without those of removed or changed documents; terms that lose all of them go."""
    return postings.join(gone.select("doc_id").distinct(), "doc_id", "left_anti")


def merge_postings(old: DataFrame, new: DataFrame, removed: DataFrame) -> DataFrame:
    """Incremental update equal to a rebuild: the postings of removed and of renewed documents go before the new ones come."""
    return purge(old, removed.select("doc_id").union(new.select("doc_id"))).unionByName(new)


def search(index: DataFrame, column: str, query: str, order: list, n: int = 10, ignore_case: bool = True) -> DataFrame:
    """The first n rows whose column contains the query."""
    hit = F.contains(F.lower(column), F.lit(query.lower())) if ignore_case else F.contains(F.col(column), F.lit(query))
    return index.where(hit).orderBy(*order).limit(n)


def top(index: DataFrame, metric: str, key: str, n: int) -> DataFrame:
    return index.orderBy(F.desc(metric), key).limit(n)


def relations(postings: DataFrame, max_df: int | None = None, details: int = 10, block: int = 2000) -> DataFrame:
    """postings(kind, term, doc_id) -> (source, target, type, weight, details): documents that share terms of a kind, the smaller id first.

    weight: all shared terms; details: the first of them by name. The join runs on terms, and a term of many documents
    is dealt over pairs of blocks, so no task meets more than `block` documents of it on a side. The pairs of a term
    grow with the square of its documents; max_df leaves out terms of more documents than that.
    """
    own = postings.select(F.coalesce("kind", F.lit("")).alias("kind"), "term", "doc_id").where("term is not null and doc_id is not null").distinct()
    sizes = own.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1")
    if max_df is not None:
        sizes = sizes.where(F.col("_df") <= max_df)
    own = own.join(sizes.withColumn("_k", F.ceil(F.col("_df") / block).cast("int")), ["kind", "term"])
    own = own.withColumn("_own", F.pmod(F.xxhash64("doc_id"), F.col("_k")).cast("int"))
    a = own.select("kind", "term", F.col("doc_id").alias("a"), F.col("_own").alias("i"), F.explode(F.expr("sequence(_own, _k - 1)")).alias("j"))
    b = own.select("kind", "term", F.col("doc_id").alias("b"), F.explode(F.expr("sequence(0, _own)")).alias("i"), F.col("_own").alias("j"))
    pairs = a.join(b, ["kind", "term", "i", "j"]).where("i < j or a < b")
    pairs = pairs.groupBy(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), F.col("kind").alias("type"))
    return pairs.agg(F.count(F.lit(1)).alias("weight"), F.array_join(F.slice(F.array_sort(F.collect_list("term")), 1, details), ",").alias("details"))


#: Classes of a block, whose terms a task compares with those of another block, and rows of shared terms that it holds at a time.
CLASSES = 1024
HELD = 1 << 21
#: A task takes up to DEALT such blocks a side, each with each, as long as MANY parts of the classes are left; copies of classes that are shuffled fall with it.
DEALT, MANY = 8, 32
#: Where the join on terms has at least one row for so many pairs of classes, all pairs are looked at in blocks instead.
SPARSE = 8


def class_relations(postings: DataFrame, details: int = 10, block: int = CLASSES, sparse: float = SPARSE) -> DataFrame:
    """The relations(postings) of classes, which are documents of equal terms of a kind, named by their smallest id: (source, target, type, weight, details, same).

    A row with same = false relates two classes and stands for all pairs of their documents, which have the same weight
    and details; one with same = true relates a class (source) with another of its documents (target). No relation is lost:
    two documents are related as their classes are, or, in one class, by all of its terms.
    """
    own = postings.select(F.coalesce("kind", F.lit("")).alias("kind"), "term", "doc_id").where("term is not null and doc_id is not null").distinct()
    sets = written(own.groupBy("kind", "doc_id").agg(F.array_sort(F.collect_list("term")).alias("terms")), "sets")
    classes = written(sets.groupBy("kind", "terms").agg(F.min("doc_id").alias("class")), "classes")
    members = sets.join(classes, ["kind", "terms"]).where("doc_id <> class")
    members = members.select(F.col("class").alias("source"), F.col("doc_id").alias("target"), F.col("kind").alias("type"), F.size("terms").cast("long").alias("weight"), F.array_join(F.slice("terms", 1, details), ",").alias("details"), F.lit(True).alias("same"))
    rows = classes.select("kind", F.explode("terms").alias("term")).groupBy("kind", "term").agg(F.count(F.lit(1)).alias("_df")).groupBy("kind").agg(F.sum(F.col("_df") * F.col("_df")).alias("_rows"))
    dense = classes.groupBy("kind").agg(F.count(F.lit(1)).alias("_n")).join(rows, "kind").where(F.col("_rows") * sparse >= F.col("_n") * F.col("_n"))
    parts = F.greatest(F.least(F.ceil(F.col("_n") / block), F.lit(MANY)), F.ceil(F.col("_n") / (block * DEALT)))
    dense = written(dense.select("kind", parts.cast("int").alias("_k")), "dense")
    others = classes.join(dense, "kind", "left_anti").select("kind", F.explode("terms").alias("term"), F.col("class").alias("doc_id"))
    pairs = _in_blocks(classes.join(dense, "kind"), details, block).union(relations(others, details=details))
    return pairs.withColumn("same", F.lit(False)).union(members)


def _in_blocks(classes: DataFrame, details: int, block: int) -> DataFrame:
    """classes(kind, class, terms, _k) -> relations() of a kind's classes, dealt over pairs of _k parts: what is shuffled are classes, and a pair's terms meet in one task, which gives out the relations of `block` classes a side at a time."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def shared(left: pa.Table, right: pa.Table, once: bool) -> pa.Table:
        ids = left["class"].type
        schema = pa.schema([("source", ids), ("target", ids), ("type", pa.string()), ("weight", pa.int64()), ("details", pa.string())])
        x, y = (t["class"].to_numpy() for t in (left, right))
        (lists, size), (others, sizes) = ((v.flatten(), np.asarray(pc.list_value_length(v))) for v in (t["terms"].combine_chunks() for t in (left, right)))
        both = pa.concat_arrays([lists, others]).dictionary_encode()
        order = np.argsort(words := np.array(both.dictionary.to_pylist(), object))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        terms, words = rank[np.asarray(both.indices)], pa.array(words[order], pa.string())
        mine, theirs = terms[: len(lists)], terms[len(lists) :]
        a, by_term = np.repeat(np.arange(len(x)), size), np.argsort(theirs, kind="stable")
        b = np.repeat(np.arange(len(y)), sizes)[by_term]
        df = np.bincount(theirs, minlength=len(words))
        start, n = (np.cumsum(df) - df)[mine], df[mine]  # each term of a left class meets n entries from start on
        bits = max(1, len(words)).bit_length()
        ends = np.cumsum(size)
        before = np.concatenate([[0], np.cumsum(n)])
        part = before[ends - size] // HELD  # left classes that are taken together
        found = []
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            lo, hi = ends[own[0]] - size[own[0]], ends[own[-1]]
            at = np.repeat(np.arange(lo, hi), n[lo:hi])
            right_one = b[np.arange(len(at)) - (before[at] - before[lo]) + start[at]]
            if once:
                keep = x[a[at]] < y[right_one]
                at, right_one = at[keep], right_one[keep]
            key = ((a[at] * len(y) + right_one) << bits) | mine[at]
            key.sort()
            pair, term = key >> bits, key & ((1 << bits) - 1)
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            weight = np.diff(first, append=len(pair))
            term = term[np.arange(len(pair)) - np.repeat(first, weight) < details]
            offsets = np.concatenate([[0], np.cumsum(np.minimum(weight, details))]).astype(np.int32)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words.take(pa.array(term))), ",")
            one, two = x[pair[first] // len(y)], y[pair[first] % len(y)]
            found.append(pa.table([pa.array(np.minimum(one, two), ids), pa.array(np.maximum(one, two), ids), pa.repeat(left["kind"][0], len(first)), pa.array(weight), text], schema=schema))
        return pa.concat_tables(found or [schema.empty_table()])

    def related(batches):
        both = pa.Table.from_batches(batches)
        same = both["i"][0] == both["j"][0]
        left = both.filter(both["first"])
        right = left if same else both.filter(pc.invert(both["first"]))
        for i in range(0, len(left), block):
            for j in range(i if same else 0, len(right), block):
                yield from shared(left.slice(i, block), right.slice(j, block), same and i == j).to_batches()

    related.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}  # in and out one by one
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work: not to be taken together
    dealt = classes.withColumn("_own", F.pmod(F.xxhash64("class"), F.col("_k")).cast("int")).select("kind", "class", "terms", "_own", F.explode(F.expr("sequence(0, _k - 1)")).alias("_other"))
    dealt = dealt.select("kind", "class", "terms", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), (F.col("_own") <= F.col("_other")).alias("first"))
    ids = classes.schema["class"].dataType.simpleString()
    return dealt.repartition(parts, "kind", "i", "j").groupBy("kind", "i", "j").applyInArrow(related, f"source {ids}, target {ids}, type string, weight bigint, details string")


#: Classes of a block whose relations are counted, and terms of them all; classes and terms that bit sets hold, and bytes of bit sets that are joined at a time.
COUNTED, COUNTED_TERMS = 16384, 1 << 20
BITS, BITS_TERMS = 4096, 1 << 16
JOINED = 1 << 23


def relation_count(postings: DataFrame, block: int = COUNTED) -> DataFrame:
    """One row: relation_count, the rows that relations(postings) has.

    Documents of equal shared terms of a kind are one class, and classes are dealt over pairs of blocks. There a term has
    the classes of a block as bits, and what a class is related with are the bits of its terms, joined: no pairs are made.
    """
    own = postings.select(F.coalesce("kind", F.lit("")).alias("kind"), "term", "doc_id").where("term is not null and doc_id is not null").distinct()
    own = written(own, "postings")
    terms = own.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1")
    terms = written(terms.select("kind", "term", F.monotonically_increasing_id().alias("_id")), "terms")
    sets = own.join(terms, ["kind", "term"]).groupBy("kind", "doc_id").agg(F.sort_array(F.collect_list("_id")).alias("terms"))
    classes = written(sets.groupBy("kind", "terms").agg(F.count(F.lit(1)).alias("n")), "classes")
    blocks = classes.groupBy("kind").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum(F.size("terms")) / COUNTED_TERMS)).cast("int").alias("_k"))
    dealt = classes.join(blocks, "kind").withColumn("_own", F.pmod(F.xxhash64("terms"), F.col("_k")).cast("int"))
    dealt = dealt.select("kind", "terms", "n", "_own", F.explode(F.expr("sequence(0, _k - 1)")).alias("_other"))
    dealt = dealt.select("kind", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), (F.col("_own") <= F.col("_other")).alias("first"), "terms", "n")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work: not to be taken together
    counts = dealt.repartition(parts, "kind", "i", "j").groupBy("kind", "i", "j").applyInArrow(_related, "n long")
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("relation_count"))


def _related(both):
    """both(first, terms, n, i, j), classes of two blocks -> one row: how many pairs of their documents have a term in common; of one block: each pair once."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def entries(t: pa.Table):
        lists = t["terms"].combine_chunks()
        return lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), t["n"].to_numpy()

    once = both["i"][0] == both["j"][0]
    terms, size, n = entries(both.filter(both["first"]))
    theirs, sizes, m = (terms, size, n) if once else entries(both.filter(pc.invert(both["first"])))
    words, code = np.unique(np.concatenate([terms, theirs]), return_inverse=True)
    mine, theirs = code[: len(terms)], code[len(terms) :]
    owner, rank = np.repeat(np.arange(len(m)), sizes), np.empty(len(m), np.int64)
    rank[order := np.argsort(m, kind="stable")] = np.arange(len(m))  # classes of one document lie together
    at, m, before = rank[owner], m[order], np.concatenate([[0], np.cumsum(sizes[order])])
    ends, total, hi = np.cumsum(size), 0, 0
    while hi < len(m):
        lo, hi = hi, min(hi + BITS, max(hi + 1, int(np.searchsorted(before, before[hi] + BITS_TERMS, side="right")) - 1))
        here = (at >= lo) & (at < hi)
        known, row = np.unique(theirs[here], return_inverse=True)
        width, bit = -(-(hi - lo) // 64), at[here] - lo
        bits = np.zeros((len(known), width), np.uint64)
        np.bitwise_or.at(bits, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        many = np.zeros(width * 64, np.int64)
        many[: hi - lo] = m[lo:hi]
        planes = [(p, np.packbits((many >> p & 1).astype(np.uint8), bitorder="little").view("<u8")) for p in range(int(many.max()).bit_length())]
        place = np.full(len(words), -1)
        place[known] = np.arange(len(known))
        place = place[mine]
        hit = np.flatnonzero(place >= 0)  # entries of terms that the bits know
        left = np.searchsorted(ends, hit, side="right")
        step = max(1, JOINED // (width * 8))
        starts = np.flatnonzero(np.diff(left, prepend=-1))
        at_start = 0
        while at_start < len(starts):  # as many whole classes as fit, one at least
            stop = max(int(np.searchsorted(starts, starts[at_start] + step, side="right")) - 1, at_start + 1)
            end = starts[stop] if stop < len(starts) else len(hit)
            cut = starts[at_start:stop]
            joined = np.bitwise_or.reduceat(bits[place[hit[cut[0] : end]]], cut - cut[0], axis=0)
            found = sum(np.bitwise_count(joined & plane).sum(axis=1, dtype=np.int64) << p for p, plane in planes)
            total += int((found * n[left[cut]]).sum())
            at_start = stop
    return pa.table({"n": pa.array([(total - int(n.sum())) // 2 if once else total], pa.int64())})


def relations_of(postings: DataFrame, docs: DataFrame, details: int = 10, block: int = 2000) -> DataFrame:
    """The rows of relations(postings) of which a document is in docs(doc_id): what new or changed documents add to a collection.

    Only terms of those documents are joined, and a term's new documents meet all others of it, block by block; so the
    work follows the change and not the square of a term's documents.
    """
    own = postings.select(F.coalesce("kind", F.lit("")).alias("kind"), "term", "doc_id").where("term is not null and doc_id is not null").distinct()
    new = own.join(docs.select("doc_id"), "doc_id", "left_semi")
    touched = own.join(new.select("kind", "term").distinct(), ["kind", "term"], "left_semi")
    sizes = touched.groupBy("kind", "term").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_k"))
    a = new.join(sizes, ["kind", "term"]).select("kind", "term", F.col("doc_id").alias("a"), F.explode(F.expr("sequence(0, _k - 1)")).alias("j"))
    b = touched.join(sizes, ["kind", "term"]).select("kind", "term", F.col("doc_id").alias("b"), F.pmod(F.xxhash64("doc_id"), F.col("_k")).cast("int").alias("j"))
    pairs = a.join(b, ["kind", "term", "j"]).where("a <> b").select(F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), F.col("kind").alias("type"), "term").distinct()
    return pairs.groupBy("source", "target", "type").agg(F.count(F.lit(1)).alias("weight"), F.array_join(F.slice(F.array_sort(F.collect_list("term")), 1, details), ",").alias("details"))


def merge_relations(old: DataFrame, postings: DataFrame, new: DataFrame, gone: DataFrame) -> DataFrame:
    """Relations after a change, equal to relations(postings) of all documents: those between untouched documents stay, those of new(doc_id) come anew, those of gone(doc_id) go."""
    new = ids(new.select("doc_id").distinct(), "new")
    touched = ids(new.union(gone.select("doc_id")).distinct(), "touched")
    postings = written(postings.select("kind", "term", "doc_id"), "postings")
    kept = old.join(touched.withColumnRenamed("doc_id", "source"), "source", "left_anti").join(touched.withColumnRenamed("doc_id", "target"), "target", "left_anti")
    return kept.select("source", "target", "type", "weight", "details").unionByName(relations_of(postings, new))


def related(edges: DataFrame, links: int = 15) -> DataFrame:
    """(doc_id, related, weight, rank): the strongest partners of each document, over all kinds of relations."""
    edges = edges.groupBy("source", "target").agg(F.sum("weight").alias("weight"))
    both = edges.select(F.col("source").alias("doc_id"), F.col("target").alias("related"), "weight").union(edges.select(F.col("target"), F.col("source"), "weight"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "related")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= links)


def catalog(docs: DataFrame, index: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts and the best keywords; edges: relations, or their relation_count alone."""
    best = top(index, "frequency", "keyword", 20).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("frequency")).alias("f"), "keyword"))), lambda x: x["keyword"]), ",").alias("top_keywords"))
    related = edges if edges.columns == ["relation_count"] else edges.agg(F.count(F.lit(1)).alias("relation_count"))
    counts = docs.agg(F.count(F.lit(1)).alias("document_count")).join(index.agg(F.count(F.lit(1)).alias("keyword_count"))).join(related)
    return counts.join(best)  # single rows


def log_tail(log: DataFrame, n: int = 5) -> DataFrame:
    return log.orderBy(F.desc("version")).limit(n)
