"""The strongest partners of each document by shared terms, exact, without listing all pairs.

A document's terms are ordered by rarity. Two documents first meet at their rarest shared term, and share no more terms
than either has from there on: its rest. So an index of terms in blocks of one rest, each with its least document id,
bounds what a block can offer. A bounded number of entries of each term gives every document some partners, and with
them the weight and id that a further partner has to beat; only blocks that can are then read. Documents of equal
term sets are one query and one entry of the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.tables import written

#: Entries of a term, by least id and by longest rest, that every document with the term looks at first.
SEEDS = 16


def _first(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; ranks are cut off before the shuffle too, so a hot key is no large group."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def term_sets(postings: DataFrame, heads: int) -> tuple[DataFrame, DataFrame]:
    """postings(kind, term, doc_id) -> (sets(sid, terms, heads), members(doc_id, sid)).

    terms: numbers of a document's shared terms, the rarest first; heads: the least ids of the documents with the set,
    `heads` at most. Terms of one document alone are left out, and so are documents without others.
    """
    own = written(postings.select(F.coalesce("kind", F.lit("")).alias("kind"), "term", F.col("doc_id").cast("long").alias("doc_id")).where("term is not null and doc_id is not null").distinct(), "postings")
    sizes = own.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("df")).where("df > 1").withColumn("t", F.monotonically_increasing_id())
    numbered = own.join(written(sizes, "terms"), ["kind", "term"]).select("doc_id", F.struct("df", "t").alias("term"))
    docs = numbered.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("term")), lambda x: x["t"]).alias("terms"))
    docs = written(docs, "documents")
    sets = written(docs.groupBy("terms").agg(F.min("doc_id").alias("head")).withColumn("sid", F.monotonically_increasing_id()), "sets")
    members = written(docs.join(sets.select("terms", "sid"), "terms").select("doc_id", "sid"), "members")
    few = _first(members, ["sid"], [F.col("doc_id")], heads).groupBy("sid").agg(F.array_sort(F.collect_list("doc_id")).alias("heads"))
    return written(sets.join(few, "sid").select("sid", "terms", "heads"), "headed"), members


def _weighed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(sid, other) -> with heads of the other and weight, the number of terms that both have."""
    a, b = sets.select("sid", F.col("terms").alias("_a")), sets.select(F.col("sid").alias("other"), F.col("terms").alias("_b"), "heads")
    return pairs.join(a, "sid").join(b, "other").select("sid", "other", F.size(F.array_intersect("_a", "_b")).cast("long").alias("weight"), "heads")


def _best(weighed: DataFrame, n: int) -> DataFrame:
    """(sid, partners): the n strongest documents as structs of negated weight and id, the strongest first."""
    rows = weighed.select("sid", (-F.col("weight")).alias("w"), F.explode("heads").alias("doc"))
    return _first(rows, ["sid"], [F.col("w"), F.col("doc")], n).groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("w", "doc"))).alias("partners"))


def strongest(postings: DataFrame, links: int = 15, seeds: int = SEEDS) -> DataFrame:
    """postings(kind, term, doc_id) -> (doc_id, related, weight, rank): each document's `links` partners with most shared terms, ties by id.

    Repeated postings count once; null terms and ids do not count; documents that share no term have no row. Exact:
    partners that the seeds do not show are looked for in all blocks that could hold a better one.
    """
    n = links + 1  # a document itself may be among the best of its set
    sets, members = term_sets(postings, n)
    size = F.size("terms")
    index = sets.select("sid", F.posexplode("terms").alias("_at", "t"), size.alias("_n"), F.col("heads")[0].alias("head"))
    index = written(index.select("sid", "t", (F.col("_n") - F.col("_at")).alias("rest"), "head").withColumn("block", F.floor(F.log2(F.greatest(F.abs("head"), F.lit(1)).cast("double"))).cast("int") * F.signum("head").cast("int")), "entries")
    least = _first(index, ["t"], [F.col("head"), F.col("sid")], max(seeds, n))
    longest = _first(index, ["t"], [F.desc("rest"), F.col("head"), F.col("sid")], seeds)
    shown = written(least.select("t", F.col("sid").alias("other")).union(longest.select("t", F.col("sid").alias("other"))).distinct(), "seeds")
    own = sets.select("sid", F.col("sid").alias("other"))
    seen = index.select("sid", "t").join(shown, "t").select("sid", "other").union(own).distinct()
    seen = written(_weighed(seen, sets), "seen")
    best = written(_best(seen, n), "first")
    last = F.get("partners", F.lit(links))  # null while there are fewer than n
    bar = best.select("sid", F.coalesce(-last["w"], F.lit(0)).alias("bar"), last["doc"].alias("bar_id"))
    blocks = written(index.groupBy("t", "rest", "block").agg(F.min("head").alias("least")), "blocks")

    def better(most: Column, head: str) -> Column:
        return (most > F.col("bar")) | ((most == F.col("bar")) & (F.col(head) < F.col("bar_id")))

    asked = index.select("sid", "t", F.col("rest").alias("mine")).join(bar, "sid")
    found = asked.where(F.col("mine") >= F.col("bar")).join(blocks, "t").where(better(F.least("mine", "rest"), "least"))
    found = written(found.select("sid", "t", "rest", "block", "mine", "bar", "bar_id"), "found")
    more = found.join(index.select(F.col("sid").alias("other"), "t", "rest", "block", "head"), ["t", "rest", "block"]).where(better(F.least("mine", "rest"), "head"))
    more = more.select("sid", "other").distinct().join(seen.select("sid", "other"), ["sid", "other"], "left_anti")
    more = _weighed(more, sets)
    best = written(_best(seen.unionByName(more), n), "best")
    rows = members.join(best, "sid").select("doc_id", F.slice(F.filter("partners", lambda x: x["doc"] != F.col("doc_id")), 1, links).alias("p"))
    return rows.select("doc_id", F.posexplode("p").alias("_at", "x")).select("doc_id", F.col("x.doc").alias("related"), (-F.col("x.w")).alias("weight"), (F.col("_at") + 1).alias("rank"))
