"""One-to-one matching of names within listings: scores in SQL, greedy consumption in order, strategy cascade.

Inputs have a column name and may have a column listing; names meet within their listing alone.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from corvane.functions.ratio import fits, likely, pair_of, ratios
from corvane.functions.text import name_numbers, name_tokens
from corvane.sources.tables import written

PAIRS = ["listing", "l", "r", "score"]


def _named(names: DataFrame, side: str) -> DataFrame:
    listing = F.coalesce("listing", F.lit("")) if "listing" in names.columns else F.lit("")
    return names.select(listing.alias("listing"), F.col("name").alias(side)).where("name is not null")


def number_scores(left: DataFrame, right: DataFrame) -> DataFrame:
    """(listing, l, r, score) by numbers in names: equal last numbers 1.0, the left's last one among the right's 0.8. Joined on the number, not on all pairs."""
    a = _named(left, "l").select("listing", "l", F.try_element_at(name_numbers(F.col("l")), F.lit(-1)).alias("_n")).where("_n is not null")
    b = _named(right, "r").select("listing", "r", F.try_element_at(name_numbers(F.col("r")), F.lit(-1)).alias("_last"), F.explode(F.array_distinct(name_numbers(F.col("r")))).alias("_n"))
    return a.join(b, ["listing", "_n"]).select("listing", "l", "r", F.when(F.col("_last") == F.col("_n"), 1.0).otherwise(0.8).alias("score"))


def token_scores(left: DataFrame, right: DataFrame, least: float = 0.3) -> DataFrame:
    """(listing, l, r, score) by Jaccard similarity of name tokens over `least`; pairs come from shared tokens, repeated names count once."""
    a = _named(left, "l").distinct().select("listing", "l", name_tokens(F.col("l")).alias("_a"))
    b = _named(right, "r").distinct().select("listing", "r", name_tokens(F.col("r")).alias("_b"))
    shared = a.select("listing", "l", F.size("_a").alias("_na"), F.explode("_a").alias("_t")).join(b.select("listing", "r", F.size("_b").alias("_nb"), F.explode("_b").alias("_t")), ["listing", "_t"])
    both = shared.groupBy("listing", "l", "r", "_na", "_nb").agg(F.count(F.lit(1)).alias("_n"))
    score: Column = F.col("_n") / (F.col("_na") + F.col("_nb") - F.col("_n"))
    return both.select("listing", "l", "r", F.round(score, 6).alias("score")).where(F.col("score") > least)


def candidates(left: DataFrame, right: DataFrame, least: float = 0.5) -> DataFrame:
    """(listing, l, r): all pairs whose characters allow a ratio over `least`, found by an equi-join.

    No more can match than two names have characters in common, so the ratio is over `least` only if the common ones
    are over least / 2 of both lengths' sum. A name of n characters can then miss its n - o rarest of the partner's,
    o being the fewest that a partner of any length must share: one of the n - o + 1 rarest characters of either name,
    repeats counted apart, is among the other's. Pairs meet there, and their lengths and common characters decide.
    """
    return _met(*_prefixes(_named(left, "l").distinct(), _named(right, "r").distinct(), least), least)


#: The most frequent characters (repeats counted apart) of which tasks get the frequency; all others count as rarest.
FREQUENT = 1 << 16


def _runs(name: str) -> list[str]:
    """Its characters, each with its number among the equal ones before it."""
    seen: dict[str, int] = {}
    out = []
    for x in name:
        k = seen[x] = seen.get(x, -1) + 1
        out.append(f"{x}{k}")
    return out


def _prefixes(a: DataFrame, b: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """a(listing, l), b(listing, r) -> (listing, l, _t) and (listing, r, _t): the rarest characters of each name, of which similar names share one.

    Any one order of characters for both sides would do; what is shuffled are characters with their counts, never those of each name.
    """
    import pyarrow as pa

    def counted(batches):
        for batch in batches:
            n = Counter(t for name in batch.column(0).to_pylist() for t in _runs(name))
            yield pa.record_batch([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["_t", "_n"])

    rare = a.select("l").union(b.select("r")).mapInArrow(counted, "_t string, _n bigint").groupBy("_t").agg(F.sum("_n").alias("_df"))
    often = {x["_t"]: x["_df"] for x in rare.orderBy(F.desc("_df"), "_t").limit(FREQUENT).collect()}

    def prefix(names: DataFrame, side: str) -> DataFrame:
        def first(batches):
            for batch in batches:
                found = []
                for name in batch[side].to_pylist():
                    n = len(name)
                    shortest = math.floor(n * least / (2 - least)) + 1
                    keep = n - (math.floor((n + shortest) * least / 2 - 1e-9) + 1) + 1
                    found.append(sorted(_runs(name), key=lambda t: (often.get(t, 0), t))[: max(keep, 1)])
                yield pa.record_batch([batch["listing"], batch[side], pa.array(found, pa.list_(pa.string()))], names=["listing", side, "_t"])

        return names.select("listing", side).mapInArrow(first, f"listing string, {side} string, _t array<string>").select("listing", side, F.explode("_t").alias("_t"))

    return prefix(a, "l"), prefix(b, "r")


def _met(x: DataFrame, y: DataFrame, least: float) -> DataFrame:
    """Pairs that meet in a row of both _prefixes() and have the lengths and common characters for a ratio over `least`; each once."""
    import numpy as np

    def possible(batches):
        for batch in batches:
            names = [batch[k].dictionary_encode() for k in ("l", "r")]
            i, j = (np.asarray(n.indices) for n in names)
            yield batch.filter(fits(*pair_of(*[n.dictionary.to_pylist() for n in names]), i, j, least))

    parts = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes a pair, but much work: not to be taken together
    pairs = x.join(y, ["listing", "_t"]).select("listing", "l", "r").repartition(parts, "listing", "l", "r").distinct()
    return pairs.mapInArrow(possible, "listing string, l string, r string")


#: Names of a side that are compared at once with as many of the other side, and how many such blocks of each side a group has: names are copied for each group, so few wide ones take less disk.
BLOCK = 512
WIDE = 2
#: Pairs of a listing from which on candidates() are tried, and how many pairs a block compares in the time of one row of their join.
MANY = 1 << 24
FASTER = 20


def _in_blocks(a: DataFrame, b: DataFrame, least: float, block: int) -> DataFrame:
    """a(listing, l), b(listing, r) -> scores over `least` of all pairs: a listing is dealt over pairs of blocks, so what is shuffled are names and not pairs."""
    import pyarrow as pa

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        at = [(x, y) for x in range(0, left.num_rows, block) for y in range(0, right.num_rows, block)]
        return pa.concat_tables([compared(left.slice(x, block), right.slice(y, block)) for x, y in at] or [compared(left, right)])

    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        ls, rs = left["l"].combine_chunks(), right["r"].combine_chunks()
        x, y = pair_of(ls.to_pylist(), rs.to_pylist())
        i, j = likely(x, y, least)
        s = ratios(x, y, i, j, least).round(6)
        i, j, s = i[s > least], j[s > least], s[s > least]
        listing = left["listing"].combine_chunks().take(pa.array(i * 0)) if len(i) else left["listing"].combine_chunks().slice(0, 0)
        return pa.table([listing, ls.take(pa.array(i)), rs.take(pa.array(j)), pa.array(s)], names=PAIRS)

    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = lambda names, n: names.groupBy("listing").agg(F.ceil(F.count(F.lit(1)) / (block * WIDE)).cast("int").alias(n))
    sizes = written(count(a, "_a").join(count(b, "_b"), "listing"), "blocks")

    def dealt(names: DataFrame, side: str, own: str, other: str) -> GroupedData:
        mine, theirs = F.pmod(F.xxhash64(side), F.col(own)), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - F.lit(1).cast("bigint")))
        at = [mine.alias("_i"), theirs.alias("_j")] if side == "l" else [theirs.alias("_i"), mine.alias("_j")]
        rows = names.join(sizes, "listing").select("listing", side, *at)
        return rows.repartition(parts, "listing", "_i", "_j").groupBy("listing", "_i", "_j")  # few bytes, but much work: not to be taken together

    pairs = dealt(a, "l", "_a", "_b").cogroup(dealt(b, "r", "_b", "_a"))
    return pairs.applyInArrow(scored, "listing string, l string, r string, score double")


def _of_pairs(pairs: DataFrame, least: float) -> DataFrame:
    """pairs(listing, l, r) -> scores over `least`."""
    import numpy as np
    import pyarrow as pa

    def scored(batches):
        for batch in batches:
            names = [batch[k].dictionary_encode() for k in ("l", "r")]
            i, j = (np.asarray(x.indices) for x in names)
            s = pa.array(ratios(*pair_of(*[x.dictionary.to_pylist() for x in names]), i, j, least).round(6))
            yield pa.record_batch([batch["listing"], batch["l"], batch["r"], s], names=PAIRS)

    return pairs.select("listing", "l", "r").mapInArrow(scored, "listing string, l string, r string, score double").where(F.col("score") > least)


def similarity_scores(left: DataFrame, right: DataFrame, least: float = 0.5, block: int = BLOCK, many: int = MANY, faster: float = FASTER) -> DataFrame:
    """(listing, l, r, score) by the Ratcliff-Obershelp ratio over `least`; a `least` of 0 compares all pairs of a listing. Repeated names count once.

    Names of a listing are compared in blocks. Where a listing has over `many` pairs and characters are so different that
    the join of candidates() has fewer than one row for `faster` of them, its pairs come from that join; both lose none.
    """
    a, b = written(_named(left, "l").distinct(), "lefts"), written(_named(right, "r").distinct(), "rights")
    if least > 0:
        a, b = a.where("l <> ''"), b.where("r <> ''")
    count = lambda names, n: names.groupBy("listing").agg(F.count(F.lit(1)).alias(n))
    large = written(count(a, "_a").join(count(b, "_b"), "listing").select("listing", (F.col("_a") * F.col("_b")).alias("_all")).where(F.col("_all") > many), "large")
    if least <= 0 or large.isEmpty():
        return _in_blocks(a, b, least, block)
    some = [x.join(large, "listing", "left_semi") for x in (a, b)]
    x, y = _prefixes(*some, least)
    rows = x.groupBy("listing", "_t").agg(F.count(F.lit(1)).alias("_a")).join(y.groupBy("listing", "_t").agg(F.count(F.lit(1)).alias("_b")), ["listing", "_t"])
    rows = large.join(rows.groupBy("listing").agg(F.sum(F.col("_a") * F.col("_b")).alias("_rows")), "listing", "left")
    apart = written(rows.where(F.coalesce("_rows", F.lit(0)) * faster < F.col("_all")).select("listing"), "apart")
    out = _in_blocks(a.join(apart, "listing", "left_anti"), b.join(apart, "listing", "left_anti"), least, block)
    if apart.isEmpty():
        return out
    return out.union(_of_pairs(_met(*[z.join(apart, "listing", "left_semi") for z in (x, y)], least), least))


def ranked(rows: DataFrame, key: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with `name`, their number from 1 in the order of each key. A key of any size is spread over tasks: rows are
    dealt by ranges of key and order, numbered in each range, and a key's numbers go on from range to range."""
    dealt = written(rows.repartitionByRange(*[F.col(k) for k in key], *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(*key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*key, "_range", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range", *key).orderBy(*order))
    return dealt.withColumn("_own", own).join(starts, [*key, "_range"]).withColumn(name, F.col("_own") + F.col("_start")).drop("_own", "_start", "_range")


#: Lefts of a class whose places are worked out together, and options that a left looks ahead in a round.
CHUNK = 1 << 16
AHEAD = 16


def _places(state: DataFrame) -> DataFrame:
    """Lefts of a class stand one behind the other: the k-th is at least as far down the options as the one before it, and one more."""
    key = ["listing", "cls"]
    s = state.withColumn("_lag", F.col("p") - F.col("k")).withColumn("_chunk", F.floor(F.col("k") / CHUNK))
    earlier = s.groupBy(*key, "_chunk").agg(F.max("_lag").alias("_most"))
    earlier = earlier.select(*key, "_chunk", F.max("_most").over(Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    upto = F.max("_lag").over(Window.partitionBy(*key, "_chunk").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("_upto", upto).join(earlier, [*key, "_chunk"])
    return s.select(*key, "l", "k", (F.col("k") + F.greatest("_upto", F.coalesce("_before", F.col("_upto")))).alias("p"))


#: Options of a listing that a task takes turns over; listings with more go in rounds.
LOCAL = 1 << 19


def _turns(lefts: DataFrame, options: DataFrame) -> DataFrame:
    """What matched() gives, for listings that fit in a task: each left in turn; a class's place in its options only moves on, as no right is given back."""
    import pandas as pd

    def turns(left: pd.DataFrame, option: pd.DataFrame) -> pd.DataFrame:
        option = option.sort_values(["score", "r"], ascending=[False, True])
        rights = {c: list(zip(g["r"], g["score"], strict=True)) for c, g in option.groupby("cls", sort=False)}
        place, used, rows = dict.fromkeys(rights, 0), set(), []
        for x in left.sort_values("l").itertuples(index=False):
            mine = rights.get(x.cls, ())
            k = place.get(x.cls, 0)
            while k < len(mine) and mine[k][0] in used:
                k += 1
            if k < len(mine):
                used.add(mine[k][0])
                rows.append((x.listing, x.l, *mine[k]))
            place[x.cls] = k
        return pd.DataFrame(rows, columns=PAIRS)

    return lefts.groupBy("listing").cogroup(options.groupBy("listing")).applyInPandas(turns, "listing string, l string, r string, score double")


def matched(lefts: DataFrame, options: DataFrame, alone: bool = False, local: int = LOCAL) -> DataFrame:
    """lefts(listing, cls, l), options(listing, cls, r, score) -> (listing, l, r, score): lefts in name order take their best free right.

    Listings of at most `local` lefts and options take turns in a task; larger ones go in rounds, with the same result.
    """
    lefts, options = lefts.select("listing", "cls", "l").distinct(), written(options.select("listing", "cls", "r", F.col("score").cast("double").alias("score")).distinct(), "options")
    if not local:
        return _rounds(lefts, options, alone)
    lefts = written(lefts, "lefts")
    sizes = options.groupBy("listing").agg(F.count(F.lit(1)).alias("_n")).union(lefts.groupBy("listing").agg(F.count(F.lit(1))))
    large = written(sizes.where(F.col("_n") > local).select("listing").distinct(), "large")
    pairs = _turns(lefts.join(large, "listing", "left_anti"), options.join(large, "listing", "left_anti"))
    if large.isEmpty():
        return pairs
    return pairs.union(_rounds(lefts.join(large, "listing", "left_semi"), options.join(large, "listing", "left_semi"), alone))


def _rounds(lefts: DataFrame, options: DataFrame, alone: bool) -> DataFrame:
    """matched() for listings of any size.

    Lefts of a class have the same options; ties go by name. All lefts propose at once and each right keeps the first in
    name order of those who ever came; the others move on. That ends with what taking turns gives, since a right that
    an earlier left holds is never free for a later one. The k-th left of a class starts at its k-th option, as the
    ones before it have better ones; alone: no class has a second left. No group meets in one task; rounds grow with
    chains of rights lost to other classes.
    """
    options = written(ranked(options, ["listing", "cls"], [F.desc("score"), F.col("r")], "pos"), "options")
    state = ranked(lefts, ["listing", "cls"], [F.col("l")], "k").select("listing", "cls", "l", "k", F.col("k").alias("p"))
    state = written(state, "state")
    while True:
        asked = written(state.join(options.withColumnRenamed("pos", "p"), ["listing", "cls", "p"]), "asked")
        held = written(asked.groupBy("listing", "r").agg(F.min("l").alias("holder")), "held")
        lost = asked.join(held, ["listing", "r"]).where(F.col("l") > F.col("holder")).select("listing", "cls", "l", F.col("p").alias("_p"))
        lost = written(lost, "lost")
        if lost.isEmpty():
            return asked.select(*PAIRS)
        ahead = lost.select("listing", "cls", "l", "_p", F.explode(F.sequence(F.col("_p") + 1, F.col("_p") + AHEAD)).alias("pos")).join(options.select("listing", "cls", "pos", "r"), ["listing", "cls", "pos"])
        free = ahead.join(held, ["listing", "r"], "left").where("holder is null or holder > l").groupBy("listing", "cls", "l").agg(F.min("pos").alias("_next"))
        moved = lost.join(free, ["listing", "cls", "l"], "left").select("listing", "cls", "l", F.coalesce("_next", F.col("_p") + AHEAD + 1).alias("_to"))
        state = state.join(moved, ["listing", "cls", "l"], "left").withColumn("p", F.coalesce("_to", "p")).drop("_to")
        state = written(state if alone else _places(state), "state")


def greedy(scores: DataFrame) -> DataFrame:
    """(listing, l, r, score): lefts in name order take their best free right, the first in name order on ties."""
    return matched(scores.select("listing", F.col("l").alias("cls"), "l"), scores.select("listing", F.col("l").alias("cls"), "r", "score"), alone=True)


def match_numbers(left: DataFrame, right: DataFrame) -> DataFrame:
    """Greedy pairs by number_scores(). Lefts of one last number have the same options, so a right has a row a number, not one a left."""
    a = _named(left, "l").select("listing", F.try_element_at(name_numbers(F.col("l")), F.lit(-1)).alias("cls"), "l").where("cls is not null")
    b = _named(right, "r").select("listing", "r", F.try_element_at(name_numbers(F.col("r")), F.lit(-1)).alias("_last"), F.explode(F.array_distinct(name_numbers(F.col("r")))).alias("cls"))
    return matched(a, b.select("listing", "cls", "r", F.when(F.col("_last") == F.col("cls"), 1.0).otherwise(0.8).alias("score")))


def match_tokens(left: DataFrame, right: DataFrame, least: float = 0.3) -> DataFrame:
    """Greedy pairs by token_scores(). Lefts of one token set have the same options."""
    named = _named(left, "l").select("listing", F.array_join(F.array_sort(name_tokens(F.col("l"))), " ").alias("cls"), "l")
    classes = named.select("listing", F.col("cls").alias("name")).where("name <> ''").distinct()
    return matched(named, token_scores(classes, right, least).select("listing", F.col("l").alias("cls"), "r", "score"))


#: Ratio down to which all lefts look for options; those that end without one look down to the least.
FIRST = 0.75


def match_similar(left: DataFrame, right: DataFrame, least: float = 0.5, first: float = FIRST) -> DataFrame:
    """Greedy pairs by similarity_scores(). Ratios under `first` are computed only for lefts that lost all options over it, which are better than those."""
    lefts = written(_named(left, "l").distinct(), "lefts")
    scores = written(similarity_scores(left, right, max(first, least)).distinct(), "scores")
    seen = lefts.where("false") if first > least else lefts
    while True:
        pairs = written(greedy(scores), "pairs")
        todo = written(lefts.join(pairs, ["listing", "l"], "left_anti").join(seen, ["listing", "l"], "left_anti"), "unmatched")
        if todo.isEmpty():
            return pairs
        scores = written(scores.union(similarity_scores(todo.withColumnRenamed("l", "name"), right, least)).distinct(), "scores")
        seen = written(seen.union(todo), "seen")


def auto(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each listing numbers if they pair four fifths of its lefts; else tokens, else similarity, where they pair strictly more; else numbers."""
    left, right = _named(left, "name"), _named(right, "name")
    state = written(left.groupBy("listing").agg(F.count(F.lit(1)).alias("n_left")), "listings")
    found = []
    # a listing whose pick is settled takes no part in the strategies that follow
    for strategy, match, todo in (("number", match_numbers, None), ("keyword", match_tokens, "number < 0.8 * n_left"), ("similarity", match_similar, "number < 0.8 * n_left and keyword <= number")):
        some = state.where(todo).select("listing") if todo else state.select("listing")
        one = written(match(left.join(some, "listing", "left_semi"), right.join(some, "listing", "left_semi")).select(*PAIRS).withColumn("strategy", F.lit(strategy)), "matches")
        state = written(state.join(one.groupBy("listing").agg(F.count(F.lit(1)).alias(strategy)), "listing", "left").na.fill(0), "listings")
        found.append(one)
    pick = F.when(F.col("number") >= 0.8 * F.col("n_left"), "number").when(F.col("keyword") > F.col("number"), "keyword").when(F.col("similarity") > F.col("number"), "similarity").otherwise("number")
    found = found[0].union(found[1]).union(found[2])
    return found.join(state.select("listing", pick.alias("strategy")), ["listing", "strategy"]).select(*PAIRS, "strategy")


def occurrences(used: DataFrame, known: DataFrame) -> DataFrame:
    """used(pos, hash), known(idx, hash) -> (pos, idx): the k-th use of a hash takes its k-th known occurrence; the rest by position."""
    rank = lambda o: F.row_number().over(Window.partitionBy("hash").orderBy(o))
    a, b = used.withColumn("_k", rank("pos")), known.withColumn("_k", rank("idx"))
    out = a.join(b, ["hash", "_k"], "left")
    return out.select("pos", F.coalesce("idx", "pos").alias("idx"), F.col("idx").isNotNull().alias("by_hash"))
