"""One-to-one matching against taking turns, one left after the other."""

from __future__ import annotations

import random
from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import ratio as R
from corvane.operators import match as M


def turns(scores):
    """[(listing, l, r, score)] -> {(listing, l): (r, score)}: lefts in name order take their best free right."""
    options, used, out = defaultdict(list), set(), {}
    for k, a, b, s in set(scores):
        options[k, a].append((-s, b))
    for k, a in sorted(options):
        for s, b in sorted(options[k, a]):
            if (k, b) not in used:
                used.add((k, b))
                out[k, a] = (b, -s)
                break
    return out


def pairs(df):
    rows = df.collect()
    out = {(r.listing, r.l): (r.r, r.score) for r in rows}
    assert len(out) == len(rows) == len({(r.listing, r.r) for r in rows})
    return out


def named(spark, rows):
    return spark.createDataFrame(rows, "listing string, name string")


def test_greedy_of_random_scores(spark):
    draw = random.Random(1)
    rows = [(draw.choice("xy"), f"l{draw.randint(0, 30):02}", f"r{draw.randint(0, 25):02}", draw.choice([0.5, 0.8, 1.0])) for _ in range(200)]
    best = {}
    for k, a, b, s in rows:
        best[k, a, b] = s
    rows = [(*k, s) for k, s in best.items()]
    assert pairs(M.greedy(spark.createDataFrame(rows, "listing string, l string, r string, score double"))) == turns(rows)


def test_a_chain_of_displacements(spark):
    """Each left wants the right that the one before it also has."""
    rows = [("", f"l{k:02}", f"r{j:02}", 1.0 - 0.01 * n) for k in range(12) for n, j in enumerate((11 - k, 10 - k, 12 - k)) if j >= 0]
    assert pairs(M.greedy(spark.createDataFrame(rows, "listing string, l string, r string, score double"))) == turns(rows)


def test_numbers_of_one_hot_class(spark, monkeypatch):
    """All names of a listing have one number; classes share rights; chunks are small."""
    monkeypatch.setattr(M, "CHUNK", 7)
    draw = random.Random(4)
    left = [("a", f"x{k:03}_{draw.choice([7, 7, 7, 8, 9])}") for k in range(80)] + [("b", "no number"), ("b", "n1")] * 2
    right = [("a", f"y{k:03}_{draw.choice([1, 7, 8])}_{draw.choice([7, 7, 8, 9])}") for k in range(70)] + [("b", "m1"), (None, "m1"), ("b", None)]
    want = turns(M.number_scores(named(spark, left), named(spark, right)).collect())
    assert pairs(M.match_numbers(named(spark, left), named(spark, right))) == want and len(want) > 50


def test_tokens(spark):
    draw = random.Random(5)
    words = ["red", "blue", "green", "old", "new"]
    left = [("a", " ".join(draw.sample(words, draw.randint(1, 3))) + draw.choice(["", "!"])) for _ in range(40)]
    right = [("a", " ".join(draw.sample(words, draw.randint(1, 4))) + draw.choice(["", "?", "."])) for _ in range(40)] + [("a", "...")]
    want = turns(M.token_scores(named(spark, left), named(spark, right)).collect())
    assert pairs(M.match_tokens(named(spark, left), named(spark, right))) == want and len(want) > 10


@pytest.mark.parametrize("least", [0.3, 0.5])
def test_candidates_hold_every_similar_pair(spark, least):
    draw = random.Random(int(least * 10))
    names = sorted({"".join(draw.choice("aabcdé x.1") for _ in range(draw.randint(1, 14))) for _ in range(90)})
    df = named(spark, [("a", n) for n in names])
    got = {(r.l, r.r) for r in M.candidates(df, df, least).collect()}
    want = {(a, b) for a in names for b in names if SequenceMatcher(None, a, b).ratio() > least}
    assert want <= got and len(got) < len(names) ** 2


def test_similar(spark):
    draw = random.Random(8)
    near = lambda w: "".join(c if draw.random() > 0.2 else draw.choice("abcde") for c in w)
    base = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randint(5, 14))) for _ in range(30)]
    left, right = [("a", near(w)) for w in base], [("a", near(w)) for w in base]
    scores = [("a", a, b, round(SequenceMatcher(None, a, b).ratio(), 6)) for _, a in left for _, b in right]
    assert pairs(M.match_similar(named(spark, left), named(spark, right))) == turns([s for s in scores if s[3] > 0.5])


def test_ranks_of_one_key(spark):
    df = spark.range(1000).select(F.lit("k").alias("key"), (-F.col("id")).alias("v")).repartition(5)
    got = M.ranked(df, ["key"], [F.col("v")], "n").collect()
    assert sorted((r.n, r.v) for r in got) == [(k + 1, k - 999) for k in range(1000)]


def test_empty_listings(spark):
    none, some = named(spark, []), named(spark, [("a", "x 1"), ("a", "")])
    for f in (M.match_numbers, M.match_tokens, M.match_similar, M.auto):
        assert f(none, some).collect() == [] and f(some, none).collect() == []


def test_ratios_are_those_of_the_sequence_matcher():
    draw = random.Random(11)
    for alphabet in ("ab", "abcé x.1", "abcdefghij\U0001f600"):
        left = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 16))) for _ in range(60)] + ["a" * 150 + "b" * 49, "ab" * 120]
        right = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 16))) for _ in range(60)] + ["b" * 199, "ba" * 130, "a" * 199]
        a, b = R.pair_of(left, right)
        want = [[SequenceMatcher(None, x, y).ratio() for y in right] for x in left]
        i, j = (x.ravel() for x in np.indices((len(left), len(right))))
        assert R.ratios(a, b, i, j, -1.0).tolist() == [x for row in want for x in row]
        for least in (0.3, 0.5, 0.75):
            i, j = R.likely(a, b, least)
            got = {(x, y) for x, y, s in zip(i.tolist(), j.tolist(), R.ratios(a, b, i, j, least).tolist(), strict=True) if round(s, 6) > least and s == want[x][y]}
            assert got == {(x, y) for x in range(len(left)) for y in range(len(right)) if round(want[x][y], 6) > least and left[x] + right[y]}


@pytest.mark.parametrize(("block", "many", "faster"), [(7, 1 << 24, 20), (512, 0, 0), (512, 0, 1e9), (9, 200, 1.2)])
def test_scores_in_blocks_and_by_candidates(spark, block, many, faster):
    """The same pairs, however a listing is dealt; names of several listings, with nulls, empty and repeated ones."""
    draw = random.Random(12)
    name = lambda k: "".join(draw.choice("aabcdé x.1" if k == "a" else "0123456789qwertz") for _ in range(draw.randint(0, 12)))
    left, right = ([(k, name(k)) for k in "aab" for _ in range(30)] + [(None, "abc"), ("a", None), ("a", ""), ("c", "lone")] for _ in range(2))
    got = [tuple(r) for r in M.similarity_scores(named(spark, left * 2), named(spark, right), block=block, many=many, faster=faster).collect()]
    want = {(k or "", a, b, round(SequenceMatcher(None, a, b).ratio(), 6)) for k, a in left for m, b in right if k == m and a and b}
    assert sorted(got) == sorted(w for w in want if w[3] > 0.5) and len(got) > 20


def test_prefixes_shuffle_no_character_of_a_name(spark):
    """A name's characters are put in order where the name lies: between its row and its prefix nothing is shuffled or written."""
    a, b = named(spark, [("a", "abcabc"), ("b", "xyz")]).withColumnRenamed("name", "l"), named(spark, [("a", "abca"), ("b", "é1")]).withColumnRenamed("name", "r")
    x, y = M._prefixes(a, b, 0.5)
    assert all("Exchange" not in z._jdf.queryExecution().executedPlan().toString() for z in (x, y))
    assert {(r.l, r["_t"]) for r in x.where("listing = 'b'").collect()} == {("xyz", "x0"), ("xyz", "y0")}  # of three characters it can miss one of a partner


def test_auto_leaves_settled_listings_out(spark, monkeypatch):
    """n is settled by numbers, k by tokens; names of s are alike and share neither."""
    seen = {}
    for name in ("match_numbers", "match_tokens", "match_similar"):
        own = getattr(M, name)
        monkeypatch.setattr(M, name, lambda a, b, name=name, own=own: seen.update({name: {r.listing for r in a.collect()}}) or own(a, b))
    left = [("n", "x 1"), ("n", "x 2"), ("k", "red ring"), ("k", "blue bolt"), ("s", "redring"), ("s", "bluebolt")]
    right = [("n", "y 1"), ("n", "y 2"), ("k", "ring red"), ("k", "bolt blue"), ("s", "redrings"), ("s", "bluebolts")]
    got = {(r.listing, r.l, r.r, r.strategy) for r in M.auto(named(spark, left), named(spark, right)).collect()}
    assert got == {("n", "x 1", "y 1", "number"), ("n", "x 2", "y 2", "number"), ("k", "red ring", "ring red", "keyword"), ("k", "blue bolt", "bolt blue", "keyword"), ("s", "redring", "redrings", "similarity"), ("s", "bluebolt", "bluebolts", "similarity")}
    assert seen == {"match_numbers": {"n", "k", "s"}, "match_tokens": {"k", "s"}, "match_similar": {"s"}}
