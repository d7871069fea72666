from __future__ import annotations

import itertools
import re
from collections import Counter

import edges
import numpy as np
import pytest

from corvane.llm import quality as Q


def brute(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    n = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    cover = {i + k for i in range(len(words) - 2) if n[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(cover)


@pytest.mark.parametrize("t", [None, "", "a", "a b a b a", "a a a a", "x\n\nx\ny x\nx", "a\x0bb\x0cc\rd", "é|é é|é x", edges.GOOD, "p q r s p q r"])
def test_base_counts(t):
    assert Q.base_counts(t) == brute(t)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(50):
        f = Q.LineField(np.zeros(Q.N_FEATURES), rng.normal(size=(2, 2)))
        e = rng.normal(size=rng.integers(1, 8)).tolist()
        cost = lambda y, e=e, f=f: sum(s for s, v in zip(e, y, strict=True) if v) + sum(f.move[a, b] for a, b in itertools.pairwise(y))
        assert cost(f.decode(e)) == pytest.approx(max(map(cost, itertools.product([0, 1], repeat=len(e)))))


def test_gradient_is_that_of_all_labellings():
    """Log-likelihood of three short sequences by listing every labelling, its gradient by differences."""
    rng = np.random.default_rng(5)
    starts, sizes = np.array([0, 4, 7]), np.array([4, 3, 1])
    x, y = rng.normal(size=(8, Q.N_FEATURES)), rng.integers(0, 2, 8)
    f = Q._likelihood(x, starts, sizes, y, 0.01)

    def by_hand(theta):
        e, move, out = x @ theta[: Q.N_FEATURES], theta[Q.N_FEATURES :].reshape(2, 2), 0.0
        for s, n in zip(starts, sizes, strict=True):
            score = lambda z, s=s: sum(e[s + k] for k, v in enumerate(z) if v) + sum(move[a, b] for a, b in itertools.pairwise(z))
            out += score(y[s : s + n].tolist()) - np.log(sum(np.exp(score(z)) for z in itertools.product([0, 1], repeat=int(n))))
        return out / 3 - 0.005 * theta @ theta

    theta = rng.normal(size=Q.N_FEATURES + 4)
    value, grad = f(theta)
    assert value == pytest.approx(by_hand(theta))
    for k in range(len(theta)):
        d = np.eye(len(theta))[k] * 1e-6
        assert grad[k] == pytest.approx((by_hand(theta + d) - by_hand(theta - d)) / 2e-6, abs=1e-5)


def test_words_of_shares_are_those_of_the_base_rules():
    assert Q.line_features(["a\u00a0b c", "d\x1ce"])[1].tolist() == [2, 1]


def test_held_out_documents(spark, medium):
    """Fitted to one half of the labelled documents; of the other half, no good document is lost and few bad ones stay."""
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    field = Q.train(docs, labels.where("doc_id % 2 = 0"))
    rows = Q.judged(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), field).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert len(good) > 100 and sum(good) >= 0.99 * len(good)
    assert bad and sum(bad) <= 0.2 * len(bad)


def test_whole_table(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = Q.op1(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        b = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (r.kept and r.base_failed)


def test_edges(spark):
    field = Q.fit([], [])
    rows = Q.judged(edges.documents(spark), field).collect()
    assert len(rows) == len(edges.texts())
    assert [r.n_words for r in rows if r.doc_id in (3, 4, 5, 10)] == [0] * 4
    kept = Q.accepted(edges.documents(spark), field)
    assert kept.columns == edges.documents(spark).columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 2]
    assert Q.judged(edges.empty(spark), field).count() == Q.accepted(edges.empty(spark), field).count() == 0


def test_without_labels(spark):
    field = Q.train(edges.documents(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert field.shares(["some words here"]) == [1.0]


def test_accepted_holds_few_texts_at_once(spark):
    """Whatever the Arrow batch has, texts are decided some at a time, as Arrow values."""

    class Bounded(Q.LineField):
        def shares(self, texts):
            if len(texts) > Q.DECIDED:
                raise ValueError(len(texts))
            return super().shares(texts)

    field = Q.fit([], [])
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k % 100))) for k in range(3 * Q.DECIDED)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id for r in Q.accepted(docs, Bounded(field.score, field.move)).collect()}
    assert got == {r.doc_id for r in Q.judged(docs, field).where("kept").collect()} and 0 < len(got) < 3 * Q.DECIDED
