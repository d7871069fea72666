"""Taking turns in a task and in rounds."""

from __future__ import annotations

import random

from corvane.operators import match as M


def test_a_task_and_rounds_give_the_same(spark, monkeypatch):
    draw = random.Random(3)
    lefts = spark.createDataFrame([(f"k{i % 3}", f"c{draw.randint(0, 5)}", f"é{i:03}") for i in range(90)], "listing string, cls string, l string")
    rows = {(f"k{k}", f"c{c}", f"r{draw.randint(0, 40)}") for k in range(3) for c in range(5) for _ in range(20)}
    options = spark.createDataFrame([(*x, draw.randint(1, 4) / 4) for x in sorted(rows)], "listing string, cls string, r string, score double")
    took = []
    rounds = M._rounds
    monkeypatch.setattr(M, "_rounds", lambda *a: took.append(1) or rounds(*a))
    want = sorted(map(tuple, M.matched(lefts, options, local=0).collect()))
    assert len(took) == 1 and len(want) > 60
    assert sorted(map(tuple, M.matched(lefts, options).collect())) == want and len(took) == 1  # no round for small listings
    sizes = sorted(r["count"] for r in options.groupBy("listing").count().collect())
    assert sorted(map(tuple, M.matched(lefts, options, local=sizes[0]).collect())) == want and len(took) == 2
