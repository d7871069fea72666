"""Timetables against all assignments, and the query's whole result against its rules."""

from __future__ import annotations

import itertools
import random

import pytest

from corvane.operators import schedule as S
from corvane.operators import timetable as T
from corvane.plans import timetables as P

SCHEMA = "plan string, course string, slot int, teacher string, class string, size int, times array<string>, rooms array<struct<id: string, capacity: int>>"


def most(items):
    """The most slots that any assignment places."""
    best, options = 0, [[None, *[(t, x) for t in i["times"] for x, c in i["rooms"] if c >= i["size"]]] for i in items]
    for pick in itertools.product(*options):
        used = [x for i, o in zip(items, pick, strict=True) if o for x in (("t", i["teacher"], o[0]), ("c", i["class"], o[0]), ("r", o[1], o[0]))]
        if len(used) == len(set(used)):
            best = max(best, sum(o is not None for o in pick))
    return best


def drawn(draw, n):
    rooms = [(f"R{k}", draw.choice([10, 20, 30])) for k in range(draw.randint(1, 2))]
    return [{"course": f"C{k}", "slot": 0, "teacher": draw.choice("TU"), "class": draw.choice("KLM"), "size": draw.randint(5, 30), "times": draw.sample("abcd", draw.randint(1, 4)), "rooms": rooms} for k in range(n)]


def plan_of(items):
    return T.Plan([{**i, "rooms": [{"id": x, "capacity": c} for x, c in i["rooms"]]} for i in items])


def test_searches_and_branches_against_all_assignments():
    draw, seen = random.Random(1), set()
    for _ in range(120):
        items = drawn(draw, 5)
        p, best = plan_of(items), most(items)
        status, found = T.search(p, [], 10**6)
        assert status == (T.SOLVED if best == 5 else T.INFEASIBLE)
        assert sum(t is not None for t, _ in found) <= best
        assert not p.impossible() or best < 5
        seen.add((status, p.impossible()))
        below = T.branches(plan_of(items), [], 4)
        assert (T.SOLVED in [T.search(plan_of(items), b, 10**6)[0] for b in below]) == (best == 5)
    assert (T.INFEASIBLE, True) in seen and (T.INFEASIBLE, False) in seen


def test_backjumping_proves_what_plain_backtracking_cannot_in_time():
    """Ten easy slots stand before a teacher whose three slots have two times; only that teacher is to blame."""
    easy = [{"course": f"A{k}", "slot": 0, "teacher": f"E{k}", "class": f"K{k}", "size": 5, "times": list("abcdefgh"), "rooms": [(f"R{r}", 9) for r in range(20)]} for k in range(10)]
    hard = [{"course": f"Z{k}", "slot": 0, "teacher": "H", "class": f"L{k}", "size": 5, "times": ["a", "b", "c", "d", "e", "f", "g", "h", "i"], "rooms": [(f"R{r}", 9) for r in range(20)]} for k in range(10)]
    p = plan_of([*easy, *hard])
    assert p.impossible()
    assert T.search(plan_of([*easy, *[{**h, "times": h["times"][:2]} for h in hard[:3]]]), [], 200)[0] == T.INFEASIBLE


def rows_of(plan, items):
    return [(plan, i["course"], i["slot"], i["teacher"], i["class"], i["size"], i["times"], i["rooms"]) for i in items]


@pytest.mark.parametrize(("steps", "least", "rounds"), [(5000, 16, 3), (1, 2, 4)])
def test_plans_dealt_over_tasks(spark, steps, least, rounds):
    """With a budget of one step nothing is settled but by splitting."""
    draw = random.Random(3)
    plans = {f"p{k}": drawn(draw, 4) for k in range(10)}
    got = T.solve(spark.createDataFrame([r for p, i in plans.items() for r in rows_of(p, i)], SCHEMA), steps, least, rounds).collect()
    assert len(got) == 40
    for p, items in plans.items():
        mine = [r for r in got if r.plan == p]
        (status,) = {r.status for r in mine}
        best = most(items)
        assert status == T.OPEN or (status == T.SOLVED) == (best == 4)
        assert sum(r.time is not None for r in mine) <= best and (status != T.SOLVED or all(r.time for r in mine))
        if steps > 1:
            assert status != T.OPEN


def test_status_tells_a_budget_from_a_proof(spark):
    """No two of five slots can share a time, and there are four times; rooms hide it from the matchings. Without steps the outcome is open."""
    items = [{"course": f"C{k}", "slot": 0, "teacher": f"T{k}", "class": f"K{k}", "size": 20, "times": list("abcd"), "rooms": [("R0", 30), ("R1", 10)]} for k in range(5)]
    df = spark.createDataFrame(rows_of("p", items), SCHEMA)
    assert {r.status for r in T.solve(df).collect()} == {T.INFEASIBLE}
    rows = T.solve(df, steps=1, rounds=0).collect()
    assert {r.status for r in rows} == {T.OPEN} and sum(r.time is not None for r in rows) == 4


def test_restarts_settle_what_a_search_leaves_open():
    """Four teachers' courses in two rooms, 62 slots at 35 times: the first choices of a search in the times' order lead it astray."""
    draw = random.Random(0)
    rooms = [{"id": "R0", "capacity": 40}, {"id": "R1", "capacity": 40}]
    left_open = 0
    for _ in range(40):
        free = {t: draw.sample([f"t{k:02}" for k in range(35)], draw.randint(25, 32)) for t in "ABCD"}
        items = [{"course": f"{t}{k}", "slot": 0, "teacher": t, "class": f"K{k % 6}", "size": 20, "times": free[t], "rooms": rooms} for t in "ABCD" for k in range(15 + (t < "C"))]
        plan = T.Plan(items)
        if plan.impossible() or T.search(plan, [])[0] != T.OPEN:
            continue
        left_open += 1
        status, found = T.restarted(plan)
        used = [x for r, (time, room) in zip(plan.items, found, strict=True) for x in (("t", r["teacher"], time), ("c", r["class"], time), ("r", room, time))]
        assert status == T.SOLVED and len(used) == len(set(used))
        assert all(time in r["times"] for r, (time, _) in zip(plan.items, found, strict=True))
        assert T.restarted(plan, steps=1) is None
    assert left_open


def test_nulls_and_nothing(spark):
    rows = [("p", "A", 0, "T", "K", 5, None, [("R", 9)]), ("p", "B", 0, "T", "K", 5, ["a"], None), ("q", "A", 0, None, None, 5, ["a", "a"], [("R", 9)])]
    got = {(r.plan, r.course): (r.time, r.room, r.status) for r in T.solve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("p", "A"): (None, None, T.INFEASIBLE), ("p", "B"): (None, None, T.INFEASIBLE), ("q", "A"): ("a", "R", T.SOLVED)}
    assert T.solve(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_keeps_the_rules(spark, medium):
    problems = P.problems(spark, medium)
    got = P.queries()["g03_solve"](spark, medium)
    rows = got.join(problems, ["plan", "course", "slot"]).collect()
    assert len(rows) == problems.count()
    by = {}
    for r in rows:
        by.setdefault(r.plan, []).append(r)
        if r.time is not None:
            assert r.time in r.times and any(x.id == r.room and x.capacity >= r["size"] for x in r.rooms)
    for mine in by.values():
        used = [x for r in mine if r.time for x in (("t", r.teacher, r.time), ("c", r["class"], r.time), ("r", r.room, r.time))]
        assert len(used) == len(set(used))
        assert all(r.time for r in mine) == (mine[0].status == T.SOLVED)
    assert {T.SOLVED, T.INFEASIBLE} <= {r.status for r in rows}


def test_repeats_are_violations(spark):
    bad = spark.createDataFrame([("T1", "K1", "R1", "Mon-1"), ("T1", "K2", "R2", "Mon-1")], "teacher string, class string, room string, time string")
    assert [tuple(r) for r in S.violations(bad, ["teacher", "class", "room"], "time").collect()] == [("teacher", "T1", "Mon-1", 1)]
