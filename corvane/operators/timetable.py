"""Timetables by constraint search: bit sets of times, forward checking, conflict-directed backjumping, branches dealt over tasks.

A plan's slots each need a time at which their teacher and class are free and a room that is large enough. A slot takes
the smallest free room at its time; as rooms only differ by capacity, that never excludes what another choice would
allow, so the search is over times alone. Plans that a task cannot settle within a budget of steps are searched anew some
times, briefly and with the times in another order, as most of them have a timetable that a search only misses by its
first choices; the rest are split into branches, which are searched elsewhere, and those that stay open are split again.
"""

from __future__ import annotations

import json
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.tables import written

#: Steps of one search; branches that an open search is split into, at least; rounds of splitting.
STEPS = 2000
BRANCHES = 16
ROUNDS = 2
#: Short searches of a plan whose search stays open, before it is split, and steps of each by slot.
RESTARTS = 100
RESTART_STEPS = 3
SOLVED, INFEASIBLE, OPEN = "solved", "infeasible", "out of budget"


def _bits(mask: int):
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


class Plan:
    """The slots of one plan, in static order (fewest times first), with masks of times; and what is assigned so far."""

    def __init__(self, items: list[dict]):
        self.items = sorted(items, key=lambda r: (len(set(r["times"])), r["course"], r["slot"]))
        self.times = sorted({t for r in items for t in r["times"]})
        place = {t: k for k, t in enumerate(self.times)}
        self.mask = [sum(1 << place[t] for t in set(r["times"])) for r in self.items]
        rooms = {(x["id"], x["capacity"]) for r in items for x in r["rooms"]}
        self.rooms = sorted(rooms, key=lambda x: (x[1], x[0]))
        at = {x: k for k, x in enumerate(self.rooms)}
        self.fits = [sorted({at[x["id"], x["capacity"]] for x in r["rooms"] if x["capacity"] >= r["size"]}) for r in self.items]
        self.n = len(self.items)
        self.clear()

    def clear(self) -> None:
        self.held: dict[tuple, int] = {}  # (what, who, time) -> the slot that has it
        self.busy: dict[tuple, int] = {}  # (what, who) -> mask of times
        self.time: list[int | None] = [None] * self.n
        self.room: list[int] = [0] * self.n

    def _who(self, v: int):
        return ("t", self.items[v]["teacher"]), ("c", self.items[v]["class"])

    def free(self, v: int) -> int:
        a, b = self._who(v)
        mask = self.mask[v] & ~self.busy.get(a, 0) & ~self.busy.get(b, 0)
        full = -1
        for r in self.fits[v]:
            full &= self.busy.get(("r", r), 0)
            if not full & mask:
                return mask
        return mask & ~full

    def assign(self, v: int, t: int) -> None:
        r = next(r for r in self.fits[v] if not self.busy.get(("r", r), 0) >> t & 1)
        self.time[v], self.room[v] = t, r
        for who in (*self._who(v), ("r", r)):
            self.busy[who] = self.busy.get(who, 0) | 1 << t
            self.held[who, t] = v

    def undo(self, v: int) -> None:
        t = self.time[v]
        for who in (*self._who(v), ("r", self.room[v])):
            self.busy[who] &= ~(1 << t)
            del self.held[who, t]
        self.time[v] = None

    def blockers(self, v: int) -> set[int]:
        """The assigned slots that keep v from its times."""
        out: set[int] = set()
        for t in _bits(self.mask[v]):
            own = {self.held[who, t] for who in self._who(v) if (who, t) in self.held}
            out |= own or {self.held[("r", r), t] for r in range(len(self.rooms)) if (("r", r), t) in self.held}
        return out

    def placed(self) -> int:
        return sum(t is not None for t in self.time)

    def impossible(self) -> bool:
        """True if the slots of a teacher, a class, or all with the rooms there are, have too few times: a matching proves it."""
        groups: dict[tuple, list[int]] = {}
        for v in range(self.n):
            for who in self._who(v):
                groups.setdefault(who, []).append(v)
        if any(not m or not f for m, f in zip(self.mask, self.fits, strict=True)):
            return True
        if any(not self._matched(vs, 1) for vs in groups.values()):
            return True
        return not self._matched(list(range(self.n)), len(self.rooms))

    def _matched(self, slots: list[int], room: int) -> bool:
        at: dict[int, list[int]] = {}

        def settle(first: int) -> bool:
            """A chain of moves to a time with room, breadth first."""
            came: dict[int, tuple[int, int] | None] = {}
            queue = [(first, None)]
            for v, before in queue:
                for t in _bits(self.mask[v]):
                    if t in came:
                        continue
                    came[t] = (v, before)
                    if len(at.setdefault(t, [])) < room:
                        while True:
                            v, before = came[t]
                            if before is not None:
                                at[before].remove(v)
                            at[t].append(v)
                            if before is None:
                                return True
                            t = before
                    queue += [(u, t) for u in at[t]]
            return False

        return all(settle(v) for v in slots)


def search(plan: Plan, prefix: list[int], steps: int = STEPS, order: list[int] | None = None) -> tuple[str, list]:
    """(status, [(time, room)] of the slots, None where not placed): a search below the times that the first slots have.

    order: the times as they are tried, the first ones first if it is not given.

    The slot with the fewest free times is next, and a slot without one is a dead end. Its blockers, with those of the
    slots between, name the latest choice that can help; that one is changed, what came after it forgotten.
    """
    plan.clear()
    for v, t in enumerate(prefix):
        plan.assign(v, t)
    base = len(prefix)
    best, best_n = list(zip(plan.time, plan.room, strict=True)), base
    stack: list[list] = []  # slot, times still to try, slots to blame

    def done(status: str) -> tuple[str, list]:
        plan.clear()
        for v, (t, _) in enumerate(best):
            if t is not None:
                plan.assign(v, t)
        for v in range(plan.n):  # what a dead end left out may still have a place
            if plan.time[v] is None and plan.free(v):
                plan.assign(v, next(_bits(plan.free(v))))
        return status, [(None, None) if t is None else (plan.times[t], plan.rooms[r][0]) for t, r in zip(plan.time, plan.room, strict=True)]

    while True:
        if base + len(stack) == plan.n:
            best = list(zip(plan.time, plan.room, strict=True))
            return done(SOLVED)
        if steps <= 0:
            return done(OPEN)
        steps -= 1
        least, v, free = 1 << 30, -1, 0
        for u in range(plan.n):
            if plan.time[u] is None:
                mask = plan.free(u)
                if mask.bit_count() < least:
                    least, v, free = mask.bit_count(), u, mask
                    if not mask:
                        break
        stack.append([v, free, set()])
        while True:
            v, free, blame = stack[-1]
            if free:
                t = (free & -free).bit_length() - 1 if order is None else next(t for t in order if free >> t & 1)
                stack[-1][1] = free & ~(1 << t)
                blame |= plan.blockers(v)
                plan.assign(v, t)
                if base + len(stack) > best_n:
                    best, best_n = list(zip(plan.time, plan.room, strict=True)), base + len(stack)
                break
            blame |= plan.blockers(v)
            stack.pop()
            while stack and stack[-1][0] not in blame:
                plan.undo(stack.pop()[0])
            if not stack:
                return done(INFEASIBLE)
            u = stack[-1]
            plan.undo(u[0])
            u[2] |= blame - {u[0]}


def restarted(plan: Plan, restarts: int = RESTARTS, steps: int = STEPS) -> tuple[str, list] | None:
    """The first of some short searches that places all slots or proves that it can't be; each tries the times in an order of its own. None: all stay open."""
    draw = random.Random(plan.n)
    for _ in range(restarts):
        status, found = search(plan, [], min(steps, RESTART_STEPS * plan.n), draw.sample(range(len(plan.times)), len(plan.times)))
        if status != OPEN:
            return status, found
    return None


def branches(plan: Plan, prefix: list[int], least: int = BRANCHES) -> list[list[int]]:
    """The search below a prefix as at least so many searches below longer ones, in order; fewer if there are no more, none if it is proved empty."""
    level = [prefix]
    while level and len(level) < least and len(level[0]) < plan.n:
        wider = []
        for p in level:
            plan.clear()
            for v, t in enumerate(p):
                plan.assign(v, t)
            for t in _bits(plan.free(len(p))):
                plan.assign(len(p), t)
                if all(plan.free(u) for u in range(len(p) + 1, plan.n)):
                    wider.append([*p, t])
                plan.undo(len(p))
        level = wider
    return level


STATE = "plan string, branch string, prefix array<int>, items string, status string, found string"


def solve(problems: DataFrame, steps: int = STEPS, least: int = BRANCHES, rounds: int = ROUNDS, restarts: int = RESTARTS) -> DataFrame:
    """problems(plan, course, slot, teacher, class, size, times array, rooms array<struct<id, capacity>>) -> (plan, course, slot, time, room, status).

    status of a plan: solved, with all slots placed; infeasible, proved by matchings or by an exhausted search; or out of
    budget, if after all rounds some branches are still open. Plans that are not solved have the most slots that a
    search placed, the first branch on ties; slots without a place have null time and room. A plan's slots meet in a
    task; null times or rooms count as none.
    """
    import pandas as pd

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [{"course": r.course, "slot": int(r.slot), "teacher": r.teacher, "class": r["class"], "size": int(r["size"]), "times": list(r.times) if r.times is not None else [], "rooms": [{"id": x["id"], "capacity": int(x["capacity"])} for x in (r.rooms if r.rooms is not None else [])]} for _, r in pdf.iterrows()]
        plan = Plan(rows)
        none = plan.impossible()
        status, found = search(plan, [], 0 if none else steps)
        status = INFEASIBLE if none else status
        if status == OPEN:
            status, found = restarted(plan, restarts, steps) or (status, found)
        return pd.DataFrame([(pdf["plan"].iloc[0], "", [], json.dumps(plan.items), status, json.dumps(found))], columns=["plan", "branch", "prefix", "items", "status", "found"])

    def split(pdfs):
        for pdf in pdfs:
            rows = []
            for r in pdf.itertuples():
                below = branches(Plan(json.loads(r.items)), list(map(int, r.prefix)), least)
                rows += [(r.plan, f"{r.branch}{k:04}.", p, r.items, OPEN, None) for k, p in enumerate(below)]
            yield pd.DataFrame(rows, columns=["plan", "branch", "prefix", "items", "status", "found"])

    def go(pdfs):
        for pdf in pdfs:
            out = [search(Plan(json.loads(r.items)), list(map(int, r.prefix)), steps) for r in pdf.itertuples()]
            yield pdf.assign(status=[s for s, _ in out], found=[json.dumps(f) for _, f in out])

    state = written(problems.groupBy("plan").applyInPandas(first, STATE), "plans")
    settled = state.where(F.col("status") != OPEN)
    todo, best = state.where(F.col("status") == OPEN), state.where(F.col("status") == OPEN)
    for _ in range(rounds):
        if todo.isEmpty():
            break
        below = written(todo.mapInPandas(split, STATE), "branches")
        found = written(below.repartition("plan", "branch").mapInPandas(go, STATE), "found")
        left = found.groupBy("plan").agg(F.count_if(F.col("status") == SOLVED).alias("_s"), F.count_if(F.col("status") == OPEN).alias("_o"))
        verdict = best.select("plan").distinct().join(left, "plan", "left").select("plan", F.when(F.col("_s") > 0, SOLVED).when(F.coalesce("_o", F.lit(0)) > 0, OPEN).otherwise(INFEASIBLE).alias("_v"))
        verdict = written(verdict, "verdicts")
        placed = F.size(F.filter(F.from_json("found", "array<array<string>>"), lambda x: x[0].isNotNull()))
        top = best.unionByName(found).withColumn("_n", placed)
        top = top.groupBy("plan").agg(F.max_by(F.struct("branch", "prefix", "items", "found"), F.struct("_n", F.translate("branch", "0123456789", "9876543210"))).alias("x"))
        top = written(top.join(verdict, "plan").select("plan", "x.branch", "x.prefix", "x.items", F.col("_v").alias("status"), "x.found"), "best")
        settled = settled.unionByName(top.where(F.col("status") != OPEN))
        best = top.where(F.col("status") == OPEN)
        todo = found.where(F.col("status") == OPEN).join(best.select("plan"), "plan", "left_semi")
    rows = settled.unionByName(best)
    items = F.from_json("items", "array<struct<course: string, slot: int>>")
    rows = rows.select("plan", "status", F.explode(F.arrays_zip(items.alias("i"), F.from_json("found", "array<array<string>>").alias("f"))).alias("x"))
    return rows.select("plan", F.col("x.i.course").alias("course"), F.col("x.i.slot").alias("slot"), F.col("x.f")[0].alias("time"), F.col("x.f")[1].alias("room"), "status")
