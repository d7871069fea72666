"""Timetable queries (ids g1-g3, o3, o4) over courses of suppliers: a plan is four suppliers, who teach classes of return flags and line states."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import schedule as S
from corvane.operators import timetable as T
from corvane.sources.tables import selected, selected_sql

_TIME = "concat(CASE day({0}) % 5 WHEN 0 THEN 'Mon' WHEN 1 THEN 'Tue' WHEN 2 THEN 'Wed' WHEN 3 THEN 'Thu' ELSE 'Fri' END, '-', {1})"
COURSES = """SELECT concat('C', l_suppkey, l_returnflag, l_linestatus) AS id, concat('P', CAST(floor(l_suppkey / 4) AS INT)) AS plan, concat('T', l_suppkey) AS teacher,
 concat('P', CAST(floor(l_suppkey / 4) AS INT), '-', l_returnflag, l_linestatus) AS class, CAST(count(*) % 4 AS INT) + 1 AS hours_per_week, CAST(l_suppkey % 3 AS INT) AS consecutive
 FROM {lineitem} GROUP BY l_suppkey, l_returnflag, l_linestatus"""
TEACHERS = f"SELECT DISTINCT concat('T', l_suppkey) AS id, {_TIME.format('l_shipdate', 'l_linenumber')} AS time FROM {{lineitem}} WHERE l_quantity >= 46"
CLASSES = "SELECT concat('P', CAST(floor(l_suppkey / 4) AS INT), '-', l_returnflag, l_linestatus) AS id, CAST(count(*) % 40 AS INT) AS size FROM {lineitem} GROUP BY 1"
ROOMS = f"SELECT DISTINCT concat('R', c_nationkey) AS id, 10 + 2 * c_nationkey AS capacity, {_TIME.format('o_orderdate', 'substr(o_orderpriority, 1, 1)')} AS time FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey WHERE o_totalprice > 400000"
TIMES = f"SELECT DISTINCT {_TIME.format('l_shipdate', 'l_linenumber')} AS id FROM {{lineitem}}"
WISHES = "SELECT DISTINCT concat('C', l_suppkey, l_returnflag, l_linestatus) AS course, CASE WHEN l_returnflag = 'A' THEN 'morning' WHEN l_returnflag = 'R' THEN 'afternoon' END AS wish FROM {lineitem} WHERE l_linestatus = 'F'"


def courses(s, d):
    return selected(s, d, COURSES, "lineitem")


def _available(s, d, sql, *names, key=("id",)):
    return selected(s, d, sql, *names).groupBy(*key).agg(F.array_sort(F.collect_list("time")).alias("available"))


def options(s, d):
    return S.feasible(
        courses(s, d).select(F.col("id").alias("course"), "teacher", "class"), _available(s, d, TEACHERS, "lineitem"),
        _available(s, d, ROOMS, "orders", "customer", key=("id", "capacity")), selected(s, d, CLASSES, "lineitem"), selected(s, d, TIMES, "lineitem"),
    )


def problems(s, d):
    """A row a slot of a course. A plan has one to three rooms that take any class, so the plans with one room have more slots than times."""
    slots = S.course_slots(courses(s, d))
    rows = slots.join(courses(s, d).withColumnRenamed("id", "course"), "course").join(selected(s, d, CLASSES, "lineitem").withColumnRenamed("id", "class"), "class")
    rows = rows.join(_available(s, d, TEACHERS, "lineitem").select(F.col("id").alias("teacher"), F.col("available").alias("times")), "teacher", "left")
    number = F.substring("plan", 2, 10).cast("int")
    rooms = F.transform(F.sequence(F.lit(0), F.pmod(number, F.lit(3))), lambda k: F.struct(F.concat(F.lit("R"), k.cast("string")).alias("id"), (F.lit(40) - 10 * F.when(k == 2, 1).otherwise(0)).alias("capacity")))
    return rows.select("plan", "course", "slot", "teacher", "class", "size", F.coalesce("times", F.array().cast("array<string>")).alias("times"), rooms.alias("rooms"))


def queries():
    return {
        "g01_course_slots": lambda s, d: S.course_slots(courses(s, d)),
        "g02_feasible": options,
        "g03_solve": lambda s, d: T.solve(problems(s, d)),
        "o03_most_constrained": lambda s, d: S.most_constrained(options(s, d)),
        "o04_soft_scores": lambda s, d: S.soft_scores(options(s, d), selected(s, d, WISHES, "lineitem")),
    }


def oracle_sql():
    c, t, k = (selected_sql(x, "lineitem") for x in (COURSES, TEACHERS, CLASSES))
    feas = f"""fe AS (SELECT c.id AS course, t.time, count(*) FILTER (r.capacity >= k.size) AS n_rooms FROM {c} c JOIN {t} t ON c.teacher = t.id JOIN {selected_sql(TIMES, "lineitem")} x ON t.time = x.id
 JOIN {k} k ON c.class = k.id LEFT JOIN {selected_sql(ROOMS, "orders", "customer")} r ON r.time = t.time GROUP BY ALL HAVING count(*) FILTER (r.capacity >= k.size) > 0)"""
    return {
        "g01_course_slots": f"""SELECT course, CAST(slot AS INTEGER) AS slot, CAST(CASE WHEN slot < h // n THEN n ELSE h % n END AS INTEGER) AS length FROM (SELECT course, h, n, unnest(range((h + n - 1) // n)) AS slot
 FROM (SELECT id AS course, hours_per_week AS h, greatest(consecutive, 1) AS n FROM {c}))""",
        "g02_feasible": f"WITH {feas} SELECT * FROM fe",
        "o03_most_constrained": f"WITH {feas} SELECT course, count(*) AS n_times FROM fe GROUP BY course",
        "o04_soft_scores": f"""WITH {feas}, p AS (SELECT fe.course, fe.time, wish, CAST(string_split(fe.time, '-')[2] AS INTEGER) AS p FROM fe LEFT JOIN {selected_sql(WISHES, "lineitem")} w ON fe.course = w.course)
 SELECT course, time, round(CAST(coalesce(CASE wish WHEN 'morning' THEN p <= 4 WHEN 'afternoon' THEN p > 4 END, false) AS INTEGER) - p / 10.0::DOUBLE, 3) AS score FROM p""",
    }
