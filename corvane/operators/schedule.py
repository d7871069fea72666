"""Timetables: text parsing, course slots, feasibility, validation, statistics, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri"]
PERIODS = 8


def time_slots(text: Column) -> Column:
    """Slot ids of a day's a-b range, its morning (1-4), afternoon (5-8) or whole; no day: ['all']. Repeats stay."""
    found = F.regexp_extract_all(text, F.lit(r"((?:Mon|Tue|Wed|Thu|Fri)(?: (?:[0-9]-[0-9]|morning|afternoon))?)"), 1)

    def slots(x: Column) -> Column:
        day, span = F.substring(x, 1, 3), F.substring(x, 5, 100)
        a = F.when(span == "afternoon", 5).when(span.rlike("^[0-9]"), F.substring(span, 1, 1).try_cast("int")).otherwise(1)
        b = F.when(span == "morning", 4).when(span.rlike("^[0-9]"), F.substring(span, 3, 1).try_cast("int")).otherwise(PERIODS)
        return F.transform(F.sequence(a, b), lambda p: F.concat(day, F.lit("-"), p.cast("string")))

    return F.when(F.size(found) == 0, F.array(F.lit("all"))).otherwise(F.flatten(F.transform(found, slots)))


def consecutive(text: Column) -> Column:
    got = F.regexp_extract(text, r"([0-9])\s*consecutive", 1)
    return F.when(got != "", got.try_cast("int")).otherwise(1)


def preference(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike("prefer[a-z]* morning"), "morning").when(t.rlike("prefer[a-z]* afternoon"), "afternoon")


def table_rows(text: Column) -> Column:
    """Cells of a pipe table's data rows: the head and the rule below it are skipped, empty cells keep their places."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x).startswith("|") & ~x.rlike(r"^[\s|:-]+$"))
    cells = F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    return F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0)))


def classify_constraint(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike("must|never|not allowed|conflict"), "hard").when(t.rlike("prefer|should|avoid"), "soft").otherwise("other")


def course_slots(courses: DataFrame) -> DataFrame:
    """courses(id, hours_per_week, consecutive) -> (course, slot, length): groups of consecutive hours and one for the rest; each takes one time slot."""
    c = courses.withColumn("_h", F.coalesce("hours_per_week", F.lit(2))).withColumn("_k", F.greatest(F.coalesce("consecutive", F.lit(1)), F.lit(1)))
    whole, rest = F.floor(F.col("_h") / F.col("_k")).cast("int"), F.col("_h") % F.col("_k")
    lengths = F.concat(F.array_repeat(F.col("_k"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    return c.select(F.col("id").alias("course"), F.posexplode(lengths).alias("slot", "length"))


def named(courses: DataFrame, people: DataFrame, name: str, out: str) -> DataFrame:
    """The id of a name, the last one of repeated names, or the name itself."""
    last = people.groupBy("name").agg(F.max_by("id", "pos").alias("_id"))
    return courses.join(last, courses[name] == last["name"], "left").drop("name").withColumn(out, F.coalesce("_id", F.col(name))).drop("_id")


def feasible(courses: DataFrame, teachers: DataFrame, rooms: DataFrame, classes: DataFrame, times: DataFrame) -> DataFrame:
    """(course, time, n_rooms): times when the teacher is available and rooms that are free then and large enough."""
    t = teachers.select(F.col("id").alias("teacher"), F.explode("available").alias("time"))
    base = courses.join(t, "teacher").join(times.select(F.col("id").alias("time")), "time").join(classes.select(F.col("id").alias("class"), "size"), "class")
    r = rooms.select(F.col("id").alias("room"), "capacity", F.explode("available").alias("time"))
    both = base.join(r, "time", "left")
    return both.groupBy(F.col("course"), "time").agg(F.count_if(F.col("capacity") >= F.col("size")).alias("n_rooms")).where("n_rooms > 0")


def most_constrained(options: DataFrame) -> DataFrame:
    """(course, n_times): fewest feasible times first."""
    return options.groupBy("course").agg(F.count(F.lit(1)).alias("n_times")).orderBy("n_times", "course")


def soft_scores(options: DataFrame, wishes: DataFrame) -> DataFrame:
    """(course, time, score): one for the wished half of the day, a tenth less for each period into the day."""
    p = F.element_at(F.split("time", "-"), 2).cast("int")
    hit = F.when(F.col("wish") == "morning", p <= 4).when(F.col("wish") == "afternoon", p > 4).otherwise(F.lit(False))
    x = options.join(wishes, "course", "left")
    return x.select("course", "time", F.round(F.coalesce(hit, F.lit(False)).cast("double") - p / 10.0, 3).alias("score"))


def violations(assignments: DataFrame, keys: list[str], time: str) -> DataFrame:
    """(kind, who, time, n): repeats beyond the first of anyone at one time, all kinds in one pass."""
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("who")) for k in keys])
    x = assignments.select(F.col(time).alias("time"), F.inline(cells)).where("who is not null and time is not null")
    return x.groupBy("kind", "who", "time").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")


def statistics(assignments: DataFrame, wishes: DataFrame) -> DataFrame:
    """assignments(teacher, hours, period): hours, placed, unplaced and the share of wished halves; 1.0 without wish or hours."""
    x = assignments.join(wishes, "teacher", "left")
    hit = F.when(F.col("wish") == "morning", F.col("period") <= 4).when(F.col("wish") == "afternoon", F.col("period") > 4)
    return x.groupBy("teacher").agg(
        F.sum(F.coalesce("hours", F.lit(2))).alias("hours"), F.count("period").alias("assigned"), F.count_if(F.col("period").isNull()).alias("unassigned"),
        F.round(F.coalesce(F.avg(hit.cast("double")), F.lit(1.0)), 2).alias("satisfaction"),
    )


def view(assignments: DataFrame, by: str) -> DataFrame:
    """(by, period, Mon .. Fri): the first course, in name order, of each cell."""
    return assignments.groupBy(by, "period").pivot("day", DAYS).agg(F.min("course"))
