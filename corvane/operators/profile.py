"""Table profiling: column profiles, numeric and categorical statistics, group means, distributions, bins, range specs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import to_number
from corvane.sources.tables import written


def long_form(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, column, value): one scan for all columns, values as text."""
    keys = keys or []
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(*keys, F.explode(cells).alias("_cell")).select(*keys, "_cell.column", "_cell.value")


def column_profile(df: DataFrame, columns: list[str], order: str, samples: int = 3) -> DataFrame:
    """A row a column: rows, nulls, distinct values, and the first distinct values in `order`."""
    cells = long_form(df.withColumn("_order", F.col(order)), columns, ["_order"])
    per = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min("_order").alias("first"))
    counts = per.groupBy("column").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("null_count"), F.count("value").alias("unique_count")
    )
    w = Window.partitionBy("column").orderBy("first", "value")
    ranked = per.where("value is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= samples)  # the limit runs before the shuffle too
    shown = ranked.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]), "|").alias("samples"))
    return counts.join(shown, "column", "left").withColumn("samples", F.coalesce("samples", F.lit("")))


#: Bins of a refinement, and values of a bin that are few enough to be sorted.
BINS = 1 << 16
FEW = 1 << 16


def quantiles(values: DataFrame, probabilities: list[float]) -> DataFrame:
    """values(column, value double) -> (column, probability, value): exact, with linear interpolation between neighbours.

    A quantile is one or two ranks. The range that holds a rank is counted in bins of equal width, the rank's bin is the
    next range, and a range of FEW values or of one value settles it; each pass reads the values once for all columns
    and ranks, and counts before it shuffles, so no task has more than the bins of a rank. Nulls and NaN do not count.
    """
    some = values.where("value is not null and not isnan(value)")
    ends = some.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    asked = F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("probability")
    at = ends.select("column", "n", "lo", "hi", asked).withColumn("_at", F.col("probability") * (F.col("n") - 1))
    at = written(at.select("column", "probability", "n", "lo", "hi", (F.col("_at") - F.floor("_at")).alias("part"), F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("rank")), "asked")
    ranges = at.select("column", "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), "n").distinct()
    done = None
    while True:
        ranges = written(ranges, "ranges")  # a row a column and rank
        settled = ranges.where(F.col("lo") == F.col("hi")).select("column", "rank", F.col("lo").alias("value"))
        few = ranges.where((F.col("lo") < F.col("hi")) & (F.col("n") <= FEW))
        inside = some.join(few, "column").where(F.col("value").between(F.col("lo"), F.col("hi"))).select("column", "rank", "below", "value")
        place = F.row_number().over(Window.partitionBy("column", "rank").orderBy("value"))
        settled = settled.union(inside.withColumn("_place", place + F.col("below")).where(F.col("_place") == F.col("rank") + 1).select("column", "rank", "value"))
        done = settled if done is None else done.union(settled)
        wide = ranges.where((F.col("lo") < F.col("hi")) & (F.col("n") > FEW))
        if wide.isEmpty():
            break
        half = lambda c: F.col(c) / 2  # noqa: E731 - the difference of two doubles may be beyond a double, that of their halves is not
        bin_ = F.least(F.lit(BINS - 1), F.floor((half("value") - half("lo")) / (half("hi") - half("lo")) * BINS))
        counted = some.join(wide.drop("n"), "column").where(F.col("value").between(F.col("lo"), F.col("hi")))
        counted = counted.groupBy("column", "rank", "below", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("column", "rank").orderBy("bin"))
        counted = counted.withColumn("_upto", upto + F.col("below"))
        ranges = counted.where((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("n"))).select("column", "rank", "lo", "hi", (F.col("_upto") - F.col("n")).alias("below"), "n")
    found = at.join(written(done, "found"), ["column", "rank"])
    low, high = F.min("value"), F.max("value")
    return found.groupBy("column", "probability").agg((low * (1 - F.first("part")) + high * F.first("part")).alias("value"))


def medians(values: DataFrame) -> DataFrame:
    """values(column, value double) -> (column, median), exact."""
    return quantiles(values, [0.5]).select("column", F.col("value").alias("median"))


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value double): the columns' values one below the other."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("_cell")).select("_cell.column", "_cell.value")


def numeric_stats(df: DataFrame, columns: list[str], exact_median: bool = True) -> DataFrame:
    """A row a numeric column: count, mean, median, sample deviation, min, max, sum. exact_median: by medians(), else by a sketch."""
    values = numbers(df, columns)
    sketch = [] if exact_median else [F.percentile_approx("value", 0.5, 10000).alias("median")]
    out = values.groupBy("column").agg(
        F.count("value").alias("count"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.sum("value"), 2).alias("sum"), *sketch,
    )
    if exact_median:
        out = out.join(medians(values), "column", "left")
    return out.where("count > 0").select("column", "count", "mean", F.round("median", 4).alias("median"), "std", "min", "max", "sum")


def coerced(df: DataFrame, columns: list[str]) -> DataFrame:
    """Which text columns are numeric (a value coerces): column, values, coerced."""
    cells = long_form(df, columns)
    return cells.groupBy("column").agg(F.count("value").alias("n_values"), F.count(to_number(F.col("value"))).alias("n_numeric")).withColumn("is_numeric", F.col("n_numeric") > 0)


def categorical_stats(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """(column, unique_count, null_count, value, n, rank): the most frequent values, ties by value."""
    per = long_form(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("column").agg(F.count("value").alias("unique_count"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("null_count"))
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    best = per.where("value is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return best.join(whole, "column").select("column", "unique_count", "null_count", "value", "n", "rank")


def group_mean(df: DataFrame, key: str, value: str, digits: int = 4) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.round(F.avg(value), digits).alias("mean")).orderBy(key)


def distribution(df: DataFrame, key: str) -> DataFrame:
    """Counts and percentages of the non-null values."""
    per = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("_total"))
    return per.join(F.broadcast(total)).select(key, "n", F.round(F.col("n") * 100.0 / F.col("_total"), 1).alias("percent"))  # one row is broadcast


def equal_width_bins(df: DataFrame, column: str, bins: int = 5) -> DataFrame:
    """Right-closed bins of equal width, the least value in the first; a constant column is one bin."""
    edge = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    x = F.col(column)
    at = F.when(F.col("_hi") == F.col("_lo"), 1).otherwise(F.greatest(F.lit(1), F.ceil((x - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins))))
    return df.where(x.isNotNull()).join(F.broadcast(edge)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row is broadcast


def apply_range(df: DataFrame, order: str, columns: list[str] | None = None, rows: tuple[int, int] | None = None, filters: dict[str, object] | None = None) -> DataFrame:
    """Columns, then rows by position in `order`, then equality filters; unknown columns and their filters are skipped, no known column keeps all."""
    keep = [c for c in columns or [] if c in df.columns] or df.columns
    out = df.select(*keep, F.col(order).alias("_order"))
    if rows is not None:
        start, end = rows
        first = out.orderBy("_order").limit(end).withColumn("_pos", F.row_number().over(Window.orderBy("_order")))  # `end` rows at most
        out = first.where(F.col("_pos") > start).drop("_pos")
    for c, v in (filters or {}).items():
        if c in keep:
            out = out.where(F.col(c) == F.lit(v))
    return out.select(*keep)


def drop_empty(df: DataFrame) -> DataFrame:
    """Without rows and columns that are all null."""
    out = df.na.drop("all")
    n = out.agg(*[F.count(c).alias(c) for c in out.columns]).first()
    return out.select(*[c for c in out.columns if n[c]])


def preview(df: DataFrame, order: list[str], n: int = 200) -> DataFrame:
    """The first n rows as text, nulls as empty strings."""
    return df.orderBy(*order).limit(n).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def capped(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    return df.orderBy(*order).limit(n)


# fixed values: words of column names that tell a table's subject
SUBJECTS = {
    "finance": ["price", "amount", "cost", "tax", "balance", "acctbal", "discount"],
    "sales": ["order", "customer", "quantity", "segment", "priority"],
    "supply": ["supp", "part", "ship", "retail"],
}


def subject(names: DataFrame, subjects: dict[str, list[str]] = SUBJECTS) -> DataFrame:
    """names(table, column) -> (table, scores per subject, subject): the subject whose words occur most, in name order on ties; none: general."""
    joined = names.groupBy("table").agg(F.concat_ws(" ", F.array_sort(F.collect_list(F.lower("column")))).alias("all"))

    def score(words: list[str]) -> Column:
        out: Column = F.lit(0)
        for w in words:
            out = out + F.contains("all", F.lit(w)).cast("int")
        return out

    keys = sorted(subjects)
    out = joined.select("table", *[score(subjects[k]).alias(f"n_{k}") for k in keys])
    best = F.greatest(*[F.col(f"n_{k}") for k in keys])
    pick = F.when(best == 0, F.lit("general"))
    for k in keys:
        pick = pick.when(F.col(f"n_{k}") == best, F.lit(k))
    return out.withColumn("subject", pick)


def insights(stats: DataFrame) -> DataFrame:
    """Sentences from numeric statistics by the column's name: totals for money, ranges for amounts, bands for scores; null deviations are left out."""
    name = F.lower("column")
    money = name.rlike("price|cost|amount|balance|acctbal")
    count = name.rlike("quantity|size|count")
    share = name.rlike("discount|tax|rate")
    fmt = F.format_string
    text = (
        F.when(money, fmt("%s: total %.2f, mean %.2f", F.col("column"), F.col("sum"), F.col("mean")))
        .when(count, fmt("%s: from %.2f to %.2f", F.col("column"), F.col("min"), F.col("max")))
        .when(share, F.concat(F.col("column"), F.when(F.col("mean") >= 0.05, F.lit(": high")).when(F.col("mean") >= 0.02, F.lit(": middle")).otherwise(F.lit(": low"))))
        .otherwise(F.concat(F.col("column"), F.coalesce(fmt(": deviation %.2f", F.col("std")), F.lit(": one value"))))
    )
    area = F.when(money, "finance").when(count, "sales").when(share, "research").otherwise("general")
    return stats.select("column", area.alias("area"), text.alias("text"))


# fixed values: words of column names in company and in academic tables
COMPANY_WORDS = ["销售", "收入", "成本", "利润", "资产", "负债", "员工", "部门", "客户", "产品", "订单", "发票", "财务", "预算", "工资", "绩效"]
ACADEMIC_WORDS = ["成绩", "分数", "学生", "教师", "课程", "班级", "学期", "考试", "论文", "研究", "实验", "调查", "学分", "年级", "学科"]


def direction(names: DataFrame) -> DataFrame:
    """names(table, column) -> company or academic, whichever has more of its words in the column names; else general."""
    out = subject(names, {"company": COMPANY_WORDS, "academic": ACADEMIC_WORDS})
    c, a = F.col("n_company"), F.col("n_academic")
    return out.select("table", "n_company", "n_academic", F.when(c > a, "company").when(a > c, "academic").otherwise("general").alias("direction"))


# fixed values: of each area, in order, the words of numeric columns with what is reported of them (the first match counts),
# the words of category columns (none: all) and their most values
AREAS: dict[str, tuple[list[tuple[str, list[str]]], str | None, int | None]] = {
    "finance": ([("收入|销售", ["mean"]), ("成本|费用", ["mean"]), ("利润", ["mean"])], "^$", None),
    "sales": ([("销售|金额|收入", ["sum", "mean", "max", "min"])], None, 20),
    "hr": ([("工资|薪资|薪酬", ["mean", "median"]), ("绩效|评分", ["mean"])], "部门|职位", None),
    "grades": ([("成绩|分数|分", ["mean", "std", "band"])], "班级|学科", None),
    "teaching": ([("评分|评价|满意度", ["mean"])], "教师|课程", None),
    "research": ([("", ["mean", "std"])], None, 10),
}


def area_insights(numeric: DataFrame, categories: DataFrame, area: str) -> DataFrame:
    """numeric(pos, column, mean, median, std, min, max, sum), categories(pos, column, unique_count) -> (column, metric, value).

    A missing deviation is left out. Areas without rules report the means and distinct counts of the first three columns.
    Nothing to report: one row that says so.
    """
    band = F.when(F.col("mean") >= 90, "excellent").when(F.col("mean") >= 80, "good").when(F.col("mean") >= 60, "pass").otherwise("fail")
    two = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    name = F.lower("column")
    if area in AREAS:
        rules, words, most = AREAS[area]
        metrics = F.array().cast("array<string>")
        for pattern, wanted in reversed(rules):
            metrics = F.when(name.rlike(pattern) if pattern else F.lit(True), F.array(*[F.lit(m) for m in wanted])).otherwise(metrics)
        cats = categories.where((name.rlike(words) if words else F.lit(True)) & (F.col("unique_count") <= most if most else F.lit(True)))
    else:
        metrics = F.when(F.col("pos") < 3, F.array(F.lit("mean"))).otherwise(F.array().cast("array<string>"))
        cats = categories.where("pos < 3")
    values = numeric.select("column", F.explode(metrics).alias("metric"), *[c for c in ("mean", "median", "std", "min", "max", "sum")])
    value = F.when(F.col("metric") == "band", band)
    for m in ("mean", "median", "std", "min", "max", "sum"):
        value = value.when((F.col("metric") == m) & F.col(m).isNotNull(), two(m))
    out = values.select("column", "metric", value.alias("value")).where("value is not null")
    out = out.union(cats.select("column", F.lit("unique"), F.col("unique_count").cast("string")))
    none = out.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0").select(F.lit("(table)"), F.lit("note"), F.lit("no rule of the area applies"))
    return out.union(none)
