"""Document format rules: issue rows, grades, reports, configuration checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.tables import written

ISSUE = ["doc_id", "category", "severity", "rule", "expected", "actual", "location"]


def _issue(df: DataFrame, when: Column, category: str, severity: str, rule: Column | str, expected: Column | str, actual: Column, location: Column) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.where(when).select("doc_id", F.lit(category).alias("category"), F.lit(severity).alias("severity"), lit(rule).alias("rule"), lit(expected).alias("expected"), actual.cast("string").alias("actual"), location.alias("location"))


def page_issues(sections: DataFrame, page: tuple[float, float] = (21.0, 29.7), margins: dict[str, float] | None = None) -> DataFrame:
    """sections(doc_id, w_cm, h_cm, top_cm, ...): size off by more than 0.5 cm, margins by more than 0.3 cm."""
    margins = margins or {"top": 2.5, "bottom": 2.5, "left": 3.0, "right": 2.5}
    sides = [("width", "w_cm", page[0], 0.5), ("height", "h_cm", page[1], 0.5), *[(k, f"{k}_cm", v, 0.3) for k, v in margins.items()]]
    cells = F.array(*[F.struct(F.lit(n).alias("side"), F.col(c).alias("actual"), F.lit(v).alias("expected"), F.lit(t).alias("limit")) for n, c, v, t in sides])
    rows = sections.select("doc_id", F.inline(cells))
    severity = F.when(F.col("side").isin("width", "height"), "critical").otherwise("warning")
    return rows.where(F.abs(F.col("actual") - F.col("expected")) > F.col("limit")).select("doc_id", F.lit("page").alias("category"), severity.alias("severity"), "side", "expected", "actual")


def font_issues(paragraphs: DataFrame, rules: DataFrame) -> DataFrame:
    """paragraphs(doc_id, pos, style, runs array<struct<text, font, size, bold>>) against rules(style, prio, font, size, bold).

    The rule of the paragraph's own style counts, else that of body. Empty runs are not checked.
    """
    own = paragraphs.join(rules, "style", "left")
    body = rules.where("style = 'body'").select(F.col("font").alias("_f"), F.col("size").alias("_s"), F.col("bold").alias("_b"))
    p = own.join(F.broadcast(body)).select("doc_id", "pos", F.coalesce("font", "_f").alias("font"), F.coalesce("size", "_s").alias("size"), F.coalesce("bold", "_b").alias("bold"), F.explode("runs").alias("r"))  # one rule is broadcast
    p = p.where(F.trim("r.text") != "")
    checks = F.array(
        F.struct(F.lit("font").alias("rule"), (F.col("r.font") != F.col("font")).alias("bad"), F.col("font").alias("expected"), F.col("r.font").alias("actual")),
        F.struct(F.lit("size").alias("rule"), (F.abs(F.col("r.size") - F.col("size")) > 0.5).alias("bad"), F.col("size").cast("string").alias("expected"), F.col("r.size").cast("string").alias("actual")),
        F.struct(F.lit("bold").alias("rule"), (F.col("r.bold") != F.col("bold")).alias("bad"), F.col("bold").cast("string").alias("expected"), F.col("r.bold").cast("string").alias("actual")),
    )
    return p.select("doc_id", "pos", F.inline(checks)).where("bad").drop("bad")


def paragraph_issues(paragraphs: DataFrame, alignment: str = "both", line: float = 1.5) -> DataFrame:
    """paragraphs(doc_id, pos, alignment, line, first_line, first_line_chars): alignment, spacing within 0.1, indent of two characters or 20 points."""
    indent = (F.coalesce("first_line_chars", F.lit(0.0)) >= 2) | (F.coalesce("first_line", F.lit(0.0)) >= 20)
    where = F.concat(F.lit("p"), F.col("pos").cast("string"))
    return (
        _issue(paragraphs, F.coalesce("alignment", F.lit("left")) != alignment, "paragraph", "warning", "alignment", alignment, F.coalesce("alignment", F.lit("left")), where)
        .union(_issue(paragraphs, F.abs(F.col("line") - line) > 0.1, "paragraph", "warning", "line", F.lit(str(line)), F.col("line"), where))
        .union(_issue(paragraphs, ~indent, "paragraph", "critical", "indent", "2 characters", F.coalesce("first_line_chars", F.lit(0.0)), where))
    )


def table_issues(cells: DataFrame) -> DataFrame:
    """cells(doc_id, table_id, row, col, top, bottom, side, font): a three-line table has rules above and below the head and below the last row, and none between columns."""
    last = cells.groupBy("doc_id", "table_id").agg(F.max("row").alias("_last"))
    c = cells.join(last, ["doc_id", "table_id"])
    r = F.col("row")
    bad = F.array_compact(
        F.array(
            F.when((r == 0) & ~F.col("top"), "no top line"), F.when((r == 0) & ~F.col("bottom"), "no head line"), F.when((r == F.col("_last")) & ~F.col("bottom"), "no bottom line"), F.when(F.col("side"), "side line")
        )
    )
    return c.select("doc_id", "table_id", "row", "col", F.explode(bad).alias("rule"))


def grade(issues: DataFrame) -> DataFrame:
    """issues(doc_id, severity) -> (doc_id, n_critical, n_warning, grade)."""
    n = issues.groupBy("doc_id").agg(F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count_if(F.col("severity") == "warning").alias("n_warning"))
    c, w = F.col("n_critical"), F.col("n_warning")
    return n.withColumn("grade", F.when(c > 5, "D").when(c > 2, "C").when((c > 0) | (w > 5), "B").when(w > 0, "A-").otherwise("A"))


def report_status(messages: DataFrame) -> DataFrame:
    """messages(doc_id, severity) -> FAIL with an ERROR, WARN with a WARNING, else PASS, and the tallies."""
    n = messages.groupBy("doc_id").agg(F.count_if(F.col("severity") == "ERROR").alias("n_error"), F.count_if(F.col("severity") == "WARNING").alias("n_warning"), F.count_if(F.col("severity") == "INFO").alias("n_info"))
    return n.withColumn("status", F.when(F.col("n_error") > 0, "FAIL").when(F.col("n_warning") > 0, "WARN").otherwise("PASS"))


def by_category(issues: DataFrame) -> DataFrame:
    return issues.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count_if(F.col("severity") == "warning").alias("n_warning"))


def normalised_style(paragraphs: DataFrame) -> DataFrame:
    """paragraphs(doc_id, pos, region, style, alignment, font, size) -> alignment, font and size that the format wants; covers and contents stay."""
    keep = F.col("region").isin("cover", "toc")
    level = F.regexp_extract("style", r"^Heading ([1-3])$", 1)
    size = F.when(level == "1", 16.0).when(level == "2", 14.0).when(level == "3", 12.0).otherwise(10.5)
    align = F.when(level == "1", "center").when(level != "", "left").otherwise("both")
    font = F.when(level != "", "SimHei").otherwise("SimSun")
    pick = lambda old, new: F.when(keep, F.col(old)).otherwise(new).alias(old)
    return paragraphs.select("doc_id", "pos", pick("alignment", align), pick("font", font), pick("size", size))


def merged_style(paragraphs: DataFrame, styles: DataFrame) -> DataFrame:
    """A paragraph's own non-empty values override those of its style."""
    s = styles.select(F.col("style_id"), F.col("font").alias("_font"), F.col("size").alias("_size"))
    return paragraphs.join(s, "style_id", "left").select("doc_id", "pos", F.coalesce(F.nullif("font", F.lit("")), "_font").alias("font"), F.coalesce("size", "_size").alias("size"))


def xml_checks(relationships: DataFrame) -> DataFrame:
    """relationships(part, rel_id, target) -> number, repeated ids and empty targets of each part."""
    return relationships.groupBy("part").agg(F.count(F.lit(1)).alias("n"), (F.count("rel_id") - F.count_distinct("rel_id")).alias("n_repeated"), F.count_if(F.coalesce("target", F.lit("")) == "").alias("n_empty"))


def workflow_issues(steps: DataFrame) -> DataFrame:
    """steps(workflow, pos, id, name, type): required fields that are missing, unknown types."""
    missing = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "no id"), F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "no name"),
            F.when(~F.coalesce("type", F.lit("")).isin("scheduler", "preprocessing", "agent"), "unknown type"),
        )
    )
    return steps.select("workflow", "pos", F.explode(missing).alias("problem"))


def idea_verdict(ideas: DataFrame) -> DataFrame:
    """ideas(idea, fatal_flaw, scores array<int>): a fatal flaw rejects, a total from 20 accepts, else revise."""
    total = F.aggregate("scores", F.lit(0), lambda a, x: a + x)
    return ideas.select("idea", total.alias("total"), F.when(F.col("fatal_flaw"), "reject").when(total >= 20, "accept").otherwise("revise").alias("verdict"))


def summary_report(docs: DataFrame, reports: dict[str, DataFrame]) -> DataFrame:
    """docs(doc_id) with a count column per report (doc_id, n); missing ones are 0."""
    out = docs
    for name, r in reports.items():
        out = out.join(r.select("doc_id", F.col("n").alias(name)), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    total = sum((F.col(n) for n in reports), F.lit(0))
    return out.withColumn("total", total.cast("long"))


def inspect_and_fix(docs: DataFrame, inspect: Callable[[DataFrame], DataFrame], fix: Callable[[DataFrame, DataFrame], DataFrame], most_rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(docs after the fixes, rounds(doc_id, round, rule, n)): inspect, fix and inspect again, until all grades are A or A- or nothing more can be fixed, at most so many rounds.

    inspect: issues(doc_id, severity, rule) of docs; fix: docs with the repairs of todo(doc_id, rule). A round mends one
    rule of each document that is not good enough, critical ones first, then by name; each round's documents are written.
    """
    history = None
    for n in range(1, most_rounds + 1):
        issues = written(inspect(docs), "issues")
        poor = grade(issues).where("grade not in ('A', 'A-')").select("doc_id")
        per = issues.join(poor, "doc_id").groupBy("doc_id", "rule").agg(F.min("severity").alias("severity"), F.count(F.lit(1)).alias("n"))
        first = per.groupBy("doc_id").agg(F.min(F.struct("severity", "rule", "n")).alias("f"))  # critical comes before warning
        todo = written(first.select("doc_id", F.lit(n).alias("round"), "f.rule", "f.n"), "todo")
        if todo.isEmpty():
            break
        docs = written(fix(docs, todo.select("doc_id", "rule")), "fixed")
        history = todo if history is None else history.union(todo)
    return docs, history if history is not None else docs.sparkSession.createDataFrame([], "doc_id long, round int, rule string, n long")


def fix_paragraphs(paragraphs: DataFrame, todo: DataFrame, alignment: str = "both", line: float = 1.5) -> DataFrame:
    """paragraphs as paragraph_issues() takes them, with the rule that todo(doc_id, rule) names mended."""
    out = paragraphs.join(todo, "doc_id", "left")
    rule = F.coalesce("rule", F.lit(""))
    new = {"alignment": F.when(rule == "alignment", F.lit(alignment)), "line": F.when(rule == "line", F.lit(line)), "first_line_chars": F.when(rule == "indent", F.lit(2.0))}
    return out.select(*[F.coalesce(new[c], F.col(c)).alias(c) if c in new else F.col(c) for c in paragraphs.columns])
