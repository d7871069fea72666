"""Workflow-shaped operators: error rules, selection by keywords, listings, dashboards, fonts, reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.tables import scratch


def match_errors(errors: DataFrame, rules: DataFrame) -> DataFrame:
    """errors(error_id, step, message) x rules(pos, step, scenario, action): the first rule of the step whose scenario the message contains; none: fail."""
    hits = errors.join(rules.select("step", "pos", "scenario", "action"), "step").where(F.contains("message", F.col("scenario")))
    first = hits.groupBy("error_id").agg(F.min_by("action", "pos").alias("action"))
    return errors.join(first, "error_id", "left").select("error_id", "step", "message", F.coalesce("action", F.lit("fail")).alias("action"))


# fixed values: keyword groups of workflows, in order
WORKFLOWS = [("knowledge", "knowledge|index|summary"), ("spreadsheet", "table|excel|csv"), ("slides", "slide|deck|ppt"), ("document", "format|docx|paper")]


def select_workflow(requests: DataFrame, groups: list[tuple[str, str]] = WORKFLOWS) -> DataFrame:
    pick = F.lit(None).cast("string")
    for name, words in reversed(groups):
        pick = F.when(F.lower("request").rlike(words), name).otherwise(pick)
    return requests.select("request", F.coalesce(pick, F.lit("general")).alias("workflow"))


def exported(files: DataFrame, patterns: tuple[str, ...] = ("node_modules", ".log", "__pycache__")) -> DataFrame:
    """Files that an export takes: no hidden ones, none that equal or end with a pattern."""
    bad = F.col("name").startswith(".")
    for p in patterns:
        bad = bad | F.col("name").endswith(p)
    return files.where(~bad)


def listing(files: DataFrame) -> DataFrame:
    """Folders first, then by name; hidden ones left out. The order is a column."""
    shown = files.where(~F.col("name").startswith("."))
    return shown.withColumn("pos", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("is_dir"), "name")))


def dashboard(files: DataFrame, steps: DataFrame) -> DataFrame:
    """files(project, kind, bytes), steps(project, agent, status): sizes, artifacts, percentage done, and whether documents lack a knowledge base."""
    f = files.groupBy("project").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("kind") == "artifact").alias("n_artifacts"))
    s = steps.groupBy("project").agg(F.floor(F.count_if(F.col("status") == "completed") * 100.0 / F.count(F.lit(1)) + 0.5).alias("percent"), (F.bool_or(F.col("agent") == "document") & ~F.bool_or(F.col("agent") == "knowledge")).alias("lacks_kb"))
    return f.join(s, "project", "full")


def image_usage(images: DataFrame) -> DataFrame:
    """images(part, blob, ratio): one asset per part name, or else per content; uses and sorted distinct ratios."""
    key = F.coalesce("part", F.sha2("blob", 256))
    return images.groupBy(key.alias("asset")).agg(F.count(F.lit(1)).alias("n_uses"), F.array_join(F.array_sort(F.collect_set(F.col("ratio").cast("string"))), ",").alias("ratios"))


def resolve_fonts(wanted: DataFrame, aliases: DataFrame, fallbacks: DataFrame, available: DataFrame) -> DataFrame:
    """wanted(font) -> (font, used): the font, its alias or its fallbacks in order, whichever is there first; else DEFAULT."""
    own = wanted.select("font", F.col("font").alias("candidate"), F.lit(0).alias("prio"))
    other = wanted.join(aliases, "font").select("font", F.col("alias").alias("candidate"), F.lit(1).alias("prio"))
    more = wanted.join(fallbacks, "font").select("font", F.col("fallback").alias("candidate"), (F.col("pos") + 2).alias("prio"))
    there = own.union(other).union(more).join(available.select(F.col("name").alias("candidate")), "candidate", "left_semi")
    best = there.groupBy("font").agg(F.min_by("candidate", "prio").alias("used"))
    return wanted.join(best, "font", "left").select("font", F.coalesce("used", F.lit("DEFAULT")).alias("used"))


def run_steps(steps: DataFrame) -> DataFrame:
    """steps(workflow, pos, id, condition, success, strategy) -> (workflow, pos, id, outcome, progress): what a sequential run makes of them.

    A condition that is false skips the step. A failed step without a strategy, or with fail, ends its workflow and
    the rest is not run; with any other strategy the run goes on. progress: percent of steps before it, cut to an integer.
    """
    w = Window.partitionBy("workflow").orderBy("pos")
    runs = F.coalesce("condition", F.lit(True))
    fatal = runs & ~F.coalesce("success", F.lit(False)) & (F.coalesce("strategy", F.lit("fail")) == "fail")
    stopped = F.coalesce(F.bool_or(fatal).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    outcome = F.when(stopped, "not run").when(~runs, "skipped").when(F.coalesce("success", F.lit(False)), "completed").when(fatal, "failed").otherwise(F.concat(F.lit("error: "), F.col("strategy")))
    progress = F.floor((F.row_number().over(w) - 1) * 100 / F.count(F.lit(1)).over(Window.partitionBy("workflow")))
    return steps.select("workflow", "pos", "id", outcome.alias("outcome"), progress.alias("progress"))


def step_states(events: DataFrame) -> DataFrame:
    """events(project, seq, step, event, output) -> (project, step, completed, failed, output): completing a step ends its failure, failing it does not undo its completion; the last output counts, of a failure its error."""
    kind = F.col("event")
    own = events.where(kind.isin("completed", "failed"))
    out = F.when(kind == "failed", F.concat(F.lit("error: "), F.coalesce("output", F.lit("")))).otherwise(F.nullif("output", F.lit("")))
    return own.groupBy("project", "step").agg(
        F.bool_or(kind == "completed").alias("completed"), (F.max_by("event", "seq") == "failed").alias("failed"), F.max_by(out, F.when(out.isNotNull(), F.col("seq"))).alias("output")
    )


def chosen_config(choices: DataFrame, structures: DataFrame, visuals: DataFrame, focuses: DataFrame, defaults: tuple[str, str, str]) -> DataFrame:
    """choices(project, type, style, track) -> structure by type and track, visual by style, focus by track; what was not chosen, or has no entry, is that of the defaults (type, style, track)."""
    own = choices.select("project", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in zip(("type", "style", "track"), defaults, strict=True)])
    out = own.join(structures, ["type", "track"], "left").join(visuals, "style", "left").join(focuses, "track", "left")
    kind, style, track = defaults
    base = structures.where((F.col("type") == kind) & (F.col("track") == track)).select(F.col("structure").alias("_s"))
    base = base.join(visuals.where(F.col("style") == style).select(F.col("visual").alias("_v"))).join(focuses.where(F.col("track") == track).select(F.col("focus").alias("_f")))  # one row
    out = out.join(base, how="left")
    return out.select("project", "type", "style", "track", F.coalesce("structure", "_s").alias("structure"), F.coalesce("visual", "_v").alias("visual"), F.coalesce("focus", "_f").alias("focus"))


def core_points(points: DataFrame, most: int = 5, chars: int = 15) -> DataFrame:
    """points(page, pos, text): the first `most` of each page, cut to `chars` characters."""
    rank = F.row_number().over(Window.partitionBy("page").orderBy("pos"))
    return points.withColumn("rank", rank).where(F.col("rank") <= most).select("page", "rank", F.substring("text", 1, chars).alias("text"))


def deep_merge(base: DataFrame, override: DataFrame) -> DataFrame:
    """base, override(config, path, value), a row a leaf, paths with dots -> the nested union: a leaf of the override takes the place of the base's leaf or subtree at its path, and of a leaf above it."""
    def above(df: DataFrame) -> DataFrame:
        parts = F.split("path", r"\.")
        return df.select("config", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("upper"))

    hidden = above(base).join(override.select("config", F.col("path").alias("upper")), ["config", "upper"]).select("config", "path")
    under = above(override).select("config", F.col("upper").alias("path"))
    return base.join(hidden.union(under).distinct(), ["config", "path"], "left_anti").select("config", "path", "value").union(override.select("config", "path", "value"))


def reachable(roots: DataFrame, edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """Parts reachable from roots(part) over edges(source, target): frontier joins until nothing is new, so cycles end.

    Each round writes its frontier alone. A closure that is not done after most_rounds is an error, never a part of it.
    """
    spark = roots.sparkSession
    path = scratch(spark, "reached")
    steps = edges.select(F.col("source").alias("_source"), F.col("target").alias("part")).where("_source is not null and part is not null").distinct()
    roots.select("part").where("part is not null").distinct().write.parquet(f"{path}/round=0")
    n = 0
    while True:
        n += 1
        seen = spark.read.schema("part string").parquet(*[f"{path}/round={k}" for k in range(n)])
        front = spark.read.schema("part string").parquet(f"{path}/round={n - 1}").withColumnRenamed("part", "_source")
        front.join(steps, "_source").select("part").distinct().join(seen, "part", "left_anti").write.parquet(f"{path}/round={n}")
        if spark.read.schema("part string").parquet(f"{path}/round={n}").isEmpty():
            return seen
        if most_rounds is not None and n > most_rounds:
            raise RuntimeError(f"still growing after {most_rounds} rounds")
