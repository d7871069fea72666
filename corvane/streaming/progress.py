"""Progress events: line framing, per-task fold in batch and as a stream, step tracking."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "@progress "
SCHEMA = "type string, task_id string, step_id string, percent long, message string, seq long"


def parse(lines: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """lines(value) -> events; other lines and broken JSON are ignored."""
    own = lines.where(F.col("value").startswith(prefix))
    event = F.from_json(F.substr("value", F.lit(len(prefix) + 1)), SCHEMA)
    return own.select(event.alias("e")).where("e.type is not null and e.task_id is not null").select("e.*")


def fold(events: DataFrame) -> DataFrame:
    """(task_id, status, percent, n_events): events count from the task's last create on; tasks never created are ignored.

    create, start and the task events set the status, a failed step makes the task failed until a step starts. Steps
    are known from their first start; completed, failed and skipped ones count 100. Percent is the floor of the steps'
    mean; of a completed task 100.
    """
    created = events.where("type = 'create'").groupBy(F.col("task_id").alias("_task")).agg(F.max("seq").alias("_from"))
    live = events.join(created, (events["task_id"] == F.col("_task")) & (events["seq"] >= F.col("_from"))).drop("_task", "_from")
    step = live.where("step_id is not null and type in ('start', 'progress', 'complete', 'fail', 'skip')")
    value = F.when(F.col("type") == "start", 0).when(F.col("type") == "progress", F.least(F.greatest(F.coalesce("percent", F.lit(0)), F.lit(0)), F.lit(100))).otherwise(100)
    known = step.groupBy("task_id", "step_id").agg(F.min(F.when(F.col("type") == "start", F.col("seq"))).alias("_first"), F.max_by(value, "seq").alias("p"), F.max("seq").alias("_last"))
    mean = known.where("_first is not null").groupBy("task_id").agg(F.floor(F.sum(F.when(F.col("_last") >= F.col("_first"), F.col("p")).otherwise(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("percent"))
    state = F.when(F.col("type").isin("create", "start"), "running").when(F.col("type") == "task_complete", "completed").when(F.col("type").isin("fail", "task_fail"), "failed")
    tasks = live.groupBy("task_id").agg(F.max_by(state, F.when(state.isNotNull(), F.col("seq"))).alias("status"), F.count(F.lit(1)).alias("n_events"))
    out = tasks.join(mean, "task_id", "left")
    return out.select("task_id", "status", F.when(F.col("status") == "completed", 100).otherwise(F.coalesce("percent", F.lit(0))).cast("long").alias("percent"), "n_events")


def _folded(s: dict | None, events) -> dict | None:
    """The state of a task after more events, in any order: what fold() needs of them, a few numbers a step.

    created: sequence number of the last create, before which nothing counts; steps: first start, last event and its
    percent; status: the last event that sets one.
    """
    creates = events["seq"][events["type"] == "create"]
    if len(creates) and (s is None or creates.max() > s["created"]):
        s = {"created": int(creates.max()), "steps": {}, "status": [-1, None], "n": 0}
    if s is None:
        return None
    live = events[events["seq"] >= s["created"]].sort_values("seq", kind="stable")
    s["n"] += len(live)
    for kind, task, q in zip(live["type"], live["step_id"], live["seq"], strict=True):
        state = {"create": "running", "start": "running", "task_complete": "completed", "fail": "failed", "task_fail": "failed"}.get(kind)
        if state and q > s["status"][0]:
            s["status"] = [int(q), state]
        if isinstance(task, str) and kind == "start":
            first = s["steps"].setdefault(task, [None, -1, 0])[0]
            s["steps"][task][0] = int(q) if first is None else min(first, int(q))
    steps = live[live["step_id"].notna() & live["type"].isin(["start", "progress", "complete", "fail", "skip"])].drop_duplicates("step_id", keep="last")
    for kind, step, percent, q in zip(steps["type"], steps["step_id"], steps["percent"], steps["seq"], strict=True):
        known = s["steps"].setdefault(step, [None, -1, 0])
        if q > known[1]:
            known[1] = int(q)
            known[2] = 0 if kind == "start" else min(100, max(0, int(percent))) if kind == "progress" and percent == percent else 0 if kind == "progress" else 100
    return s


def fold_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The same fold over a stream of events (update mode), with a state of a few numbers a step for each task.

    Events of a micro-batch are taken together, whatever chunks they come in, and late ones count by their sequence
    number; only a new create that comes after a later micro-batch's events forgets those. idle_ms: states without
    events for so long go; a task that then goes on counts from its next create. With it the query looks for idle
    states for ever, so it suits triggers that run on, and not one that ends with the input.
    """
    import json

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = _folded(json.loads(state.get[0]) if state.exists else None, pd.concat([b[["type", "step_id", "percent", "seq"]] for b in batches]))
        if s is None:
            return
        state.update((json.dumps(s),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        known = [p if last >= first else 0 for first, last, p in s["steps"].values() if first is not None]
        p = 100 if s["status"][1] == "completed" else sum(known) // max(len(known), 1)
        yield pd.DataFrame({"task_id": [key[0]], "status": [s["status"][1]], "percent": [p], "n_events": [s["n"]]})

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("task_id").applyInPandasWithState(update, "task_id string, status string, percent long, n_events long", "state string", "update", timeout)


def run_stream(spark: SparkSession, path: str, out: str, checkpoint: str, files: int = 1000) -> None:
    """Fold a folder of progress logs as far as it goes, `files` at a time; a micro-batch's states are a folder batch=number of out, written anew if the batch is run again."""
    events = parse(spark.readStream.format("text").option("maxFilesPerTrigger", files).load(path))

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    fold_stream(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()


def last_states(spark: SparkSession, out: str) -> DataFrame:
    """(task_id, status, percent, n_events): each task's state by the last micro-batch that had events of it."""
    rows = spark.read.schema("task_id string, status string, percent long, n_events long, batch long").option("basePath", out).parquet(out)
    return rows.groupBy("task_id").agg(F.max_by(F.struct("status", "percent", "n_events"), "batch").alias("s")).select("task_id", "s.*")


def log_lines(events: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """The driver's events as progress lines: one task a user, one step an hour; some lines are no progress."""
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "click", "start").otherwise("progress")
    body = F.struct(kind.alias("type"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("task_id"), F.when(kind != "create", F.date_format("ts", "HH")).alias("step_id"), F.floor("value").alias("percent"), F.col("event_id").alias("seq"))
    return events.select(F.when(F.col("value").between(13, 14), F.lit("noise")).otherwise(F.concat(F.lit(prefix), F.to_json(body))).alias("value"))


def tracked_steps(events: DataFrame) -> DataFrame:
    """Step table of all tasks: last type, percent and times seen."""
    return events.where("step_id is not null").groupBy("task_id", "step_id").agg(F.max_by("type", "seq").alias("last_type"), F.max_by("percent", "seq").alias("last_percent"), F.count(F.lit(1)).alias("n"))
