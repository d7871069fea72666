"""The stream's last states equal the batch fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.sources.tables import load
from corvane.streaming import progress as G


def test_stream_equals_batch(spark, small, tmp_path):
    lines = G.log_lines(load(spark, small, "events").orderBy("event_id"))
    lines.orderBy(F.monotonically_increasing_id()).coalesce(1).write.text(str(tmp_path / "in"))
    G.run_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    same(spark, tmp_path, G.fold(G.parse(lines)))


def same(spark, path, batch):
    last = G.last_states(spark, str(path / "out"))
    assert batch.count() > 0
    assert batch.select(last.columns).exceptAll(last).count() == last.exceptAll(batch.select(last.columns)).count() == 0


def test_a_hot_task_in_many_chunks_and_late_events(spark, tmp_path):
    """Events of one task in shuffled order, over chunks of 50 rows and over three micro-batches whose create came first."""
    import json
    import random

    draw = random.Random(4)
    rows = [{"type": "create", "task_id": "hot", "seq": 0}, {"type": "create", "task_id": "cold", "seq": 1}]
    rows += [{"type": draw.choice(["start", "progress", "complete", "fail", "skip"]), "task_id": "hot" if draw.random() < 0.9 else "cold", "step_id": f"s{draw.randrange(20)}", "percent": draw.randint(-5, 120), "seq": k} for k in range(2, 3000)]
    rows += [{"type": "progress", "task_id": "never", "step_id": "s", "seq": 5}]
    late = rows[2:]
    draw.shuffle(late)
    (tmp_path / "in").mkdir()
    for k, part in enumerate([[*rows[:2], *late[:900]], late[900:2000], late[2000:]]):
        (tmp_path / "in" / f"{k}.log").write_text("".join(G.PREFIX + json.dumps(r) + "\n" for r in part))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        try:
            G.run_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3
    same(spark, tmp_path, G.fold(G.parse(spark.read.text(str(tmp_path / "in")))))


def test_broken_lines_are_ignored(spark):
    df = spark.createDataFrame([("@progress {bad",), ("@progress {\"type\": \"create\", \"task_id\": \"t\", \"seq\": 1}",), ("hello",)], "value string")
    assert [r.task_id for r in G.parse(df).collect()] == ["t"]


def test_a_new_create_resets(spark):
    rows = [("create", "t", None, None, 1), ("start", "t", "s", None, 2), ("create", "t", None, None, 3), ("progress", "t", "s", 90, 4), ("start", "t", "s", None, 5), ("progress", "t", "s", 10, 6), ("progress", "u", "s", 10, 7)]
    df = spark.createDataFrame([(*r[:4], None, r[4]) for r in rows], G.SCHEMA.replace("percent long", "percent long"))
    assert [tuple(r) for r in G.fold(df).collect()] == [("t", "running", 10, 4)]


def test_states(spark):
    rows = [("create", "a", None, 1), ("start", "a", "s", 2), ("fail", "a", "s", 3), ("create", "b", None, 4), ("start", "b", "s", 5), ("fail", "b", "s", 6), ("start", "b", "t", 7), ("create", "c", None, 8), ("task_complete", "c", None, 9)]
    df = spark.createDataFrame([(k, t, s, None, None, q) for k, t, s, q in rows], G.SCHEMA)
    assert {tuple(r) for r in G.fold(df).collect()} == {("a", "failed", 100, 3), ("b", "running", 50, 4), ("c", "completed", 100, 2)}
