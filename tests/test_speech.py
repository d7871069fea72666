"""What is said of courses' times."""

from __future__ import annotations

from corvane.plans import registry


def test_forms_of_speech_are_told_once(spark, small):
    df = registry.queries()["f24_speech"](spark, small)
    assert df.columns == ["t", "n", "wish"]
    assert sorted(map(tuple, df.collect())) == [("2 consecutive, prefers morning", 2, "morning"), ("must not clash", 1, ""), ("should avoid Friday; prefer afternoon", 1, "afternoon"), ("x", 1, "")]
