"""Odd documents for all operators: nulls, empty and very long texts, repeated rows and ids, clashing extra columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, rep long, component_id long, line string, template string, leaf long, term string, spans string, kept boolean, start long, n long, copy long, key long"
GOOD = "\n".join(" ".join(f"word{(i * 7 + j * 3) % 211}" for j in range(12)) + "." for i in range(8))
LONG = " ".join(f"w{i * i % 9973}" for i in range(30000))


def texts() -> list[tuple]:
    return [
        (1, GOOD, "en", "a"), (2, GOOD, "en", "a"), (2, GOOD, "en", "a"), (3, None, "en", "a"), (4, "", None, None), (5, " \t\n ", "de", "b"), (6, LONG, "en", "b"),
        (7, "x" * 150000, "en", "b"), (8, "one", "en", "a"), (2, "another text of the same id", "en", "a"), (None, "a row without an id", "fr", "c"), (9, "é　字 \U0001f600 …, naïve, ÉCOLE.", "fr", "c"), (10, "\n\n\n", "en", "a"),
    ]


def documents(spark):
    rows = [(i, t, g, s, None if t is None else len(t), 0, 0, 0, "x", "x", 0, "x", "x", True, 0, 0, 0, 0) for i, t, g, s in texts()]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
