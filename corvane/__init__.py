"""Spark-first analytics over tables, documents, slide decks, timetables and event streams."""
