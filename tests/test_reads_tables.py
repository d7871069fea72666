"""Queries that once ran on literal rows read tables."""

from __future__ import annotations

import pytest

from corvane.plans import registry

NAMES = [
    "a14_font_levels",
    "a18_check_summary",
    "a24_slide_content",
    "a25_deck_insights",
    "a25_empty_slides",
    "a27_image_usage",
    "a30_direction",
    "a30_subject",
    "a31_area_finance",
    "a31_area_grades",
    "a31_area_hr",
    "a31_area_other",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_reads_a_table(spark, small, name):
    assert registry.queries()[name](spark, small).inputFiles()
