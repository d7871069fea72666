"""Slide decks and fill plans: sections, key points, page types, insights, capacity of text slots, plan checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import truncate, visual_width


def outline(slides: DataFrame) -> DataFrame:
    """slides(deck, n, title) -> (deck, n, title, section, section_title, ordinal): numbered titles open sections, dense ids from 1.

    A numbered title equal to the current section's continues it; slides before the first one belong to a default section.
    """
    w = Window.partitionBy("deck").orderBy("n")
    opens = F.col("title").rlike(r"^[0-9]{2}\s+.+")
    s = slides.withColumn("_own", F.when(opens, F.col("title"))).withColumn("section_title", F.last("_own", ignorenulls=True).over(w))
    s = s.withColumn("section_title", F.coalesce("section_title", F.lit("(default)")))
    change = ~F.col("section_title").eqNullSafe(F.lag("section_title").over(w))
    s = s.withColumn("section", F.sum(change.cast("int")).over(w))
    return s.withColumn("ordinal", F.row_number().over(Window.partitionBy("deck", "section").orderBy("n"))).select("deck", "n", "title", "section", "section_title", "ordinal")


def key_points(texts: DataFrame, most: int = 8, least: int = 8) -> DataFrame:
    """texts(deck, n, pos, text) -> the first texts of a slide that are long enough, shortened. Notes: at most 2 of 11 characters or more."""
    w = Window.partitionBy("deck", "n").orderBy("pos")
    return texts.where(F.length("text") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("deck", "n", "rank", truncate(F.col("text")).alias("point"))


# fixed values: words of the page types
THANKS = r"thank|thanks|q&a|qa|contact|致谢|谢谢|感谢|答疑|联系方式"
AGENDA = r"agenda|contents|content|outline|目录|议程"
CHAPTERS = r"chapter|part|section|章节|部分"


def page_types(slides: DataFrame) -> DataFrame:
    """slides(deck, n, text, n_slots): cover first, ending last or by its words, then contents and chapter by words, sparse pages chapter, else content."""
    w = Window.partitionBy("deck")
    first, last = F.min("n").over(w), F.max("n").over(w)
    t = F.lower("text")
    kind = (
        F.when(F.col("n") == first, "cover").when((F.col("n") == last) | t.rlike(THANKS), "ending").when(t.rlike(AGENDA), "toc").when(t.rlike(CHAPTERS), "chapter")
        .when((F.col("n_slots") <= 2) & (F.length("text") <= 80), "chapter").otherwise("content")
    )
    return slides.select("deck", "n", kind.alias("page_type"))


def slot_roles(slots: DataFrame) -> DataFrame:
    """slots(slide, slot_id, shape_name, text, top, n_text): title first, by its name, or high up with up to 80 characters; body from four texts or 120 characters; else label."""
    order = F.row_number().over(Window.partitionBy("slide").orderBy("slot_id"))
    name, n = F.lower(F.coalesce("shape_name", F.lit(""))), F.length(F.coalesce("text", F.lit("")))
    role = F.when((order == 1) | name.rlike("title|标题") | ((F.col("top") < 160) & (n <= 80)), "title").when((F.col("n_text") >= 4) | (n >= 120), "body").otherwise("label")
    return slots.select("slide", "slot_id", role.alias("role"))


def rollup_content(decks: DataFrame) -> DataFrame:
    """decks with slides array<struct<slide_number, title, texts, notes, tables, charts, images>> -> counts by slide."""
    s = decks.select("deck", F.explode("slides").alias("s"))
    return s.select(
        "deck", F.col("s.slide_number").alias("n"), F.size("s.texts").alias("n_texts"), F.size("s.tables").alias("n_tables"), F.size("s.charts").alias("n_charts"), F.size("s.images").alias("n_images"), F.size("s.notes").alias("n_notes"),
        F.aggregate("s.tables", F.lit(0).cast("long"), lambda a, t: a + t["row_count"]).alias("n_rows"), F.aggregate("s.tables", F.lit(0).cast("long"), lambda a, t: a + t["col_count"]).alias("n_cols"),
    )


def deck_insights(content: DataFrame, notes: DataFrame) -> DataFrame:
    """content as by rollup_content, notes(deck, n_points, n_warnings) -> strengths by what is there, gaps for failed pages and under five key points, a recommendation without tables and charts."""
    has = content.groupBy("deck").agg(F.bool_or(F.col("n_tables") > 0).alias("t"), F.bool_or(F.col("n_charts") > 0).alias("c"), F.bool_or(F.col("n_notes") > 0).alias("o"))
    x = has.join(notes, "deck", "left")
    strengths = F.array_compact(F.array(F.when(F.col("t"), "tables"), F.when(F.col("c"), "charts"), F.when(F.col("o"), "notes")))
    failed = F.coalesce("n_warnings", F.lit(0))
    gaps = F.array_compact(F.array(F.when(failed > 0, F.concat(failed.cast("string"), F.lit(" failed pages"))), F.when(F.coalesce("n_points", F.lit(0)) < 5, "few key points")))
    return x.select("deck", F.array_join(strengths, ",").alias("strengths"), F.array_join(gaps, ",").alias("gaps"), F.when(~F.col("t") & ~F.col("c"), "add charts").otherwise("").alias("recommendations"))


def empty_slides(content: DataFrame) -> DataFrame:
    """Slides without texts, tables and charts."""
    return content.where((F.col("n_texts") == 0) & (F.col("n_tables") == 0) & (F.col("n_charts") == 0)).select("deck", "n")


def slot_lookup(plan: DataFrame, slots: DataFrame) -> DataFrame:
    """plan(plan_row, slide, slot_id, shape_id, shape_name): the slot by slot id, else by shape id, else by shape name within the slide."""
    keys = ["slot_id", "shape_id", "shape_name"]
    cells = F.array(*[F.struct(F.lit(k).alias("prio"), F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in enumerate(keys)])
    wanted = plan.select("plan_row", "slide", F.inline(cells)).where("value is not null")
    known = slots.select("slide", F.col("slot_id").alias("found"), F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in keys]))).where("value is not null")
    hit = wanted.join(known, ["slide", "kind", "value"]).groupBy("plan_row").agg(F.min(F.struct("prio", "found")).alias("_h"))
    return plan.select("plan_row").join(hit, "plan_row", "left").select("plan_row", F.col("_h.found").alias("slot_id"), F.when(F.col("_h").isNull(), "none").when(F.col("_h.prio") == 0, keys[0]).when(F.col("_h.prio") == 1, keys[1]).otherwise(keys[2]).alias("by"))


def font_px(font: Column, role: Column, height: Column, paragraphs: Column) -> Column:
    """The given size, else the height of a paragraph over 1.25 if from 8 to 56, else by role."""
    inferred = height / F.greatest(paragraphs, F.lit(1)) / 1.25
    return F.when(font > 0, font).when((paragraphs > 0) & (inferred >= 8) & (inferred <= 56), inferred).when(role == "title", 28.0).when(role == "body", 16.0).otherwise(14.0)


def capacity(role: Column, width: Column, height: Column, font: Column, old_paragraphs: Column, new_paragraphs: Column) -> Column:
    """Width in Latin characters that fits a box: usable width by 0.52 of the font times its lines; less for labels and titles; null without a box."""
    px = font_px(font, role, height, old_paragraphs)
    lines = F.greatest(F.floor(height / F.greatest(px * 1.25, F.lit(1.0))), old_paragraphs, new_paragraphs, F.lit(1))
    usable = F.greatest(width - F.when(width >= 180, 24).otherwise(12), width * 0.72, F.lit(1.0))
    room = usable / F.greatest(px * 0.52, F.lit(1.0)) * lines
    return F.when((width > 0) & (height > 0), room * F.when(role == "label", 0.7).when(role == "title", 0.85).otherwise(1.0))


def fit(slots: DataFrame) -> DataFrame:
    """slots(slot_id, role, old_text, text, width, height, font_px, old_paragraphs, new_paragraphs) -> (slot_id, need, room, status, reason).

    Labels and very short texts keep near their old width, titles near their box or old width, bodies within their box and a multiple of the old text.
    """
    old, new = F.greatest(visual_width(F.col("old_text")), F.lit(1.0)), visual_width(F.col("text"))
    role, w, h, op, np_ = (F.col(c) for c in ("role", "width", "height", "old_paragraphs", "new_paragraphs"))
    room = capacity(role, w, h, F.col("font_px"), op, np_)
    fits, ratio = F.coalesce(new <= room, F.lit(False)), new / old
    label = (role == "label") | ((old <= 8) & (op <= 1))
    title = (role == "title") & (op <= 1)
    reason = (
        F.when(label, F.when(fits & (old > 8), "box").when(new > F.when(w >= 220, old * 1.25).otherwise(old), "!short label too long").otherwise("old width"))
        .when(title, F.when(fits, "box").when(ratio > F.when(old <= 12, 1.15).otherwise(1.35), "!title too long").otherwise("old width"))
        .when(np_ > F.greatest(op + 2, op * 2, F.lit(2)), "!too many paragraphs").when((w * h < 30000) & (ratio > 2.0), "!small box").when(new > room, "!over the box")
        .when(ratio > F.when(role == "body", 3.0).otherwise(2.2), "!much longer").otherwise("box")
    )
    out = slots.select("slot_id", new.alias("need"), F.round(room, 3).alias("room"), reason.alias("_r"))
    return out.select("slot_id", "need", "room", F.when(F.col("_r").startswith("!"), "WARN").otherwise("OK").alias("status"), F.regexp_replace("_r", "^!", "").alias("reason"))


def cell_errors(edits: DataFrame, tables: DataFrame) -> DataFrame:
    """edits(edit, table_id, row, col) outside the declared size, or of unknown tables."""
    x = edits.join(tables, "table_id", "left")
    bad = F.when(F.col("n_rows").isNull(), "unknown table").when((F.col("row") < 0) | (F.col("row") >= F.col("n_rows")), "row out of range").when((F.col("col") < 0) | (F.col("col") >= F.col("n_cols")), "column out of range")
    return x.withColumn("error", bad).where("error is not null").select("edit", "table_id", "error")


def check_summary(checks: DataFrame) -> DataFrame:
    """One row: number of ok, warn and error rows and the verdict."""
    n = checks.agg(*[F.count_if(F.col("status") == k).alias(f"n_{k.lower()}") for k in ("OK", "WARN", "ERROR")])
    return n.withColumn("verdict", F.when(F.col("n_error") > 0, "ERROR").when(F.col("n_warn") > 0, "WARN").otherwise("OK"))


def check_plan(plan: DataFrame, slots: DataFrame) -> DataFrame:
    """plan rows against slots: ERROR without a slot, else whether the new text fits."""
    at = slot_lookup(plan, slots)
    box = slots.select("slot_id", "role", F.col("text").alias("old_text"), "width", "height", "font_px", "old_paragraphs")
    x = plan.select("plan_row", "text", F.size(F.split("text", "\n")).alias("new_paragraphs")).join(at, "plan_row").join(box, "slot_id", "left")
    fits = fit(x.withColumn("_slot", F.col("slot_id")).withColumn("slot_id", F.col("plan_row"))).withColumnRenamed("slot_id", "plan_row")
    return x.select("plan_row", "slot_id", "by").join(fits.select("plan_row", "status", "reason"), "plan_row").select(
        "plan_row", "slot_id", "by", F.when(F.col("slot_id").isNull(), "ERROR").otherwise(F.col("status")).alias("status"), F.when(F.col("slot_id").isNull(), "no slot").otherwise(F.col("reason")).alias("reason")
    )
