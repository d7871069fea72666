"""Order-dependent document structure: sections, regions, runs, fences, fonts. Order is an explicit position column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import heading_level_plain, is_table_caption


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, line) from 0."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))


def markdown_sections(lines: DataFrame) -> DataFrame:
    """(doc_id, section, title, body): lines from each heading to the next; what precedes the first heading is left out."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    head = F.col("line").rlike("^#+ *[^# ]")
    tagged = lines.withColumn("_head", head.cast("int")).withColumn("section", F.sum("_head").over(w)).where("section > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_head") == 0, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    title = F.max(F.when(F.col("_head") == 1, F.regexp_replace("line", "^#+ *", "")))
    return tagged.groupBy("doc_id", "section").agg(title.alias("title"), body.alias("body"))


# fixed values: words of contents pages and of reference lists
CONTENTS_WORDS = "目录|目 录|目  录|table of contents|contents"
REFERENCE_WORDS = "参考文献|references|bibliography"


def regions(paragraphs: DataFrame) -> DataFrame:
    """paragraphs(doc_id, pos from 0, text) -> with region.

    Contents run from the last contents word to the first heading at or after the first one, or 20 paragraphs on if
    there is none; the cover ends at the first heading, without headings at the first text of over five characters;
    references start at their first word. Precedence: contents, cover, references, body.
    """
    t = F.trim("text")
    p = F.col("pos")
    x = paragraphs.select("doc_id", "pos", "text", (heading_level_plain(F.col("text")) > 0).alias("_h"), F.lower(t).rlike(CONTENTS_WORDS).alias("_t"), F.lower(t).rlike(REFERENCE_WORDS).alias("_r"), (F.length(t) > 5).alias("_l"))
    w = Window.partitionBy("doc_id")
    x = x.withColumn("_first", F.min(F.when(F.col("_t"), p)).over(w)).withColumn("_end", F.min(F.when(F.col("_h") & (p >= F.col("_first")), p)).over(w))
    marks = x.groupBy("doc_id").agg(
        F.min(F.when(F.col("_h"), p)).alias("_head"), F.min(F.when(F.col("_l"), p)).alias("_long"), F.min(F.when(F.col("_r"), p)).alias("_ref"), F.max("_end").alias("_toc_end"),
        F.max(F.when(F.col("_t") & (F.col("_end").isNull() | (p <= F.col("_end"))), p)).alias("_toc"), F.max(p).alias("_last"),
    )
    end = F.coalesce("_toc_end", F.least(F.col("_toc") + 20, F.col("_last") + 1))
    cover = F.coalesce("_head", "_long", F.lit(0))
    region = F.when((p >= F.col("_toc")) & (p < end), "toc").when(p < cover, "cover").when(p >= F.col("_ref"), "references").otherwise("body")
    return paragraphs.join(marks, "doc_id").select("doc_id", "pos", "text", region.alias("region"))


PAUSES = r"[。，；、（）《》\"]"


def neighbour_headings(paragraphs: DataFrame) -> DataFrame:
    """paragraphs(doc_id, pos, text) -> (doc_id, pos, level): by the line itself, else 2 for a line of up to 40 characters without pauses
    between two of over 100, after an empty one before over 80, or up to 25 after up to 40 before over 120. Ends of the document have no such level.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    t = F.trim("text")
    n = F.length(t)
    before, after = F.lag(n).over(w), F.lead(n).over(w)
    own = heading_level_plain(F.col("text"))
    likely = (n > 0) & (n <= 40) & ~t.rlike(PAUSES) & (((before > 100) & (after > 100)) | ((before == 0) & (after > 80)) | ((before <= 40) & (after > 120) & (n <= 25)))
    return paragraphs.select("doc_id", "pos", F.when(own > 0, own).when(likely, 2).otherwise(0).alias("level"))


def captions_with_tables(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, pos, tag, text) -> captions and whether a table follows at once."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    out = blocks.withColumn("_next", F.lead("tag").over(w))
    return out.where(is_table_caption(F.col("text")) & (F.col("tag") == "p")).select("doc_id", "pos", F.coalesce(F.col("_next") == "tbl", F.lit(False)).alias("has_table"))


def empty_runs(paragraphs: DataFrame, most: int = 2) -> DataFrame:
    """(doc_id, first_pos, n): the first run of more than `most` empty paragraphs of each document."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    empty = paragraphs.where(F.trim("text") == "").withColumn("_island", F.col("pos") - F.row_number().over(w))
    runs = empty.groupBy("doc_id", "_island").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return runs.groupBy("doc_id").agg(F.min(F.struct("first_pos", "n")).alias("_r")).select("doc_id", "_r.first_pos", "_r.n")


def mentions_at_end(paragraphs: DataFrame, pattern: str, last: int = 10) -> DataFrame:
    """Whether one of the last paragraphs of each document matches."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("pos"))
    tail = paragraphs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    return tail.groupBy("doc_id").agg(F.bool_or(F.col("text").rlike(pattern)).alias("found"))


def fenced(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, inside): lines within code fences, the fences not counted; an odd number of fences leaves the rest inside."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    fence = F.col("line").startswith("```")
    out = lines.withColumn("_n", F.sum(fence.cast("int")).over(w))
    return out.select("doc_id", "pos", ((F.col("_n") % 2 == 1) & ~fence).alias("inside"))


def json_blocks(lines: DataFrame) -> DataFrame:
    """Bare JSON blocks: from a line that opens a brace until braces balance, parsed; (doc_id, start, end, valid). A document's lines go to one task together."""
    import json

    import pandas as pd

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, depth, start, held = [], 0, None, []
        pdf = pdf.sort_values("pos")
        for pos, line in zip(pdf["pos"], pdf["line"], strict=True):
            if start is None and not line.lstrip().startswith(("{", "[")):
                continue
            start = pos if start is None else start
            held.append(line)
            depth += sum(line.count(c) for c in "{[") - sum(line.count(c) for c in "}]")
            if depth <= 0:
                try:
                    json.loads("\n".join(held))
                    ok = True
                except ValueError:
                    ok = False
                rows.append((pdf["doc_id"].iloc[0], start, pos, ok))
                depth, start, held = 0, None, []
        if held:
            rows.append((pdf["doc_id"].iloc[0], start, pdf["pos"].iloc[-1], False))
        return pd.DataFrame(rows, columns=["doc_id", "start", "end", "valid"])

    return lines.groupBy("doc_id").applyInPandas(scan, "doc_id long, start long, end long, valid boolean")


def reading_order(shapes: DataFrame) -> DataFrame:
    """shapes(slide, shape, top, left) -> with order from 1, top to bottom and left to right."""
    w = Window.partitionBy("slide").orderBy("top", "left", "shape")
    return shapes.withColumn("order", F.row_number().over(w))


def first_match(paragraphs: DataFrame, condition: Column, name: str) -> DataFrame:
    """The text of the first paragraph of each document that meets the condition; documents without one stay, with null."""
    return paragraphs.groupBy("doc_id").agg(F.min_by("text", F.when(condition, F.col("pos"))).alias(name))


def document_heads(paragraphs: DataFrame) -> DataFrame:
    """paragraphs(doc_id, pos, text, level, font_size) -> (doc_id, title, author, date): the first text of level 0 from 14 points, else of five characters; the first short text with an author's mark; the first date."""
    from corvane.functions.text import iso_date

    first = lambda c, v="text": F.min_by(v, F.when(c, F.col("pos")))
    x = paragraphs.withColumn("_day", iso_date(F.col("text")))
    return x.groupBy("doc_id").agg(
        F.coalesce(first((F.col("level") == 0) & (F.coalesce("font_size", F.lit(10.0)) >= 14)), first((F.length("text") >= 5) & (F.col("level") == 0)), F.lit("")).alias("title"),
        F.coalesce(first(F.col("text").rlike(AUTHOR) & (F.length("text") <= 60)), F.lit("")).alias("author"), F.coalesce(first(F.col("_day").isNotNull(), "_day"), F.lit("")).alias("date"),
    )


def latest_state(states: DataFrame) -> DataFrame:
    """states(project, status, updated_at): the liveliest row of each project, then the newest."""
    s = F.lower("status")
    # fixed values: status words by priority
    rank = F.when(s.isin("running", "processing", "active"), 0).when(s.isin("idle", "pending", "initializing"), 1).when(s.isin("completed", "success"), 3).when(s.isin("failed", "error"), 4).otherwise(2)
    w = Window.partitionBy("project").orderBy(rank, F.desc("updated_at"))
    return states.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def sequential_ids(rows: DataFrame, kind: str, order: str) -> DataFrame:
    """kind_001, kind_002, ... within each kind."""
    w = Window.partitionBy(kind).orderBy(order)
    return rows.withColumn("id", F.format_string("%s_%03d", F.col(kind), F.row_number().over(w)))


def font_levels(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, size) -> (doc_id, body, title, h1, h2, h3): body is the most frequent size from 8 to 14, else the upper median.

    Distinct sizes over body + 1 are title, h1, h2 and h3 from the largest; levels without one lie at body + 1, + 0.5 and + 0;
    without any larger size all levels are the body's.
    """
    per = blocks.where("size > 0").groupBy("doc_id", F.round("size", 1).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.partitionBy("doc_id").orderBy("size")
    cum = per.withColumn("_cum", F.sum("n").over(ordered)).withColumn("_all", F.sum("n").over(Window.partitionBy("doc_id")))
    body = cum.groupBy("doc_id").agg(
        F.max(F.when(F.col("size").between(8, 14), F.struct("n", (-F.col("size")).alias("s")))).alias("_mode"),
        F.min(F.when(F.col("_cum") > F.floor(F.col("_all") / 2), F.col("size"))).alias("_median"),
    ).select("doc_id", F.coalesce(-F.col("_mode.s"), F.col("_median")).alias("body"))
    larger = per.join(body, "doc_id").where("size > body + 1").withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size"))))
    ranks = larger.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), *[F.max(F.when(F.col("_k") == k, F.col("size"))).alias(f"_s{k}") for k in (1, 2, 3, 4)])
    out = body.join(ranks, "doc_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    n, b = F.col("_n"), F.col("body")
    return out.select(
        "doc_id", "body", F.coalesce("_s1", "body").alias("title"), F.when(n >= 2, F.col("_s2")).when(n == 1, b + 1).otherwise(b).alias("h1"),
        F.when(n >= 3, F.col("_s3")).when(n >= 1, b + 0.5).otherwise(b).alias("h2"), F.when(n >= 4, F.col("_s4")).when(n == 3, b + 0.5).otherwise(b).alias("h3"),
    )


# fixed values: starts of boilerplate lines and words that keep short blocks
BOILERPLATE = r"^(收稿日期|作者简介|基金项目|中图分类号|DOI)"
KEPT_WORDS = "摘要|引言|结论"
AUTHOR = r"[\x{4e00}-\x{9fff}]{2,4}\s*[0-9,\x{ff0c}\x{3001}]+"


def is_noise(text: Column) -> Column:
    """Page numbers of up to three digits, and boilerplate lines of up to 80 characters."""
    return text.rlike("^[0-9]{1,3}$") | ((F.length(text) <= 80) & text.rlike(BOILERPLATE))


def is_short_block(text: Column) -> Column:
    return (F.length(text) <= 2) & ~text.rlike(KEPT_WORDS)


def is_protected(text: Column) -> Column:
    """Text that must not be translated: figures, tables, addresses, identifiers."""
    return F.contains(text, F.lit("Figure")) | F.contains(text, F.lit("Table")) | F.contains(text, F.lit("http")) | F.contains(text, F.lit("DOI"))


def is_protected_section(region: Column) -> Column:
    return region.isin("cover", "toc")


def markdown_counts(text: Column) -> dict[str, Column]:
    """Words, lines, table lines, images, links and the first title of Markdown."""
    times = lambda mark: ((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)).cast("long")
    lines = F.split(text, "\n")
    return {
        "n_words": F.size(F.filter(F.split(text, r"[\x20\x09-\x0d]+"), lambda x: x != "")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_table_lines": F.size(F.filter(lines, lambda x: x.startswith("|"))).cast("long"),
        "n_images": times("!["),
        "n_links": F.greatest(times("[") - times("!["), F.lit(0)).cast("long"),
        "title": F.regexp_extract(text, r"(?m)^# (.*)$", 1),
    }
