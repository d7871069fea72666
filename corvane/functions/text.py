"""Scalar text functions as Column expressions; explicit character classes, so that engines agree on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: blocks and marks that the document rules name
CJK = r"[\x{4e00}-\x{9fff}]"
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def to_number(c: Column) -> Column:
    """Double, or null for what is not a plain decimal number (no type suffixes, NaN or digit separators)."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def canonical_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 over name=value pairs in name order; nulls are the word null."""
    parts = [F.concat(F.lit(f"{k}="), F.coalesce(fields[k].cast("string"), F.lit("null"))) for k in sorted(fields)]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def doc_id(path: Column) -> Column:
    """doc_ plus the file name, dots and other odd characters as underscores; the suffix stays, so a.docx and a.pdf differ."""
    return F.concat(F.lit("doc_"), F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"[^\p{L}\p{N}_-]", "_"))


def capitalised_terms(c: Column) -> Column:
    """Runs of two or more capitalised words."""
    return F.regexp_extract_all(c, F.lit(r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"), 0)


def book_titles(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"《([^》]+)》"), 1)


def cjk_terms(c: Column, suffixes: str) -> Column:
    """Two to six CJK characters before one of the suffix characters, the suffix included."""
    return F.regexp_extract_all(c, F.lit(rf"[\x{{4e00}}-\x{{9fff}}]{{2,6}}[{suffixes}]"), 0)


def name_numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[0-9]+"), 0)


def name_tokens(c: Column) -> Column:
    """Lower-cased tokens, anything but letters, digits and underscores apart."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]", " "), " +"), lambda x: x != ""))


def char_weight(c: Column) -> Column:
    """CJK characters count two, other characters but white space one."""
    return (F.length(F.regexp_replace(c, r"\s", "")) + F.length(F.regexp_replace(c, r"[^\x{4e00}-\x{9fff}]", ""))).cast("long")


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def visual_width(c: Column) -> Column:
    """Wide East Asian characters 2, other characters 1, white space 0; the class is an approximation of the Unicode property."""
    dense = F.regexp_replace(c, r"\s", "")
    return (F.length(dense) + F.length(F.regexp_replace(dense, r"[^\x{1100}-\x{115f}\x{2e80}-\x{a4cf}\x{ac00}-\x{d7a3}\x{f900}-\x{faff}\x{fe30}-\x{fe6f}\x{ff00}-\x{ff60}\x{ffe0}-\x{ffe6}]", ""))).cast("double")


# fixed values: patterns of list items, headings, captions and LaTeX, and words that open sections
LIST_ITEM = r"^([0-9]+[.、)）]|[①-⑩]|[一二三四五六七八九十]+[.、]|[a-zA-Z][.、)]|[-•·▪‣⁃]|\([0-9]+\)|（[0-9]+）|\[[0-9A-Za-z_]\])"
CHAPTER = r"^第[一二三四五六七八九十0-9]+[章节部分篇]"
CHAPTER_DOCX = r"^第[一二三四五六七八九十百0-9]+[章节部篇]"
NUMBERED = r"^[0-9]+(\.[0-9]+)*\s+\S"
HAN_NUMBERED = r"^[（(]?[一二三四五六七八九十]+[）).、]"
OPENING = r"^(引言|前言|绪论|摘要|Abstract|结论|总结|展望|致谢|参考文献|References|关键词|Keywords|研究背景|研究方法|实验|结果|讨论|分析|文献综述|相关工作)"
OPENING_DOCX = r"^(引言|摘要|结论|参考文献|致谢|附录|abstract|references|introduction|conclusion|summary)"
COLON = r"[:：]"
PREFIXED = r"(引言|摘要|结论|总结|概述|前言|背景)"
CAPTION = r"^(表\s*[-.–]\s*[0-9]+\s*[-.–]\s*[0-9]+|表\s*[0-9]+\s*[-.–]\s*[0-9]+|表\s*[0-9]+\s+|(?i:table)\s*[0-9]+\s*|表格\s*[0-9]+\s+)"
BODY_MARKS = r"[。，；、（）]"
LATEX = r"(\\[a-zA-Z]+(\{[^}]*\})*|\^\{[^}]*\}|_(\{[^}]*\}|[a-zA-Z0-9]))"


def is_list_item(c: Column) -> Column:
    return F.trim(c).rlike(LIST_ITEM)


def heading_level_pdf(c: Column) -> Column:
    """Chapters 1; decimal numbering by the number of dots in the line; Chinese numbering and opening words of short lines 1, with a colon up to 100 characters 2; else 0."""
    n, dots = F.length(c), F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    return (
        F.when(c.rlike(CHAPTER), 1).when(c.rlike(NUMBERED), F.when(dots >= 2, 3).when(dots == 1, 2).otherwise(1)).when(c.rlike(HAN_NUMBERED) & (n <= 80), 1)
        .when(c.rlike(OPENING) & (n <= 60), 1).when(c.rlike(OPENING) & c.rlike(COLON) & (n <= 100), 2).otherwise(0)
    )


def heading_level_style(style: Column, c: Column) -> Column:
    """The style's level 1 to 3, else patterns of lines up to 80 characters: chapter 1, number and blank 1, Chinese numbering 2, opening word with a colon 2, decimal numbering 3."""
    st, n = F.lower(F.coalesce(style, F.lit(""))), F.length(c)
    return (
        F.when(F.trim(c) == "", 0).when(F.contains(st, F.lit("heading 1")), 1).when(F.contains(st, F.lit("heading 2")), 2).when(F.contains(st, F.lit("heading 3")), 3).when(n > 80, 0)
        .when(c.rlike(CHAPTER_DOCX), 1).when(c.rlike(r"^[0-9]+\s+\S") & (n < 50), 1).when(c.rlike(r"^[一二三四五六七八九十]+[、．.]"), 2)
        .when(F.lower(c).rlike(OPENING_DOCX) & c.rlike(COLON), 2).when(c.rlike(r"^[0-9]+\.[0-9]+[.\s]") & (~F.contains(st, F.lit("first paragraph")) | (n < 50)), 3).otherwise(0)
    )


def heading_level_plain(c: Column) -> Column:
    """Lines without styles: decimal numbering by depth, a number with dot up to 50 characters 3, Chinese numbering 2, chapters 1, a short part before a full-width colon 2; else 0."""
    t = F.trim(c)
    n = F.length(t)
    head = F.trim(F.substring_index(t, "：", 1))
    return (
        F.when(t.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\s+\S"), 4).when(t.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\s+\S"), 3).when(t.rlike(r"^[0-9]+\.[0-9]+\s+\S"), 2)
        .when(t.rlike(r"^[0-9]+[.、]\s*\S") & (n <= 50), 3).when(t.rlike(r"^[一二三四五六七八九十]+[、.\s]"), 2).when(t.rlike(CHAPTER), 1)
        .when(F.contains(t, F.lit("：")) & (n <= 80) & (F.length(head) <= 15) & (head.rlike(PREFIXED) | (F.length(head) <= 10)), 2).otherwise(0)
    )


def is_misread_heading(level: Column, c: Column) -> Column:
    """Second and third level headings that weigh over 60 and hold marks of running text."""
    return level.isin(2, 3) & (char_weight(c) > 60) & c.rlike(BODY_MARKS)


def is_table_caption(c: Column) -> Column:
    return F.trim(c).rlike(CAPTION)


def wrap_formulas(c: Column) -> Column:
    """Runs of LaTeX commands, exponents and indices between dollar signs, blanks within a run included; texts with formulas in dollars already stay."""
    return F.when(c.rlike(r"\$.*?\$") | ~has_latex(c), c).otherwise(F.regexp_replace(c, rf"{LATEX}(\s*{LATEX})*", r"\$$0\$"))


def has_latex(c: Column) -> Column:
    return c.rlike(LATEX)


def normalise_lines(c: Column) -> Column:
    """White space runs within lines become one blank; blank lines go."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0d]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def escape_cell(c: Column) -> Column:
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def markdown_table(rows: Column) -> Column:
    """Array of rows of cells as a pipe table; short rows are filled up."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    full = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, escape_cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |")))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.concat_ws("\n", F.element_at(full, 1), rule, F.array_join(F.slice(full, 2, F.greatest(F.size(full) - 1, F.lit(0))), "\n"))


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), r'[\\/:*?"<>|\x00-\x1f]', "_"), r"_+", "_")


def extension(c: Column) -> Column:
    """Lower case without dot; jpeg is jpg, tif is tiff, none is bin."""
    e = F.lower(F.regexp_replace(c, r"^\.", ""))
    return F.when(e == "", "bin").when(e == "jpeg", "jpg").when(e == "tif", "tiff").otherwise(e)


def truncate(c: Column, n: int = 120) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def slide_list(c: Column) -> Column:
    """1,3-5 -> [1, 3, 4, 5]."""
    parts = F.filter(F.split(F.replace(c, F.lit(" "), F.lit("")), ","), lambda x: x.rlike(r"^[0-9]+(-[0-9]+)?$"))
    return F.flatten(F.transform(parts, lambda x: F.sequence(F.element_at(F.split(x, "-"), 1).cast("int"), F.element_at(F.split(x, "-"), -1).cast("int"))))


def human_size(c: Column) -> Column:
    return (
        F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
        .when(c < 1024**2, F.concat(F.format_string("%.1f", c / 1024.0), F.lit(" KB")))
        .when(c < 1024**3, F.concat(F.format_string("%.1f", c / 1024.0**2), F.lit(" MB")))
        .otherwise(F.concat(F.format_string("%.1f", c / 1024.0**3), F.lit(" GB")))
    )


def relative_age(ts: Column, now: Column) -> Column:
    """just now, minutes, hours, days under a week, else the date."""
    s = F.floor((now.cast("timestamp").cast("double") - ts.cast("timestamp").cast("double")))
    return (
        F.when(s < 60, F.lit("just now"))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" minutes ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit(" hours ago")))
        .when(s < 7 * 86400, F.concat(F.floor(s / 86400).cast("string"), F.lit(" days ago")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def iso_date(c: Column) -> Column:
    """First date with year, month and day apart by dot, dash or the year and month signs, zero-padded."""
    p = r"([0-9]{4})[年.-]([0-9]{1,2})[月.-]([0-9]{1,2})"
    return F.when(c.rlike(p), F.concat_ws("-", F.regexp_extract(c, p, 1), F.lpad(F.regexp_extract(c, p, 2), 2, "0"), F.lpad(F.regexp_extract(c, p, 3), 2, "0")))


def hours(c: Column, default: int = 2) -> Column:
    got = F.regexp_extract(c, r"([0-9]+)", 1)
    return F.when(got != "", got.try_cast("int")).otherwise(default)


def fitted_width(width: Column, height: Column, limit: int = 1200) -> tuple[Column, Column]:
    """Width at most `limit`, height in proportion and cut to an integer."""
    w = F.least(width, F.lit(limit)).cast("int")
    return w, F.when(width > limit, (height * F.lit(float(limit)) / width).cast("int")).otherwise(height.cast("int"))


def person_candidates(text: Column, surnames: list[str]) -> Column:
    """Windows of two and three CJK characters that start with a surname, in order; windows cut off by the end do not count."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    two = F.transform(at, lambda i: F.substring(text, i, F.lit(2)))
    three = F.transform(at, lambda i: F.substring(text, i, F.lit(3)))
    heads = "|".join(surnames)
    return F.filter(F.concat(two, three), lambda x: x.rlike(rf"^({heads})[\x{{4e00}}-\x{{9fff}}]{{1,2}}$"))
