"""Queries of scalar text functions over whole tables; where no table has such texts, each part takes one of a few forms and fills it in (ids f*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.sources.tables import load, selected, selected_sql, values, woven

HAN = r"[\x{4e00}-\x{9fff}]"
LINES = "(1, '1. Introduction'), (2, '1.2 Methods'), (3, '1.2.3 Details here'), (4, '# Title'), (5, '### Deep'), (6, '第一章 绪论'), (7, 'Plain text about nothing'), (8, '- item'), (9, '(3) item'), (10, '表 1 数据'), (11, 'Table 2 Results'), (12, '1、概述'), (13, 'Chapter 4 End'), (14, '')"
STYLED = "(1, 'Heading 2', 'Any'), (2, 'Normal', '1.1 Scope'), (3, 'heading 1', 'x'), (4, 'Normal', 'words')"
LONG_HAN = "(1, 2, '这是一个很长的标题其实应该是正文因为它包含了很多的字符，并且有标点符号。所以我们要把它识别出来才对'), (2, 2, '短标题'), (3, 1, '一级标题，很长很长很长很长很长很长很长很长很长很长很长很长很长很长很长很长很长很长')"
PEOPLE = "(1, '王小明和李华去了北京'), (2, '张伟'), (3, 'none here')"
TIMES = "('Mon 1-2'), ('Tue'), ('Wed morning'), ('Thu afternoon'), ('whenever'), ('Mon 1-2 Mon 2-3')"
DATES = "('on 2024-3-7 it was'), ('2023年12月1日'), ('2022.01.15 x'), ('none')"
FILES = "(' a/b:c?.docx '), ('x**y'), ('plain.txt')"
SIZES = "(0), (512), (2048), (5242880), (3221225472)"
AGES = "(10), (125), (7300), (200000), (900000)"
RANGES = "('1,3-5'), ('2'), ('7-9, 12'), ('x,4')"
TABLES = "(1, 'a|b~c~1|2'), (2, 'h~x|y|z')"
MD = "(1, 'Hello $x$ world'), (2, 'a \\\\frac{1}{2} b'), (3, 'x^{2}'), (4, 'plain'), (5, 'so \\\\alpha \\\\beta_1 end')"

HEADINGS = STYLED + ", (5, 'Normal', '# Title'), (6, 'Normal', '第一章 绪论'), (7, 'Normal', '2.3.4 Deep'), (8, 'Normal', '3. One'), (9, 'First Paragraph', '1.1 反应'), (10, 'Normal', '一、总则'), (11, 'Normal', '摘要：本文'), (12, 'Normal', '12 Scope'), (13, 'Normal', '背景：说明'), (14, 'Normal', '1.2.3.4 Four'), (15, 'Normal', ''), (16, 'Normal', 'Abstract: x')"
PDF_SQL = rf"""CASE WHEN regexp_matches(t, '{X.CHAPTER}') THEN 1 WHEN regexp_matches(t, '{X.NUMBERED}') THEN CASE WHEN length(t) - length(replace(t, '.', '')) >= 2 THEN 3 WHEN length(t) - length(replace(t, '.', '')) = 1 THEN 2 ELSE 1 END
 WHEN regexp_matches(t, '{X.HAN_NUMBERED}') AND length(t) <= 80 THEN 1 WHEN regexp_matches(t, '{X.OPENING}') AND length(t) <= 60 THEN 1 WHEN regexp_matches(t, '{X.OPENING}') AND regexp_matches(t, '{X.COLON}') AND length(t) <= 100 THEN 2 ELSE 0 END"""
STYLE_SQL = rf"""CASE WHEN trim(t) = '' THEN 0 WHEN contains(lower(style), 'heading 1') THEN 1 WHEN contains(lower(style), 'heading 2') THEN 2 WHEN contains(lower(style), 'heading 3') THEN 3 WHEN length(t) > 80 THEN 0 WHEN regexp_matches(t, '{X.CHAPTER_DOCX}') THEN 1
 WHEN regexp_matches(t, '^[0-9]+\s+\S') AND length(t) < 50 THEN 1 WHEN regexp_matches(t, '^[一二三四五六七八九十]+[\x{{3001}}\x{{ff0e}}.]') THEN 2 WHEN regexp_matches(lower(t), '{X.OPENING_DOCX}') AND regexp_matches(t, '{X.COLON}') THEN 2
 WHEN regexp_matches(t, '^[0-9]+\.[0-9]+[.\s]') AND (NOT contains(lower(style), 'first paragraph') OR length(t) < 50) THEN 3 ELSE 0 END"""
PLAIN_SQL = rf"""CASE WHEN regexp_matches(trim(t), '^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+\s+\S') THEN 4 WHEN regexp_matches(trim(t), '^[0-9]+\.[0-9]+\.[0-9]+\s+\S') THEN 3 WHEN regexp_matches(trim(t), '^[0-9]+\.[0-9]+\s+\S') THEN 2 WHEN regexp_matches(trim(t), '^[0-9]+[.\x{{3001}}]\s*\S') AND length(trim(t)) <= 50 THEN 3
 WHEN regexp_matches(trim(t), '^[一二三四五六七八九十]+[\x{{3001}}.\s]') THEN 2 WHEN regexp_matches(trim(t), '{X.CHAPTER}') THEN 1
 WHEN contains(t, '：') AND length(trim(t)) <= 80 AND length(trim(string_split(trim(t), '：')[1])) <= 15 AND (regexp_matches(string_split(t, '：')[1], '{X.PREFIXED}') OR length(trim(string_split(trim(t), '：')[1])) <= 10) THEN 2 ELSE 0 END"""

TITLED = "SELECT p_partkey, CASE WHEN p_size < 10 THEN concat('读《红楼梦》和《', p_name, '记》') WHEN p_size < 30 THEN concat('《西游记》与红楼梦 ', p_name) ELSE p_name END AS t FROM {part}"
CHARTED = "SELECT p_partkey, CASE WHEN p_size < 10 THEN CAST(p_size AS STRING) WHEN p_size < 20 THEN concat(p_size, '.', p_size) WHEN p_size < 30 THEN p_name WHEN p_size < 40 THEN concat(' ', p_size, ' ') ELSE '' END AS v FROM {part}"
TABLED = "SELECT p_partkey, CASE WHEN p_size < 20 THEN concat('name|', p_name, '~', p_brand, '~', p_size, '|', p_type) ELSE concat('h~', replace(p_name, ' ', '|'), '|z') END AS t FROM {part}"

# name: columns, rows, outputs as (Spark column when called, SQL)
CASES = {
    "f03_doc_id": ("path", "('/a/b/My file.docx'), ('x.pdf'), ('é-ü_1.md')", {"doc_id": (lambda: X.doc_id(F.col("path")), r"'doc_' || regexp_replace(string_split(path, '/')[-1], '[^\p{L}\p{N}_-]', '_', 'g')")}),
    "f05_person_candidates": ("id, t", PEOPLE, {"names": (lambda: F.array_join(X.person_candidates(F.col("t"), ["王", "李", "张"]), ","), r"array_to_string(list_filter(list_concat(list_transform(range(1, greatest(length(t), 1) + 1), lambda i: substr(t, i, 2)), list_transform(range(1, greatest(length(t), 1) + 1), lambda i: substr(t, i, 3))), lambda x: regexp_matches(x, '^(王|李|张)[\x{4e00}-\x{9fff}]{1,2}$')), ',')")}),
    "f09_visual_width": ("id, t", LONG_HAN.replace(", 2, ", ", ").replace(", 1, ", ", "), {"width": (lambda: X.visual_width(F.col("t")), r"CAST(length(regexp_replace(t, '\s', '', 'g')) + length(regexp_replace(regexp_replace(t, '\s', '', 'g'), '[^\x{1100}-\x{115f}\x{2e80}-\x{a4cf}\x{ac00}-\x{d7a3}\x{f900}-\x{faff}\x{fe30}-\x{fe6f}\x{ff00}-\x{ff60}\x{ffe0}-\x{ffe6}]', '', 'g')) AS DOUBLE)")}),
    "f10_char_weight": ("id, t", LINES, {"weight": (lambda: X.char_weight(F.col("t")), r"length(regexp_replace(t, '\s', '', 'g')) + length(regexp_replace(t, '[^\x{4e00}-\x{9fff}]', '', 'g'))")}),
    "f11_has_cjk": ("id, t", LINES, {"cjk": (lambda: X.has_cjk(F.col("t")), r"regexp_matches(t, '[\x{4e00}-\x{9fff}]')")}),
    "f12_list_items": ("id, t", LINES, {"is_item": (lambda: X.is_list_item(F.col("t")), f"regexp_matches(trim(t), '{X.LIST_ITEM}')")}),
    "f13_heading_levels": ("id, style, t", HEADINGS, {
        "pdf": (lambda: X.heading_level_pdf(F.col("t")), PDF_SQL), "styled": (lambda: X.heading_level_style(F.col("style"), F.col("t")), STYLE_SQL), "plain": (lambda: X.heading_level_plain(F.col("t")), PLAIN_SQL)}),
    "f14_misread_heading": ("id, level, t", LONG_HAN, {"misread": (lambda: X.is_misread_heading(F.col("level"), F.col("t")), rf"level IN (2, 3) AND length(regexp_replace(t, '\s', '', 'g')) + length(regexp_replace(t, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')) > 60 AND regexp_matches(t, '{X.BODY_MARKS}')")}),
    "f15_table_caption": ("id, t", LINES + ", (15, '表1-2 数据'), (16, 'TABLE 3 x'), (17, '表格 4 y'), (18, '表 - 1 - 2 z')", {"caption": (lambda: X.is_table_caption(F.col("t")), f"regexp_matches(trim(t), '{X.CAPTION}')")}),
    "f20_file_names": ("name", FILES, {"safe": (lambda: X.safe_filename(F.col("name")), r"""regexp_replace(regexp_replace(trim(name), '[\\/:*?"<>|\x00-\x1f]', '_', 'g'), '_+', '_', 'g')"""), "ext": (lambda: X.extension(F.element_at(F.split("name", r"\."), -1)), "CASE WHEN lower(string_split(name, '.')[-1]) = '' THEN 'bin' ELSE lower(string_split(name, '.')[-1]) END")}),
    "f22_slide_list": ("spec", RANGES, {"slides": (lambda: F.array_join(X.slide_list(F.col("spec")).cast("array<string>"), ","), "array_to_string(flatten(list_transform(list_filter(string_split(replace(spec, ' ', ''), ','), lambda x: regexp_matches(x, '^[0-9]+(-[0-9]+)?$')), lambda x: range(CAST(string_split(x, '-')[1] AS BIGINT), CAST(string_split(x, '-')[-1] AS BIGINT) + 1))), ',')")}),
    "f24_hours": ("t", "('4 hours'), ('none'), ('2x3')", {"hours": (lambda: X.hours(F.col("t")), "coalesce(TRY_CAST(regexp_extract(t, '([0-9]+)', 1) AS INTEGER), 2)")}),
    "f27_human_size": ("n", SIZES, {"size": (lambda: X.human_size(F.col("n").cast("long")), "CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', round(n / 1024.0::DOUBLE, 1)) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', round(n / 1048576.0::DOUBLE, 1)) || ' MB' ELSE printf('%.1f', round(n / 1073741824.0::DOUBLE, 1)) || ' GB' END")}),
    "f28_relative_age": ("s", AGES, {"age": (lambda: X.relative_age(F.expr("timestamp_seconds(1700000000 - s)"), F.expr("timestamp_seconds(1700000000)")), "CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || ' minutes ago' WHEN s < 86400 THEN s // 3600 || ' hours ago' WHEN s < 604800 THEN s // 86400 || ' days ago' ELSE strftime(make_timestamp((1700000000 - CAST(s AS BIGINT)) * 1000000), '%Y-%m-%d') END")}),
    "f30_iso_date": ("t", DATES, {"day": (lambda: X.iso_date(F.col("t")), r"CASE WHEN regexp_matches(t, '([0-9]{4})[年.-]([0-9]{1,2})[月.-]([0-9]{1,2})') THEN regexp_extract(t, '([0-9]{4})[年.-]([0-9]{1,2})[月.-]([0-9]{1,2})', 1) || '-' || lpad(regexp_extract(t, '([0-9]{4})[年.-]([0-9]{1,2})[月.-]([0-9]{1,2})', 2), 2, '0') || '-' || lpad(regexp_extract(t, '([0-9]{4})[年.-]([0-9]{1,2})[月.-]([0-9]{1,2})', 3), 2, '0') END")}),
    "f33_fitted_width": ("w, h", "(2400, 1000), (800, 600), (1999, 777)", {"new_w": (lambda: X.fitted_width(F.col("w"), F.col("h"))[0], "least(w, 1200)"), "new_h": (lambda: X.fitted_width(F.col("w"), F.col("h"))[1], "CASE WHEN w > 1200 THEN CAST(floor(h * CAST(1200 AS DOUBLE) / w) AS INTEGER) ELSE h END")}),
}
#: How a part's columns come into the literal row that it takes: by default its name stands behind the text.
MIX = {
    "f03_doc_id": {"path": "concat('/', p_brand, '/', p_name, v.path)"}, "f20_file_names": {"name": "concat(' ', p_name, v.name)"}, "f22_slide_list": {"spec": "concat(p_size, ',', v.spec)"}, "f24_hours": {"t": "concat(p_size, v.t)"},
    "f27_human_size": {"n": "v.n + p_partkey * 1000"}, "f28_relative_age": {"s": "v.s + p_partkey"}, "f30_iso_date": {"t": "concat(p_name, ' ', v.t)"}, "f33_fitted_width": {"w": "v.w + p_size", "h": "v.h + p_size"}, "f05_person_candidates": {"t": "concat(v.t, p_name, '李', p_brand)"},
}


def _source(name):
    columns, rows, _ = CASES[name]
    return woven(columns, rows, "part", "p_partkey", MIX.get(name, {"t": "concat(v.t, ' ', p_name)"}))


def _case(name):
    outs = CASES[name][2]
    return lambda s, d: selected(s, d, _source(name), "part").select("*", *[c().alias(k) for k, (c, _) in outs.items()])


def _lines(s, d):
    return load(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


LINES_SQL = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"


def queries():
    q = {name: _case(name) for name in CASES}
    q["f01_content_hash"] = lambda s, d: load(s, d, "documents").select("doc_id", X.sha256_hex(F.col("text")).alias("sha"))
    q["f02_canonical_hash"] = lambda s, d: load(s, d, "events").select("event_id", X.canonical_hash({"type": F.col("event_type"), "user": F.col("user_id"), "none": F.lit(None)}).alias("sha"))
    q["f04_terms"] = lambda s, d: load(s, d, "documents").select("doc_id", F.array_join(X.capitalised_terms(F.col("text")), "|").alias("terms"))
    q["f04_titles"] = lambda s, d: selected(s, d, TITLED, "part").select("p_partkey", F.array_join(X.book_titles(F.col("t")), "|").alias("titles"), F.array_join(X.cjk_terms(F.col("t"), "梦记"), "|").alias("terms"))
    q["f06_name_numbers"] = lambda s, d: load(s, d, "customer").select("c_custkey", F.element_at(X.name_numbers(F.col("c_name")), -1).alias("last"))
    q["f07_name_tokens"] = lambda s, d: load(s, d, "part").select("p_partkey", F.array_join(X.name_tokens(F.concat("p_name", F.lit("-"), "p_brand", F.lit("_X"))), ",").alias("tokens"))
    q["f16_latex"] = lambda s, d: values(s, "id, t", MD).select("id", X.has_latex(F.col("t")).alias("latex"), X.wrap_formulas(F.col("t")).alias("wrapped"))
    q["f18_normalise_lines"] = lambda s, d: load(s, d, "documents").select("doc_id", F.sha2(X.normalise_lines(F.concat(F.lit(" a \t b\n\n"), "text")), 256).alias("sha"))
    q["f19_markdown_table"] = lambda s, d: selected(s, d, TABLED, "part").select("p_partkey", X.markdown_table(F.transform(F.split("t", "~"), lambda r: F.split(r, r"\|"))).alias("md"))
    q["f21_truncate"] = lambda s, d: load(s, d, "conversations").select("conv_id", "turn", X.truncate(F.col("text")).alias("short"))
    q["f31_links"] = lambda s, d: load(s, d, "documents").select("doc_id", F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".json#/sections/0")).alias("link"))
    q["f34_number_or_text"] = lambda s, d: selected(s, d, CHARTED, "part").select("p_partkey", "v", X.to_number(F.col("v")).alias("number"), F.when(X.to_number(F.col("v")).isNull(), F.col("v")).alias("text"))
    q["f17_garble"] = lambda s, d: _lines(s, d).groupBy("doc_id").agg(
        F.count_if(F.contains("line", F.lit("$$$"))).alias("n_dollars"), F.count_if(F.length("line") > 5000).alias("n_long"), F.count_if(F.col("line").rlike(r'^\{ ?"')).alias("n_json"), F.count_if(F.contains("line", F.lit("|"))).alias("n_pipes")
    )
    return q


def oracle_sql():
    q = {}
    for name, (_, _, outs) in CASES.items():
        q[name] = f"SELECT *, {', '.join(f'{e} AS {k}' for k, (_, e) in outs.items())} FROM {selected_sql(_source(name), 'part')}"
    q["f01_content_hash"] = "SELECT doc_id, sha256(text) AS sha FROM documents"
    q["f02_canonical_hash"] = "SELECT event_id, sha256('none=null' || chr(1) || 'type=' || event_type || chr(1) || 'user=' || user_id) AS sha FROM events"
    q["f04_terms"] = "SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+'), '|') AS terms FROM documents"
    q["f04_titles"] = rf"SELECT p_partkey, array_to_string(regexp_extract_all(t, '《([^》]+)》', 1), '|') AS titles, array_to_string(regexp_extract_all(t, '[\x{{4e00}}-\x{{9fff}}]{{2,6}}[梦记]'), '|') AS terms FROM {selected_sql(TITLED, 'part')}"
    q["f06_name_numbers"] = "SELECT c_custkey, regexp_extract_all(c_name, '[0-9]+')[-1] AS last FROM customer"
    q["f07_name_tokens"] = r"""WITH t AS (SELECT p_partkey, unnest(string_split(regexp_replace(lower(p_name || '-' || p_brand || '_X'), '[^\p{L}\p{N}_]', ' ', 'g'), ' ')) AS w, unnest(range(20)) AS i FROM part), f AS (SELECT p_partkey, w, min(i) AS i FROM t WHERE w <> '' GROUP BY ALL)
 SELECT p_partkey, string_agg(w, ',' ORDER BY i) AS tokens FROM f GROUP BY p_partkey"""
    q["f16_latex"] = r"SELECT * FROM (VALUES (1, false, 'Hello $x$ world'), (2, true, 'a $\frac{1}{2}$ b'), (3, true, 'x$^{2}$'), (4, false, 'plain'), (5, true, 'so $\alpha \beta_1$ end')) AS t(id, latex, wrapped)"
    q["f18_normalise_lines"] = r"""SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(' a ' || chr(9) || ' b' || chr(10) || chr(10) || text, chr(10)), lambda x: trim(regexp_replace(x, '[\x20\x09-\x0d]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS sha FROM documents"""
    q["f19_markdown_table"] = f"""WITH t AS (SELECT p_partkey, list_transform(string_split(t, '~'), lambda r: string_split(r, '|')) AS rows FROM {selected_sql(TABLED, 'part')}), w AS (SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS n FROM t),
 p AS (SELECT p_partkey, n, list_transform(rows, lambda r: '| ' || array_to_string(list_transform(range(1, n + 1), lambda k: coalesce(r[k], '')), ' | ') || ' |') AS lines FROM w)
 SELECT p_partkey, array_to_string(list_concat([lines[1], '|' || repeat(' --- |', n)], lines[2:]), chr(10)) AS md FROM p"""
    q["f21_truncate"] = "SELECT conv_id, turn, CASE WHEN length(text) > 120 THEN substr(text, 1, 119) || '…' ELSE text END AS short FROM conversations"
    q["f31_links"] = "SELECT doc_id, 'documents/' || doc_id || '.json#/sections/0' AS link FROM documents"
    number = "CASE WHEN regexp_matches(trim(v), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN TRY_CAST(trim(v) AS DOUBLE) END"
    q["f34_number_or_text"] = f"SELECT p_partkey, v, {number} AS number, CASE WHEN {number} IS NULL THEN v END AS text FROM {selected_sql(CHARTED, 'part')}"
    q["f17_garble"] = f"""SELECT doc_id, count(*) FILTER (contains(line, '$$$')) AS n_dollars, count(*) FILTER (length(line) > 5000) AS n_long, count(*) FILTER (regexp_matches(line, '^\\{{ ?"')) AS n_json, count(*) FILTER (contains(line, '|')) AS n_pipes FROM {LINES_SQL} GROUP BY doc_id"""
    return q
