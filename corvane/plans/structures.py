"""Queries of document structure and format rules (ids w*, p7-p10, a14-a16, a26, a28-a29, r*, s13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import language as N
from corvane.operators import rules as R
from corvane.operators import structure as T
from corvane.plans.texts import PLAIN_SQL
from corvane.sources.tables import load, selected, selected_sql, values, values_sql

PARAS = "(1, 0, 'My thesis'), (1, 1, '目录'), (1, 2, '1.1 x'), (1, 3, 'Chapter 1'), (1, 4, 'words and words and words and more words here'), (1, 5, 'Short one'), (1, 6, 'again a long paragraph of many many words'), (1, 7, 'References'), (1, 8, '[1] A'), (2, 0, 'Introduction'), (2, 1, ''), (2, 2, ' '), (2, 3, ''), (2, 4, 'Page 3'), (2, 5, '12'), (2, 6, 'Table 1 Things'), (2, 7, 'see http://x.y')"
BLOCKS = "(1, 0, 'p', 'Table 1 Good'), (1, 1, 'tbl', ''), (1, 2, 'p', 'Table 2 Bad'), (1, 3, 'p', 'text'), (2, 0, 'p', '表 3 末')"
SIZES = ", ".join(f"({d}, {s})" for d, ss in {1: [10.5] * 5 + [16, 16, 22], 2: [12] * 3 + [18], 3: [20, 24, 24, 30], 4: [11, 11, 14, 16, 20, 26], 5: [12, 12, 13], 6: [10, 10, 15, 18, 24]}.items() for s in ss)
FORMATS = "(1, 0, 'both', 1.5, 24.0, NULL), (1, 1, 'left', 1.55, NULL, 2.0), (1, 2, NULL, 2.0, 10.0, 1.0)"
CELLS = "(1, 1, 0, 0, true, true, false), (1, 1, 1, 0, false, true, false), (1, 2, 0, 0, false, true, true), (1, 2, 1, 0, false, false, false)"
STYLE_ROWS = "(1, 0, 'body', 'Heading 1', 'left', 'Arial', 12.0), (1, 1, 'cover', 'Normal', 'center', 'Kai', 20.0), (1, 2, 'body', 'Normal', 'left', 'Arial', 9.0)"
RULES = "('body', 'SimSun', 10.5, false), ('Heading 1', 'SimHei', 16.0, true)"
RUNS = "(1, 0, 'Heading 1', 'T', 'SimHei', 16.2, true), (1, 1, 'Normal', 'x', 'Arial', 12.0, false), (1, 2, 'Normal', ' ', 'Arial', 12.0, true), (1, 3, 'Heading 1', 'y', 'SimHei', 10.0, false)"
HEADS = "(1, 0, 'head', 0, 9.0), (1, 1, 'Big title', 0, 16.0), (1, 2, '王小明1,2', 0, 10.0), (1, 3, '2024年3月7日', 0, 10.0), (2, 0, 'ab', 0, 10.0), (2, 1, 'Longer', 0, CAST(NULL AS DOUBLE)), (2, 2, 'Part one', 1, 20.0)"
STEPS = "('w1', 0, 's1', 'First', 'agent'), ('w1', 1, '', 'Second', 'agent'), ('w2', 0, 's1', NULL, 'shell')"

# tables read as slides, states, names, relationships, lines and sections: the same SELECT for every engine
LINE_ITEMS = {
    "w02": ("SELECT l_orderkey AS doc_id, l_linenumber AS pos, CASE WHEN l_suppkey % 4 = 0 THEN '# One' WHEN l_suppkey % 4 = 1 THEN '### Two' ELSE 'text' END AS line FROM {lineitem}", "lineitem"),
    "w06": ("SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS pos, CASE WHEN event_id % 4 > 0 THEN ' ' ELSE 'x' END AS text FROM {events}", "events"),
    "w08": ("SELECT l_orderkey AS doc_id, l_linenumber AS pos, CASE WHEN l_suppkey % 3 = 0 THEN '```' ELSE 'x' END AS line FROM {lineitem}", "lineitem"),
    "w10": ("SELECT l_orderkey AS slide, l_linenumber AS shape, l_suppkey % 5 AS top, l_partkey % 3 AS lft FROM {lineitem}", "lineitem"),
    "w15": ("SELECT user_id AS project, CASE event_type WHEN 'click' THEN 'Running' WHEN 'signup' THEN 'idle' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'odd' END AS status, event_id AS updated_at FROM {events} WHERE user_id % 4 > 0 OR event_type <> 'click'", "events"),
    "w16": ("SELECT c_mktsegment AS kind, c_name AS name FROM {customer}", "customer"),
    "a28": ("SELECT l_orderkey AS part, CASE WHEN l_suppkey % 7 > 0 THEN l_linenumber % 3 END AS rel_id, CASE WHEN l_suppkey % 5 = 0 THEN '' WHEN l_suppkey % 5 = 1 THEN NULL ELSE 'x' END AS target FROM {lineitem}", "lineitem"),
    "r01": ("SELECT o_orderkey AS doc_id, 21.0 + (o_orderkey % 7) * 0.2 AS w_cm, 29.7 - (o_orderkey % 5) * 0.2 AS h_cm, 2.5 + (o_custkey % 3) * 0.2 AS top_cm, 2.5 AS bottom_cm, 3.0 - (o_custkey % 4) * 0.2 AS left_cm, 2.5 AS right_cm FROM {orders}", "orders"),
    "r10": ("SELECT p_partkey AS idea, p_partkey % 11 = 0 AS fatal_flaw, CAST(p_partkey % 37 AS INT) AS total FROM {part}", "part"),
}

#: A part takes the sizes of one of the documents of SIZES.
SIZE_PARTS = f"SELECT p_partkey * 10 + v.doc_id AS doc_id, v.size AS size FROM {{part}} JOIN (SELECT * FROM (VALUES {SIZES}) AS t(doc_id, size)) v ON p_partkey % 6 + 1 = v.doc_id"


def _from(s, d, key):
    return selected(s, d, *LINE_ITEMS[key])


def _from_sql(key):
    return selected_sql(*LINE_ITEMS[key])


#: A part takes one of the papers of PARAS, with its name behind the longer paragraphs.
PAPERS = f"""SELECT p_partkey * 10 + v.doc_id AS doc_id, v.pos AS pos, CASE WHEN length(v.text) > 25 THEN concat(v.text, ' ', p_name) ELSE v.text END AS text
 FROM {{part}} JOIN (SELECT * FROM (VALUES {PARAS.replace("{", "{{").replace("}", "}}")}) AS t(doc_id, pos, text)) v ON p_partkey % 2 + 1 = v.doc_id"""


def _paras(s, d):
    return selected(s, d, PAPERS, "part")


def _lines(s, d):
    return T.lines_of(load(s, d, "documents"))


LINES_SQL = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS pos FROM documents)"


def _messages(s, d):
    line = F.col("line")
    return _lines(s, d).select("doc_id", F.when(F.contains(line, F.lit("$$$")), "ERROR").when(F.contains(line, F.lit("|")), "WARNING").otherwise("INFO").alias("severity"))


MESSAGES_SQL = f"(SELECT doc_id, CASE WHEN contains(line, '$$$') THEN 'ERROR' WHEN contains(line, '|') THEN 'WARNING' ELSE 'INFO' END AS severity FROM {LINES_SQL})"


def _issues(s, d):
    return _messages(s, d).select("doc_id", F.lit("content").alias("category"), F.when(F.col("severity") == "ERROR", "critical").when(F.col("severity") == "WARNING", "warning").otherwise("info").alias("severity"))


ISSUES_SQL = f"(SELECT doc_id, 'content' AS category, CASE severity WHEN 'ERROR' THEN 'critical' WHEN 'WARNING' THEN 'warning' ELSE 'info' END AS severity FROM {MESSAGES_SQL})"
COUNTS = "concat('# T\n![a](b) [c](d)\n|x|', text)"


def _formats(s, d):
    """Lines of documents as paragraphs, some of them against the format."""
    n = F.length("line")
    return _lines(s, d).select("doc_id", "pos", F.when(n % 4 == 0, "left").otherwise("both").alias("alignment"), F.when(n % 5 == 0, 2.0).otherwise(1.5).alias("line"), F.lit(0.0).alias("first_line"), F.when(n % 7 == 0, 0.0).otherwise(2.0).alias("first_line_chars"))


def queries():
    q = {}
    q["f32_language"] = lambda s, d: N.detect(load(s, d, "documents"), N.profiles(load(s, d, "documents")))
    q["r06_inspect_and_fix"] = lambda s, d: R.inspect_and_fix(_formats(s, d), R.paragraph_issues, R.fix_paragraphs)[1]
    q["r06_grades_after"] = lambda s, d: R.grade(R.paragraph_issues(R.inspect_and_fix(_formats(s, d), R.paragraph_issues, R.fix_paragraphs)[0]))
    q["w02_markdown_sections"] = lambda s, d: T.markdown_sections(_from(s, d, "w02"))
    q["w03_regions"] = lambda s, d: T.regions(_paras(s, d))
    q["w04_neighbour_headings"] = lambda s, d: T.neighbour_headings(_lines(s, d).withColumnRenamed("line", "text"))
    q["w05_captions"] = lambda s, d: T.captions_with_tables(values(s, "doc_id, pos, tag, text", BLOCKS))
    q["w06_empty_runs"] = lambda s, d: T.empty_runs(_from(s, d, "w06"))
    q["w07_mentions_at_end"] = lambda s, d: T.mentions_at_end(_lines(s, d).withColumnRenamed("line", "text"), "[Ll]icense")
    q["w08_fenced"] = lambda s, d: T.fenced(_from(s, d, "w08"))
    q["w08_json_blocks"] = lambda s, d: T.json_blocks(_lines(s, d).select("doc_id", "pos", F.when(F.col("pos") == 1, F.lit('{"a": [1, 2]}')).otherwise(F.col("line")).alias("line")))
    q["w10_reading_order"] = lambda s, d: T.reading_order(_from(s, d, "w10").withColumnRenamed("lft", "left"))
    q["w14_first_match"] = lambda s, d: T.first_match(_lines(s, d).withColumnRenamed("line", "text"), F.length("text") > 60, "first_long")
    q["w14_document_heads"] = lambda s, d: T.document_heads(values(s, "doc_id, pos, text, level, font_size", HEADS).withColumn("font_size", F.col("font_size").cast("double")))
    q["w15_latest_state"] = lambda s, d: T.latest_state(_from(s, d, "w15"))
    q["w16_sequential_ids"] = lambda s, d: T.sequential_ids(_from(s, d, "w16"), "kind", "name")
    q["a14_font_levels"] = lambda s, d: T.font_levels(selected(s, d, SIZE_PARTS, "part").withColumn("size", F.col("size").cast("double")))
    q["p07_noise"] = lambda s, d: _paras(s, d).select("*", T.is_noise(F.col("text")).alias("noise"))
    q["p08_short_blocks"] = lambda s, d: _lines(s, d).where(T.is_short_block(F.col("line")))
    q["p09_protected_text"] = lambda s, d: _paras(s, d).select("*", T.is_protected(F.col("text")).alias("protected"))
    q["p10_protected_section"] = lambda s, d: T.regions(_paras(s, d)).select("doc_id", "pos", T.is_protected_section(F.col("region")).alias("protected"))
    q["a29_markdown_counts"] = lambda s, d: load(s, d, "documents").select("doc_id", *[c.alias(k) for k, c in T.markdown_counts(F.concat(F.lit("# T\n![a](b) [c](d)\n|x|"), "text")).items()])
    q["a15_grades"] = lambda s, d: R.grade(_issues(s, d))
    q["a15_by_category"] = lambda s, d: R.by_category(_issues(s, d))
    q["a16_report_status"] = lambda s, d: R.report_status(_messages(s, d))
    q["a26_summary_report"] = lambda s, d: R.summary_report(load(s, d, "documents").select("doc_id"), {"n_bad": load(s, d, "labels").where("quality = 0").select("doc_id", F.lit(1).alias("n")), "n_toxic": load(s, d, "labels").where("toxic = 1").select("doc_id", F.lit(2).alias("n"))})
    q["a28_xml_checks"] = lambda s, d: R.xml_checks(_from(s, d, "a28"))
    q["r01_page"] = lambda s, d: R.page_issues(_from(s, d, "r01").select("doc_id", *[F.col(c).cast("double").alias(c) for c in ("w_cm", "h_cm", "top_cm", "bottom_cm", "left_cm", "right_cm")]))
    q["r02_fonts"] = lambda s, d: R.font_issues(
        values(s, "doc_id, pos, style, text, font, size, bold", RUNS).groupBy("doc_id", "pos", "style").agg(F.collect_list(F.struct("text", "font", F.col("size").cast("double").alias("size"), "bold")).alias("runs")), values(s, "style, font, size, bold", RULES).withColumn("size", F.col("size").cast("double"))
    )
    q["r03_paragraphs"] = lambda s, d: R.paragraph_issues(values(s, "doc_id, pos, alignment, line, first_line, first_line_chars", FORMATS).select("doc_id", "pos", "alignment", *[F.col(c).cast("double").alias(c) for c in ("line", "first_line", "first_line_chars")]))
    q["r04_tables"] = lambda s, d: R.table_issues(values(s, "doc_id, table_id, row, col, top, bottom, side", CELLS))
    q["r05_heading_numbers"] = lambda s, d: _paras(s, d).where(F.col("text").rlike("^(Chapter|Introduction)")).select("doc_id", "pos", F.col("text").rlike(r"^(Chapter )?[0-9]").alias("numbered"))
    q["r07_normalised_style"] = lambda s, d: R.normalised_style(values(s, "doc_id, pos, region, style, alignment, font, size", STYLE_ROWS).withColumn("size", F.col("size").cast("double")))
    q["s13_merged_style"] = lambda s, d: R.merged_style(values(s, "doc_id, pos, style_id, font, size", "(1, 0, 'a', '', NULL), (1, 1, 'a', 'Kai', 12), (1, 2, 'z', '', 9)"), values(s, "style_id, font, size", "('a', 'Song', 10)"))
    q["r09_workflow"] = lambda s, d: R.workflow_issues(values(s, "workflow, pos, id, name, type", STEPS))
    q["r10_idea_verdict"] = lambda s, d: R.idea_verdict(_from(s, d, "r10").withColumn("scores", F.array("total", F.lit(0))))
    return q


def oracle_sql():
    q = {}
    q["w08_json_blocks"] = "SELECT doc_id, 1::BIGINT AS start, 1::BIGINT AS \"end\", true AS valid FROM documents WHERE len(string_split(text, chr(10))) > 1"  # prose lines open no braces
    q["f32_language"] = rf"""WITH h AS (SELECT doc_id, lang, ' ' || regexp_replace(lower(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:{N.PARAGRAPHS}], ' ')), '[\x20\x09-\x0d0-9]+', ' ', 'g') || ' ' AS t FROM documents WHERE text IS NOT NULL),
 g AS (SELECT doc_id, lang, unnest(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS gram FROM h WHERE length(t) > 2),
 p AS (SELECT lang, gram, count(*) AS n FROM g WHERE lang IS NOT NULL GROUP BY ALL), tot AS (SELECT lang, sum(n) AS nn FROM p GROUP BY lang),
 k AS (SELECT lang, gram, ln(n + 1.0) AS gain FROM p), b AS (SELECT lang, -ln(nn + (SELECT count(DISTINCT gram) FROM p)) AS base FROM tot),
 d AS (SELECT doc_id, gram, count(*) AS n FROM g GROUP BY ALL), sz AS (SELECT doc_id, sum(n) AS size FROM d GROUP BY doc_id),
 sc AS (SELECT d.doc_id, k.lang, sum(d.n * gain) AS gain FROM d JOIN k ON d.gram = k.gram GROUP BY ALL), r AS (SELECT sc.doc_id, sc.lang, row_number() OVER (PARTITION BY sc.doc_id ORDER BY round(gain + size * base, 6) DESC, sc.lang) AS rank FROM sc JOIN sz ON sc.doc_id = sz.doc_id JOIN b ON sc.lang = b.lang)
 SELECT o.doc_id, r.lang AS language FROM documents o LEFT JOIN r ON o.doc_id = r.doc_id AND rank = 1"""
    fixes = f"""n AS (SELECT doc_id, count(*) FILTER (length(line) % 7 = 0) AS c, count(*) FILTER (length(line) % 4 = 0) AS al, count(*) FILTER (length(line) % 5 = 0) AS ln FROM {LINES_SQL} GROUP BY doc_id)"""
    q["r06_inspect_and_fix"] = f"""WITH {fixes} SELECT doc_id, 1 AS round, 'indent' AS rule, c AS n FROM n WHERE c > 0 UNION ALL SELECT doc_id, 1 + CAST(c > 0 AS INTEGER), 'alignment', al FROM n WHERE al + ln > 5 AND al > 0
 UNION ALL SELECT doc_id, 1 + CAST(c > 0 AS INTEGER) + CAST(al > 0 AS INTEGER), 'line', ln FROM n WHERE al + ln > 5 AND (al = 0 OR ln > 5)"""
    q["r06_grades_after"] = f"""WITH {fixes}, f AS (SELECT doc_id, CASE WHEN al + ln > 5 THEN 0 ELSE al END + CASE WHEN al + ln > 5 AND (al = 0 OR ln > 5) THEN 0 ELSE ln END AS n_warning FROM n)
 SELECT doc_id, 0::BIGINT AS n_critical, CAST(n_warning AS BIGINT) AS n_warning, 'A-' AS grade FROM f WHERE n_warning > 0"""
    q["w02_markdown_sections"] = f"""WITH t AS (SELECT *, CAST(regexp_matches(line, '^#+ *[^# ]') AS INTEGER) AS h FROM {_from_sql("w02")}), c AS (SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM t)
 SELECT doc_id, CAST(section AS BIGINT) AS section, max(CASE WHEN h = 1 THEN regexp_replace(line, '^#+ *', '') END) AS title, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (h = 0), '') AS body FROM c WHERE section > 0 GROUP BY doc_id, section"""
    regions = rf"""p AS (SELECT doc_id, pos, text AS t, {PLAIN_SQL.replace(chr(10), " ")} > 0 AS h, regexp_matches(lower(trim(text)), '{T.CONTENTS_WORDS}') AS c, regexp_matches(lower(trim(text)), '{T.REFERENCE_WORDS}') AS r, length(trim(text)) > 5 AS l FROM (SELECT *, text AS t FROM {selected_sql(PAPERS, "part")})),
 f AS (SELECT *, min(pos) FILTER (c) OVER (PARTITION BY doc_id) AS first FROM p), e AS (SELECT *, min(pos) FILTER (h AND pos >= first) OVER (PARTITION BY doc_id) AS e FROM f),
 m AS (SELECT doc_id, min(pos) FILTER (h) AS head, min(pos) FILTER (l) AS long, min(pos) FILTER (r) AS ref, max(e) AS toc_end, max(pos) FILTER (c AND (e IS NULL OR pos <= e)) AS toc, max(pos) AS last FROM e GROUP BY doc_id),
 g AS (SELECT p.doc_id, pos, t AS text, CASE WHEN pos >= toc AND pos < coalesce(toc_end, least(toc + 20, last + 1)) THEN 'toc' WHEN pos < coalesce(head, long, 0) THEN 'cover' WHEN pos >= ref THEN 'references' ELSE 'body' END AS region FROM p JOIN m ON p.doc_id = m.doc_id)"""
    q["w03_regions"] = f"WITH {regions} SELECT * FROM g"
    q["w04_neighbour_headings"] = rf"""WITH n AS (SELECT doc_id, pos, line AS t, length(trim(line)) AS n, lag(length(trim(line))) OVER w AS b, lead(length(trim(line))) OVER w AS a FROM {LINES_SQL} WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), o AS (SELECT *, {PLAIN_SQL} AS own FROM n)
 SELECT doc_id, pos, CASE WHEN own > 0 THEN own WHEN n > 0 AND n <= 40 AND NOT regexp_matches(t, '{T.PAUSES}') AND ((b > 100 AND a > 100) OR (b = 0 AND a > 80) OR (b <= 40 AND a > 120 AND n <= 25)) THEN 2 ELSE 0 END AS level FROM o"""
    q["w05_captions"] = "SELECT * FROM (VALUES (1, 0, true), (1, 2, false), (2, 0, false)) AS t(doc_id, pos, has_table)"
    q["w06_empty_runs"] = f"""WITH e AS (SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM {_from_sql("w06")} WHERE trim(text) = ''), r AS (SELECT doc_id, i, min(pos) AS first_pos, count(*) AS n FROM e GROUP BY ALL HAVING count(*) > 2)
 SELECT doc_id, min(first_pos) AS first_pos, arg_min(n, first_pos) AS n FROM r GROUP BY doc_id"""
    q["w07_mentions_at_end"] = f"WITH t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS r FROM {LINES_SQL}) SELECT doc_id, bool_or(regexp_matches(line, '[Ll]icense')) AS found FROM t WHERE r <= 10 GROUP BY doc_id"
    q["w08_fenced"] = f"SELECT doc_id, pos, sum(CAST(starts_with(line, '```') AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AND NOT starts_with(line, '```') AS inside FROM {_from_sql('w08')}"
    q["w10_reading_order"] = f'SELECT slide, shape, top, lft AS "left", CAST(row_number() OVER (PARTITION BY slide ORDER BY top, lft, shape) AS INTEGER) AS "order" FROM {_from_sql("w10")}'
    q["w14_first_match"] = f"SELECT doc_id, arg_min(line, pos) FILTER (length(line) > 60) AS first_long FROM {LINES_SQL} GROUP BY doc_id"
    q["w14_document_heads"] = "SELECT * FROM (VALUES (1, 'Big title', '王小明1,2', '2024-03-07'), (2, 'Longer', '', '')) AS t(doc_id, title, author, date)"
    q["w15_latest_state"] = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY CASE WHEN lower(status) IN ('running', 'processing', 'active') THEN 0 WHEN lower(status) IN ('idle', 'pending', 'initializing') THEN 1 WHEN lower(status) IN ('completed', 'success') THEN 3 WHEN lower(status) IN ('failed', 'error') THEN 4 ELSE 2 END, updated_at DESC) AS k
 FROM {_from_sql("w15")}) SELECT project, status, updated_at FROM r WHERE k = 1"""
    q["w16_sequential_ids"] = f"SELECT kind, name, printf('%s_%03d', kind, row_number() OVER (PARTITION BY kind ORDER BY name)) AS id FROM {_from_sql('w16')}"
    q["a14_font_levels"] = "SELECT p_partkey * 10 + t.doc_id AS doc_id, body, title, h1, h2, h3 FROM part JOIN (VALUES (1, 10.5::DOUBLE, 22.0::DOUBLE, 16.0::DOUBLE, 11.0::DOUBLE, 10.5::DOUBLE), (2, 12.0, 18.0, 13.0, 12.5, 12.0), (3, 24.0, 30.0, 25.0, 24.5, 24.0), (4, 11.0, 26.0, 20.0, 16.0, 14.0), (5, 12.0, 12.0, 12.0, 12.0, 12.0), (6, 10.0, 24.0, 18.0, 15.0, 10.5)) AS t(doc_id, body, title, h1, h2, h3) ON p_partkey % 6 + 1 = t.doc_id"
    q["p07_noise"] = rf"SELECT *, regexp_matches(text, '^[0-9]{{1,3}}$') OR (length(text) <= 80 AND regexp_matches(text, '{T.BOILERPLATE}')) AS noise FROM {selected_sql(PAPERS, 'part')}"
    q["p08_short_blocks"] = rf"SELECT doc_id, pos, line FROM {LINES_SQL} WHERE length(line) <= 2 AND NOT regexp_matches(line, '{T.KEPT_WORDS}')"
    q["p09_protected_text"] = f"SELECT *, contains(text, 'Figure') OR contains(text, 'Table') OR contains(text, 'http') OR contains(text, 'DOI') AS protected FROM {selected_sql(PAPERS, 'part')}"
    q["p10_protected_section"] = f"WITH {regions} SELECT doc_id, pos, region IN ('cover', 'toc') AS protected FROM g"
    q["a29_markdown_counts"] = r"""WITH t AS (SELECT doc_id, '# T' || chr(10) || '![a](b) [c](d)' || chr(10) || '|x|' || text AS t FROM documents)
 SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0d]+'), lambda x: x <> '')) AS BIGINT) AS n_words, CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines, CAST(len(list_filter(string_split(t, chr(10)), lambda x: starts_with(x, '|'))) AS BIGINT) AS n_table_lines,
 CAST((length(t) - length(replace(t, '![', ''))) / 2 AS BIGINT) AS n_images, CAST(greatest(length(t) - length(replace(t, '[', '')) - (length(t) - length(replace(t, '![', ''))) / 2, 0) AS BIGINT) AS n_links, 'T' AS title FROM t"""
    n = f"(SELECT doc_id, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'warning') AS n_warning FROM {ISSUES_SQL} GROUP BY doc_id)"
    q["a15_grades"] = f"SELECT *, CASE WHEN n_critical > 5 THEN 'D' WHEN n_critical > 2 THEN 'C' WHEN n_critical > 0 OR n_warning > 5 THEN 'B' WHEN n_warning > 0 THEN 'A-' ELSE 'A' END AS grade FROM {n}"
    q["a15_by_category"] = f"SELECT doc_id, category, count(*) AS n, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'warning') AS n_warning FROM {ISSUES_SQL} GROUP BY ALL"
    q["a16_report_status"] = f"""WITH n AS (SELECT doc_id, count(*) FILTER (severity = 'ERROR') AS n_error, count(*) FILTER (severity = 'WARNING') AS n_warning, count(*) FILTER (severity = 'INFO') AS n_info FROM {MESSAGES_SQL} GROUP BY doc_id)
 SELECT *, CASE WHEN n_error > 0 THEN 'FAIL' WHEN n_warning > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM n"""
    q["a26_summary_report"] = "SELECT d.doc_id, CAST(CASE WHEN l.quality = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_bad, CAST(CASE WHEN l.toxic = 1 THEN 2 ELSE 0 END AS BIGINT) AS n_toxic, CAST(CASE WHEN l.quality = 0 THEN 1 ELSE 0 END + CASE WHEN l.toxic = 1 THEN 2 ELSE 0 END AS BIGINT) AS total FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
    q["a28_xml_checks"] = f"SELECT part, count(*) AS n, count(rel_id) - count(DISTINCT rel_id) AS n_repeated, count(*) FILTER (coalesce(target, '') = '') AS n_empty FROM {_from_sql('a28')} GROUP BY part"
    sides = [("width", "w_cm", 21.0, 0.5), ("height", "h_cm", 29.7, 0.5), ("top", "top_cm", 2.5, 0.3), ("bottom", "bottom_cm", 2.5, 0.3), ("left", "left_cm", 3.0, 0.3), ("right", "right_cm", 2.5, 0.3)]
    cols = "doc_id, w_cm, h_cm, top_cm, bottom_cm, left_cm, right_cm"
    q["r01_page"] = " UNION ALL ".join(f"SELECT doc_id, 'page' AS category, '{'critical' if t == 0.5 else 'warning'}' AS severity, '{n}' AS side, CAST({v} AS DOUBLE) AS expected, CAST({c} AS DOUBLE) AS actual FROM {_from_sql('r01')} WHERE abs(CAST({c} AS DOUBLE) - {v}) > {t}" for n, c, v, t in sides)
    q["r02_fonts"] = "SELECT * FROM (VALUES (1, 1, 'font', 'SimSun', 'Arial'), (1, 1, 'size', '10.5', '12.0'), (1, 3, 'size', '16.0', '10.0'), (1, 3, 'bold', 'true', 'false')) AS t(doc_id, pos, rule, expected, actual)"
    q["r03_paragraphs"] = "SELECT * FROM (VALUES (1, 'paragraph', 'warning', 'alignment', 'both', 'left', 'p1'), (1, 'paragraph', 'warning', 'alignment', 'both', 'left', 'p2'), (1, 'paragraph', 'warning', 'line', '1.5', '2.0', 'p2'), (1, 'paragraph', 'critical', 'indent', '2 characters', '1.0', 'p2')) AS t(doc_id, category, severity, rule, expected, actual, location)"
    q["r04_tables"] = "SELECT * FROM (VALUES (1, 2, 0, 0, 'no top line'), (1, 2, 0, 0, 'side line'), (1, 2, 1, 0, 'no bottom line')) AS t(doc_id, table_id, row, col, rule)"
    q["r05_heading_numbers"] = f"SELECT doc_id, pos, regexp_matches(text, '^(Chapter )?[0-9]') AS numbered FROM {selected_sql(PAPERS, 'part')} WHERE regexp_matches(text, '^(Chapter|Introduction)')"
    q["r07_normalised_style"] = "SELECT * FROM (VALUES (1, 0, 'center', 'SimHei', 16.0::DOUBLE), (1, 1, 'center', 'Kai', 20.0), (1, 2, 'both', 'SimSun', 10.5)) AS t(doc_id, pos, alignment, font, size)"
    q["s13_merged_style"] = "SELECT * FROM (VALUES (1, 0, 'Song', 10), (1, 1, 'Kai', 12), (1, 2, NULL, 9)) AS t(doc_id, pos, font, size)"
    q["r09_workflow"] = "SELECT * FROM (VALUES ('w1', 1, 'no id'), ('w2', 0, 'no name'), ('w2', 0, 'unknown type')) AS t(workflow, pos, problem)"
    q["r10_idea_verdict"] = f"SELECT idea, total, CASE WHEN fatal_flaw THEN 'reject' WHEN total >= 20 THEN 'accept' ELSE 'revise' END AS verdict FROM {_from_sql('r10')}"
    return q
