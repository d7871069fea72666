"""Queries of sources and sinks (ids s*)."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import profile as P
from corvane.sources import archives as A
from corvane.sources import books as B
from corvane.sources import files as I
from corvane.sources import html as H
from corvane.sources import office as O
from corvane.sources import pdf as D
from corvane.sources import xls as L
from corvane.sources.tables import load, scratch, values, values_sql

ROWS = "('t1', 0, 'a', ''), ('t1', 1, 'x', 'y'), ('t1', 2, 'id', 'name'), ('t2', 0, 'Unnamed: 0', 'Unnamed: 1'), ('t2', 1, 'k', 'v')"
PATHS = "('/data/in/a.csv'), ('/data/in/sub/b.csv'), ('/data/in/sub/deep/c.xlsx')"
SPANS = "(1, 0, 12.0, true, 10, 10, 50, 20, 'Hello ', 0), (1, 0, 12.0, false, 50, 10, 90, 22, 'big ', 1), (1, 0, 10.0, true, 90, 9, 99, 20, 'world', 2), (1, 1, 9.0, false, 10, 40, 60, 50, 'next', 0)"
NAMES = "('a.DOCX'), ('b.pptx'), ('c.xlsm'), ('d.htm'), ('e.tsv'), ('f.md'), ('g.exe'), ('noext')"
TEXTS = "(1, 'x.md', 'plain'), (2, 'y.txt', '# a~- b~**c** d'), (3, 'z.txt', '# a~text'), (4, 'w.py', '# a~- b~> c')"
HEADS = "('D0CF11E0A1B11AE1'), ('504B030414000600'), ('255044462D312E37'), ('68656C6C6F')"


def _zip(parts: dict[str, str]) -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return buf.getvalue()


def sample_docx() -> bytes:
    w = f'xmlns:w="{O.W[1:-1]}"'
    p = lambda style, text, bold="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:rPr>{bold}<w:sz w:val="24"/></w:rPr><w:t>{text}</w:t></w:r></w:p>'
    return _zip({
        "word/styles.xml": f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/document.xml": f'<w:document {w}><w:body>{p("H1", "Title", "<w:b/>")}{p("Body", "Some text")}<w:tbl><w:tr><w:tc>{p("Body", "cell")}</w:tc></w:tr></w:tbl></w:body></w:document>',
    })


def sample_pptx() -> bytes:
    ns = f'xmlns:p="{O.P[1:-1]}" xmlns:a="{O.A[1:-1]}" xmlns:r="{O.R[1:-1]}"'
    sp = lambda ph, text, x, y: f'<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    table = '<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>1</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p><a:r><a:t>2</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    return _zip({
        "ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships xmlns="{O.REL[1:-1]}"><Relationship Id="r1" Target="slides/slide1.xml"/></Relationships>',
        "ppt/slides/slide1.xml": f'<p:sld {ns}><p:cSld><p:spTree>{sp("<p:ph type=" + chr(34) + "title" + chr(34) + "/>", "Top", 5, 6)}<p:grpSp>{sp("", "Inner", 7, 8)}</p:grpSp>{table}</p:spTree></p:cSld></p:sld>',
    })


def _files(s, name, content):
    return s.createDataFrame([(name, bytearray(content)), ("broken", bytearray(b"no zip"))], "path string, content binary")


WORKBOOK = {"One": [["id", "name", "empty"], ["1", "x", None], [None, None, None], ["2", "y & z", None]], "Two": [["k"], ["v"]]}


def _csv_round_trip(s, d):
    path = scratch(s, "nation.csv")
    load(s, d, "nation").select("n_nationkey", F.concat("n_name", F.lit(", \"q\"")).alias("n_name")).write.option("header", True).option("escape", '"').csv(path)
    return I.read_csv_guessing(s, path)


def _json_round_trip(s, d):
    path = scratch(s, "region.json")
    load(s, d, "region").coalesce(1).write.json(path)
    missing = I.read_json(s, path + "-none", "r_regionkey int, r_name string")
    return s.read.schema("r_regionkey int, r_name string").json(path).union(missing)


def _snapshot(s, d):
    path = scratch(s, "state")
    I.write_snapshot(load(s, d, "region"), path)
    I.write_snapshot(load(s, d, "nation"), path)
    return s.read.parquet(path)


def _paragraphs(s):
    gbk = "第一行\n\n  second ".encode("gbk")
    rows = [("a", bytearray("﻿ one \r\n\r\ntwo".encode())), ("b", bytearray(gbk)), ("c", bytearray(b""))]
    return I.text_paragraphs(s.createDataFrame(rows, "path string, content binary"))


def sample_epub() -> bytes:
    items = '<item id="b" href="two.xhtml" media-type="application/xhtml+xml"/><item id="a" href="one.xhtml" media-type="application/xhtml+xml"/><item id="x" href="gone.xhtml" media-type="application/xhtml+xml"/>'
    return _zip({
        "META-INF/container.xml": f'<container xmlns="{B.CONTAINER[1:-1]}"><rootfiles><rootfile full-path="ops/book.opf"/></rootfiles></container>',
        "ops/book.opf": f'<package xmlns="{B.OPF[1:-1]}"><manifest>{items}</manifest><spine><itemref idref="a"/><itemref idref="x"/><itemref idref="b"/></spine></package>',
        "ops/one.xhtml": "<html><head><title>T</title></head><body><h1>One</h1><p>First <b>chapter</b>.</p></body></html>", "ops/two.xhtml": "<html><body><p>Second.</p></body></html>",
    })


def _by_region(s, d, write):
    nation = load(s, d, "nation").select("n_regionkey", F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return L.workbooks(nation, "n_regionkey", ["key"], write).select(F.col("name").alias("path"), "content")


def _sheets(rows):
    return rows.where("pos > 0").select("sheet", F.col("cells")[0].alias("key"), F.col("cells")[1].alias("name"))


def _customers(s, d):
    """A document for each market segment and nation: a head and the customers' names."""
    c = load(s, d, "customer").select(F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"), "c_custkey", "c_name")
    lines = c.select("name", F.row_number().over(Window.partitionBy("name").orderBy("c_custkey")).alias("pos"), F.concat("c_name", F.lit(" (\\ok)")).alias("text"))
    return lines.union(c.select("name").distinct().select("name", F.lit(0), F.concat(F.lit("Customers of "), "name")))


CUSTOMERS_SQL = """c AS (SELECT c_mktsegment || '-' || c_nationkey AS name, c_custkey, c_name FROM customer),
 l AS (SELECT name AS path, CAST(row_number() OVER (PARTITION BY name ORDER BY c_custkey) AS INTEGER) AS pos, c_name || ' (\\ok)' AS text FROM c UNION ALL SELECT DISTINCT name, 0, 'Customers of ' || name FROM c)"""


def _notebooks(s, d):
    """Conversations as notebooks: what users say is text, the rest is code."""
    t = load(s, d, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    cell = F.struct("n", F.when(F.col("role") == "user", "markdown").otherwise("code").alias("cell_type"), F.col("text").alias("source"))
    cells = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return cells.select(F.col("conv_id").cast("string").alias("path"), F.to_json(F.struct(F.struct(F.struct(F.lit("text").alias("name")).alias("language_info")).alias("metadata"), "cells")).cast("binary").alias("content"))


def _project_files(s, d):
    """Documents as files of projects: sources are projects, languages agents, some of them hidden or in folders that stay."""
    t = load(s, d, "documents").where("text is not null")
    k = F.col("doc_id")
    folder = F.when(k % 4 == 0, "input").when(k % 4 == 1, "output").when(k % 4 == 2, "scratch").otherwise("summary")
    name = F.concat(F.when(k % 9 == 0, "."), F.lit("d"), k.cast("string"), F.when(k % 11 == 0, ".tmp").otherwise(".txt"))
    return t.select(F.col("source").alias("project"), F.col("lang").alias("agent"), folder.alias("folder"), F.coalesce(name, F.concat(F.lit("d"), k.cast("string"), F.when(k % 11 == 0, ".tmp").otherwise(".txt"))).alias("name"), F.col("text").cast("binary").alias("content"))


PROJECTS_SQL = """f AS (SELECT source AS project, lang AS agent, CASE doc_id % 4 WHEN 0 THEN 'input' WHEN 1 THEN 'output' ELSE 'summary' END AS folder, 'd' || doc_id || '.txt' AS name, text FROM documents WHERE text IS NOT NULL AND doc_id % 4 <> 2 AND doc_id % 9 <> 0 AND doc_id % 11 <> 0)"""


def _report(s, d, make):
    n = load(s, d, "nation").groupBy("n_regionkey", F.substring("n_name", 1, 1).alias("heading")).agg(F.array_sort(F.collect_list("n_name")).alias("lines"))
    r = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("heading", "lines"))).alias("sections"))
    return r.join(load(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", make(F.concat("r_name", F.lit(" & <all>")), F.col("sections")).alias("report"))


def queries():
    q = {}
    q["s01_scan"] = lambda s, d: I.scan(s, d, (".parquet",), recursive=False).select("name", "suffix")
    q["s02_listing"] = lambda s, d: I.scan(s, d, (".parquet", ".csv"), recursive=False).where("name like 'c%'").select("name")
    q["s03_csv_all_text"] = _csv_round_trip
    q["s04_xlsx"] = lambda s, d: O.read_xlsx(_files(s, "book", O.xlsx_bytes(WORKBOOK))).select("path", F.coalesce("sheet", F.lit("(error)")).alias("sheet"), F.coalesce("pos", F.lit(-1)).alias("pos"), F.coalesce(F.array_join("cells", ",", "NULL"), F.lit("")).alias("cells"))
    q["s05_header_row"] = lambda s, d: I.header_row(values(s, "table, pos, a, b", ROWS).select("table", "pos", F.array("a", "b", F.when(F.col("pos") == 2, "extra").otherwise("z")).alias("cells")))
    q["s06_directory_tables"] = lambda s, d: I.directory_tables(values(s, "path", PATHS), "/data/in")
    q["s07_sheet_cleaned"] = lambda s, d: P.drop_empty(O.sheet_table(O.read_xlsx(_files(s, "book", O.xlsx_bytes(WORKBOOK))), "One").drop("pos"))
    q["s08_csv_to_xlsx"] = lambda s, d: _sheets(O.read_xlsx(_by_region(s, d, O.xlsx_bytes)))
    q["s09_xls"] = lambda s, d: _sheets(L.read_xls(_by_region(s, d, L.xls_bytes)))
    q["s09_xls_to_xlsx"] = lambda s, d: _sheets(O.read_xlsx(L.to_xlsx(_by_region(s, d, L.xls_bytes)).select("path", "content")))
    q["s14_pdf_text"] = lambda s, d: D.read_pdf(D.documents_out(_customers(s, d)).select(F.col("name").alias("path"), "content")).select("path", "page", "block", "text", "size", "bold", "x0", F.col("y1").cast("int").alias("y1"))
    q["s18_notebooks"] = lambda s, d: B.read_notebook(_notebooks(s, d)).select("path", "pos", "kind", "markdown")
    q["s18_epub"] = lambda s, d: B.read_epub(_files(s, "book", sample_epub())).select("path", F.coalesce("pos", F.lit(-1)).alias("pos"), F.coalesce("name", F.lit("(error)")).alias("name"), F.coalesce("markdown", F.lit("")).alias("markdown"))
    q["s20_documents"] = lambda s, d: O.read_docx(B.documents_out(_customers(s, d).withColumn("style", F.when(F.col("pos") == 0, "heading 1"))).select(F.col("name").alias("path"), "content")).select("path", "pos", "text", "style", "level")
    q["s20_markdown_report"] = lambda s, d: _report(s, d, B.markdown_report)
    q["s20_html_report"] = lambda s, d: _report(s, d, B.html_report)
    q["s10_text_paragraphs"] = lambda s, d: _paragraphs(s)
    q["s10_document_paragraphs"] = lambda s, d: load(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select("doc_id", "pos", F.trim("text").alias("text")).where("text <> ''")
    q["s11_docx"] = lambda s, d: O.read_docx(_files(s, "doc", sample_docx())).select("path", F.coalesce("text", F.lit("(error)")).alias("text"), F.coalesce("style", F.lit("")).alias("style"), F.coalesce("level", F.lit(-1)).alias("level"), F.coalesce("in_table", F.lit(False)).alias("in_table"))
    q["s12_docx_runs"] = lambda s, d: O.read_docx(_files(s, "doc", sample_docx())).where("error is null").select("pos", F.posexplode(F.split("runs", "\t")).alias("run", "r")).select("pos", "run", F.split("r", "@")[0].alias("text"), F.split("r", "@")[1].cast("double").alias("size"), (F.split("r", "@")[2] == "1").alias("bold"))
    q["s14_block_spans"] = lambda s, d: I.block_spans(values(s, "page, block, size, bold, x0, y0, x1, y1, text, pos", SPANS).withColumn("size", F.col("size").cast("double")))
    q["s16_pptx"] = lambda s, d: O.read_pptx(_files(s, "deck", sample_pptx())).where("error is null").select("slide", "pos", "kind", "is_title", "text", "left", "top")
    q["s17_html_text"] = lambda s, d: load(s, d, "pages").select("page_id", F.sha2(H.plain_text(F.col("html")), 256).alias("sha"))
    q["s17_html_markdown"] = lambda s, d: load(s, d, "pages").select("page_id", H.markdown(F.col("html")).alias("markdown"))
    q["s18_dispatch"] = lambda s, d: values(s, "name", NAMES).select("name", I.dispatch(F.col("name")).alias("reader"))
    q["s19_json"] = _json_round_trip
    q["s21_snapshot"] = _snapshot
    q["s22_manifests"] = lambda s, d: A.manifests(_project_files(s, d))
    q["s22_archives"] = lambda s, d: A.read_archives(A.archives(_project_files(s, d)).select(F.col("name").alias("path"), "content")).select("path", "project", "name", "bytes", F.sha2("content", 256).alias("sha"))
    q["s23_file_type"] = lambda s, d: values(s, "h", HEADS).select("h", I.file_type(F.unhex("h")).alias("kind"))
    q["s24_is_markdown"] = lambda s, d: values(s, "id, name, t", TEXTS).select("id", I.is_markdown(F.col("name"), F.replace("t", F.lit("~"), F.lit("\n"))).alias("markdown"))
    return q


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def oracle_sql():
    q = {}
    q["s01_scan"] = "SELECT t.n || '.parquet' AS name, '.parquet' AS suffix FROM (VALUES " + ", ".join(f"('{t}')" for t in TABLES) + ") AS t(n)"
    q["s02_listing"] = "SELECT * FROM (VALUES ('conversations.parquet'), ('customer.parquet')) AS t(name)"
    q["s03_csv_all_text"] = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name || ', \"q\"' AS n_name FROM nation"
    q["s04_xlsx"] = "SELECT * FROM (VALUES ('book', 'One', 0::BIGINT, 'id,name,empty'), ('book', 'One', 1, '1,x'), ('book', 'One', 2, ''), ('book', 'One', 3, '2,y & z'), ('book', 'Two', 0, 'k'), ('book', 'Two', 1, 'v'), ('broken', '(error)', -1, '')) AS t(path, sheet, pos, cells)"
    q["s05_header_row"] = "SELECT * FROM (VALUES ('t1', 1), ('t2', 1)) AS t(\"table\", header_pos)"
    q["s06_directory_tables"] = f"SELECT path, replace(path, '/data/in/', '') AS relative_path, CASE WHEN contains(replace(path, '/data/in/', ''), '/') THEN string_split(replace(path, '/data/in/', ''), '/')[1] ELSE '_root' END AS \"group\" FROM {values_sql('path', PATHS)}"
    q["s07_sheet_cleaned"] = "SELECT * FROM (VALUES ('1', 'x'), ('2', 'y & z')) AS t(id, name)"
    q["s08_csv_to_xlsx"] = "SELECT CAST(n_regionkey AS VARCHAR) AS sheet, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation"
    q["s09_xls"] = q["s09_xls_to_xlsx"] = q["s08_csv_to_xlsx"]
    q["s14_pdf_text"] = f"WITH {CUSTOMERS_SQL} SELECT path, CAST(pos // 50 + 1 AS INTEGER) AS page, CAST(pos % 50 + 1 AS INTEGER) AS block, text, 11.0::DOUBLE AS size, false AS bold, 56.0::DOUBLE AS x0, CAST(floor(round(842 - (780 - 15.4 * (pos % 50)), 2)) AS INTEGER) AS y1 FROM l"
    q["s18_notebooks"] = """SELECT CAST(conv_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS pos, CASE WHEN role = 'user' THEN 'markdown' ELSE 'code' END AS kind,
 CASE WHEN role = 'user' THEN coalesce(text, '') WHEN coalesce(text, '') = '' THEN '' ELSE '```text' || chr(10) || text || chr(10) || '```' END AS markdown FROM conversations"""
    q["s18_epub"] = "SELECT * FROM (VALUES ('book', 0, 'ops/one.xhtml', '# One' || chr(10) || chr(10) || 'First **chapter**.'), ('book', 1, 'ops/two.xhtml', 'Second.'), ('broken', -1, '(error)', '')) AS t(path, pos, name, markdown)"
    q["s20_documents"] = f"WITH {CUSTOMERS_SQL} SELECT path, CAST(pos AS BIGINT) AS pos, text, CASE WHEN pos = 0 THEN 'heading 1' ELSE 'Normal' END AS style, CASE WHEN pos = 0 THEN 1 ELSE 0 END AS level FROM l"
    reports = lambda part, whole: f"WITH g AS (SELECT n_regionkey AS k, substr(n_name, 1, 1) AS h, {part} AS t FROM nation GROUP BY n_regionkey, substr(n_name, 1, 1)) SELECT r_regionkey, {whole} AS report FROM g JOIN region ON k = r_regionkey GROUP BY r_regionkey, r_name"
    q["s20_markdown_report"] = reports("'## ' || substr(n_name, 1, 1) || chr(10) || chr(10) || string_agg('- ' || n_name, chr(10) ORDER BY n_name)", "'# ' || r_name || ' & <all>' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY h)")
    title = "r_name || ' &amp; &lt;all&gt;'"
    q["s20_html_report"] = reports("'<h2>' || substr(n_name, 1, 1) || '</h2><ul>' || string_agg('<li>' || n_name || '</li>', '' ORDER BY n_name) || '</ul>'", f"'<!DOCTYPE html><html><head><meta charset={chr(34)}utf-8{chr(34)}><title>' || {title} || '</title></head><body><h1>' || {title} || '</h1>' || string_agg(t, '' ORDER BY h) || '</body></html>'")
    q["s10_text_paragraphs"] = "SELECT * FROM (VALUES ('a', 0, 'one'), ('a', 2, 'two'), ('b', 0, '第一行'), ('b', 2, 'second')) AS t(path, pos, text)"
    q["s10_document_paragraphs"] = "SELECT doc_id, pos, trim(t) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS pos FROM documents) WHERE trim(t) <> ''"
    q["s11_docx"] = "SELECT * FROM (VALUES ('doc', 'Title', 'heading 1', 1, false), ('doc', 'Some text', 'Body', 0, false), ('doc', 'cell', 'Body', 0, true), ('broken', '(error)', '', -1, false)) AS t(path, text, style, level, in_table)"
    q["s12_docx_runs"] = "SELECT * FROM (VALUES (0::BIGINT, 0, 'Title', 12.0::DOUBLE, true), (1, 0, 'Some text', 12.0, false), (2, 0, 'cell', 12.0, false)) AS t(pos, run, text, size, bold)"
    q["s14_block_spans"] = f"SELECT page, block, CAST(mode(size) AS DOUBLE) AS size, avg(CAST(bold AS INTEGER)) > 0.5 AS bold, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, '' ORDER BY pos) AS text FROM {values_sql('page, block, size, bold, x0, y0, x1, y1, text, pos', SPANS)} GROUP BY page, block"
    q["s16_pptx"] = "SELECT * FROM (VALUES (1, 0, 'text', true, 'Top', 5::BIGINT, 6::BIGINT), (1, 1, 'text', false, 'Inner', 7, 8), (1, 2, 'table', false, '1|2', 0, 0)) AS t(slide, pos, kind, is_title, text, \"left\", top)"
    # the forms of this table's pages, in the order in which they nest
    steps = [("(?s)<head>.*?</head>|<!--.*?-->", ""), ("<h1>", "\n\n# "), ("</?p>|</h1>|<(div|article|section)[^>]*>", "\n\n"), ("<br>|<ul>", "\n"), ("<li>", "\n- "), ('<a href="([^"]*)">([^<]*)</a>', r"[\2](\1)"), ("</?b>", "**"), ("<[^>]*>", "")]
    md = "html"
    for pattern, new in steps:
        md = f"regexp_replace({md}, '{pattern}', '{new}', 'g')"
    for name, c in (("copy", "©"), ("middot", "·"), ("nbsp", "\u00a0"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        md = f"replace({md}, '&{name};', '{c}')"
    q["s17_html_markdown"] = f"SELECT page_id, trim(regexp_replace({md}, '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ') AS markdown FROM pages"
    q["s17_html_text"] = f"SELECT page_id, sha256({H.PLAIN_SQL}) AS sha FROM pages"
    q["s18_dispatch"] = r"WITH n AS (SELECT name, lower(regexp_extract(name, '\.([^.]+)$', 1)) AS e FROM " + values_sql("name", NAMES) + ") SELECT name, CASE WHEN e IN ('docx') THEN 'docx' WHEN e = 'pptx' THEN 'pptx' WHEN e IN ('xlsx', 'xlsm') THEN 'xlsx' WHEN e IN ('html', 'htm') THEN 'html' WHEN e IN ('csv', 'tsv') THEN 'csv' WHEN e IN ('txt', 'md') THEN 'text' ELSE 'unsupported' END AS reader FROM n"
    q["s19_json"] = "SELECT r_regionkey, r_name FROM region"
    q["s21_snapshot"] = "SELECT * FROM nation"
    q["s22_archives"] = f"WITH {PROJECTS_SQL} SELECT project || '.zip' AS path, project, agent || '/' || folder || '/' || name AS name, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha FROM f"
    q["s22_manifests"] = f"""WITH {PROJECTS_SQL}, a AS (SELECT project, agent, '["' || array_to_string(list_sort(list(DISTINCT folder)), '","') || '"]' AS folders, count(*) AS n, sum(strlen(text)) AS b FROM f GROUP BY project, agent)
 SELECT project, '{{"format_version":"1.0","project_name":"' || project || '","scope":"results","agents":[' || string_agg('{{"name":"' || agent || '","folders":' || folders || ',"artifact_count":' || n || '}}', ',' ORDER BY agent) || '],"total_files":' || sum(n) || ',"total_size_bytes":' || sum(b) || '}}' AS manifest FROM a GROUP BY project"""
    q["s23_file_type"] = "SELECT h, CASE WHEN starts_with(h, 'D0CF11E0') THEN 'ole' WHEN starts_with(h, '504B0304') THEN 'zip' WHEN substr(h, 1, 10) = '255044462D' THEN 'pdf' ELSE 'unknown' END AS kind FROM " + values_sql("h", HEADS)
    q["s24_is_markdown"] = "SELECT * FROM (VALUES (1, true), (2, true), (3, false), (4, false)) AS t(id, markdown)"
    return q
