"""Electronic books and notebooks as Markdown, and reports out of Markdown."""

from __future__ import annotations

import io
import json
import posixpath
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.html import markdown
from corvane.sources.office import W, _reader

# fixed values: namespaces of the formats
CONTAINER = "{urn:oasis:names:tc:opendocument:xmlns:container}"
OPF = "{http://www.idpf.org/2007/opf}"


def epub_chapters(content: bytes) -> Iterator[tuple[int, str, str]]:
    """(pos, name, html) of the chapters in reading order; entries of the spine that are missing are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        there = set(z.namelist())
        package = ET.fromstring(z.read("META-INF/container.xml")).find(f".//{CONTAINER}rootfile").get("full-path", "")
        book = ET.fromstring(z.read(package))
        items = {i.get("id", ""): (i.get("href", ""), i.get("media-type", "")) for i in book.iter(f"{OPF}item")}
        pos = 0
        for ref in book.iter(f"{OPF}itemref"):
            href, kind = items.get(ref.get("idref", ""), ("", ""))
            name = posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(href)))
            if "html" in kind and name in there:
                yield pos, name, z.read(name).decode("utf-8-sig", "replace")
                pos += 1


def notebook_cells(content: bytes) -> Iterator[tuple[int, str, str]]:
    """(pos, kind, Markdown) of the cells: text as it is, code fenced in its language, text outputs indented below."""
    book = json.loads(content.decode("utf-8-sig"))
    text = lambda x: x if isinstance(x, str) else "".join(x or [])
    language = book.get("metadata", {}).get("kernelspec", {}).get("language") or book.get("metadata", {}).get("language_info", {}).get("name", "")
    for pos, cell in enumerate(book.get("cells", [])):
        kind, source = cell.get("cell_type", ""), text(cell.get("source"))
        if kind != "code":
            yield pos, kind, source
            continue
        parts = [f"```{language}\n{source}\n```"] if source else []
        for out in cell.get("outputs", []):
            shown = text(out.get("text")) or text(out.get("data", {}).get("text/markdown")) or text(out.get("data", {}).get("text/plain"))
            if shown:
                parts.append("\n".join(f"    {line}" for line in shown.rstrip("\n").split("\n")))
        yield pos, kind, "\n\n".join(parts)


def read_epub(files: DataFrame) -> DataFrame:
    """(path, error, pos, name, markdown)."""
    rows = _reader(files, epub_chapters, "pos:int;name:string;html:string")
    return rows.select("path", "error", "pos", "name", markdown(F.col("html")).alias("markdown"))


def read_notebook(files: DataFrame) -> DataFrame:
    return _reader(files, notebook_cells, "pos:int;kind:string;markdown:string")


def whole(parts: DataFrame) -> DataFrame:
    """(path, markdown): the parts of each file in order, empty ones left out."""
    own = parts.where("error is null and trim(markdown) <> ''")
    return own.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "markdown"))), lambda s: s["markdown"]), "\n\n").alias("markdown"))


def markdown_report(title: Column, sections: Column) -> Column:
    """sections array<struct<heading, lines array<string>>> -> a Markdown document with bullet lists; sections without lines are left out."""
    part = lambda s: F.concat(F.lit("## "), s["heading"], F.lit("\n\n"), F.array_join(F.transform(s["lines"], lambda x: F.concat(F.lit("- "), x)), "\n"))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.nullif(F.array_join(F.transform(F.filter(sections, lambda s: F.size(s["lines"]) > 0), part), "\n\n"), F.lit("")))


def html_report(title: Column, sections: Column) -> Column:
    """The same as a page of headings and lists."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    part = lambda s: F.concat(F.lit("<h2>"), safe(s["heading"]), F.lit("</h2><ul>"), F.array_join(F.transform(s["lines"], lambda x: F.concat(F.lit("<li>"), safe(x), F.lit("</li>"))), ""), F.lit("</ul>"))
    body = F.array_join(F.transform(F.filter(sections, lambda s: F.size(s["lines"]) > 0), part), "")
    return F.concat(F.lit("<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>"), safe(title), F.lit("</title></head><body><h1>"), safe(title), F.lit("</h1>"), body, F.lit("</body></html>"))


def docx_bytes(paragraphs: list[tuple[str, str]]) -> bytes:
    """A document of (style name, text) paragraphs that read_docx() reads back."""
    styles = {s: f"s{k}" for k, s in enumerate(dict.fromkeys(s for s, _ in paragraphs))}
    ns = f'xmlns:w="{W[1:-1]}"'
    named = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{escape(s, {chr(34): "&quot;"})}"/></w:style>' for s, i in styles.items())
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{styles[s]}"/></w:pPr><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for s, t in paragraphs)
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{kind}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{kind}.styles+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("word/styles.xml", f"<w:styles {ns}>{named}</w:styles>")
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return buf.getvalue()


def documents_out(paragraphs: DataFrame) -> DataFrame:
    """paragraphs(name, pos, style, text) -> (name, content): a text document each, built where the rows are."""
    import pandas as pd

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("pos")
        return pd.DataFrame({"name": [key[0]], "content": [docx_bytes([(s or "Normal", t or "") for s, t in zip(rows["style"], rows["text"], strict=True)])]})

    return paragraphs.select("name", "pos", "style", "text").groupBy("name").applyInPandas(build, "name string, content binary")


def save_files(files: DataFrame, path: str) -> int:
    """Write files(name, content) under path through the session's file systems, one file in memory at a time; how many."""
    spark = files.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for row in files.toLocalIterator():
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{row.name}")
        out = target.getFileSystem(conf).create(target, True)
        try:
            out.write(bytearray(row.content))
        finally:
            out.close()
        n += 1
    return n
