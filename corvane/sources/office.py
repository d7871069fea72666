"""Readers of zip-based office files over binaryFile rows, with the standard library's zip and XML parsers."""

from __future__ import annotations

import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

# fixed values: namespaces of the formats
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _targets(z: zipfile.ZipFile, name: str) -> dict[str, str]:
    folder, _, base = name.rpartition("/")
    root = _xml(z, f"{folder}/_rels/{base}.rels")
    return {} if root is None else {r.get("Id", ""): r.get("Target", "") for r in root.iter(f"{REL}Relationship")}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return max(n - 1, 0)


def xlsx_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number from 0, cells as text)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = _xml(z, "xl/sharedStrings.xml")
        strings = [] if shared is None else ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in shared.iter(f"{S}si")]
        rels = _targets(z, "xl/workbook.xml")
        book = _xml(z, "xl/workbook.xml")
        for sheet in book.iter(f"{S}sheet"):
            target = rels.get(sheet.get(f"{R}id", ""), "")
            data = _xml(z, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
            for at, row in enumerate(data.iter(f"{S}row") if data is not None else []):
                cells: list[str | None] = []
                for c in row.iter(f"{S}c"):
                    k = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [None] * (k + 1 - len(cells))
                    v = c.find(f"{S}v")
                    if c.get("t") == "s" and v is not None:
                        cells[k] = strings[int(v.text)]
                    elif c.get("t") == "inlineStr":
                        cells[k] = "".join(t.text or "" for t in c.iter(f"{S}t"))
                    elif v is not None:
                        cells[k] = v.text
                yield sheet.get("name", ""), int(row.get("r", at + 1)) - 1, cells


def docx_paragraphs(content: bytes) -> Iterator[tuple[int, str, str, int, bool, str]]:
    """(pos, text, style name, heading level, in a table, runs as text@size@bold joined by tabs)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        styles = _xml(z, "word/styles.xml")
        names = {} if styles is None else {s.get(f"{W}styleId", ""): (s.find(f"{W}name").get(f"{W}val", "") if s.find(f"{W}name") is not None else "") for s in styles.iter(f"{W}style")}
        body = _xml(z, "word/document.xml")
        inside = {id(p) for t in body.iter(f"{W}tbl") for p in t.iter(f"{W}p")}
        for pos, p in enumerate(body.iter(f"{W}p")):
            style = p.find(f"{W}pPr/{W}pStyle")
            name = names.get(style.get(f"{W}val", ""), style.get(f"{W}val", "")) if style is not None else "Normal"
            level = re.fullmatch(r"[Hh]eading ([1-9])", name)
            runs = []
            for r in p.iter(f"{W}r"):
                size, bold = r.find(f"{W}rPr/{W}sz"), r.find(f"{W}rPr/{W}b")
                half = size.get(f"{W}val") if size is not None else None
                runs.append(f"{''.join(t.text or '' for t in r.iter(f'{W}t'))}@{float(half) / 2 if half else ''}@{int(bold is not None and bold.get(f'{W}val', '1') not in ('0', 'false'))}")
            text = "".join(t.text or "" for t in p.iter() if t.tag in (f"{W}t", f"{M}t"))
            yield pos, text, name, int(level[1]) if level else 0, id(p) in inside, "\t".join(runs)


def pptx_shapes(content: bytes) -> Iterator[tuple[int, int, str, bool, str, int, int]]:
    """(slide from 1, pos, kind text/table/picture/chart, is title, text, left, top in EMU); groups are flattened."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        rels = _targets(z, "ppt/presentation.xml")
        show = _xml(z, "ppt/presentation.xml")
        for n, sid in enumerate(show.iter(f"{P}sldId"), 1):
            slide = _xml(z, "ppt/" + rels[sid.get(f"{R}id", "")].lstrip("/").removeprefix("ppt/"))
            pos = 0
            for e in slide.iter():
                if e.tag not in (f"{P}sp", f"{P}graphicFrame", f"{P}pic"):
                    continue
                off = next(e.iter(f"{A}off"), None)
                left, top = (int(off.get("x", 0)), int(off.get("y", 0))) if off is not None else (0, 0)
                ph = next(e.iter(f"{P}ph"), None)
                title = ph is not None and ph.get("type") in ("title", "ctrTitle")
                lines = ["".join(t.text or "" for t in p.iter(f"{A}t")) for p in e.iter(f"{A}p")]
                kind = "picture" if e.tag == f"{P}pic" else "text" if e.tag == f"{P}sp" else "table" if next(e.iter(f"{A}tbl"), None) is not None else "chart"
                if kind == "table":
                    lines = ["|".join("".join(t.text or "" for t in c.iter(f"{A}t")) for c in r.iter(f"{A}tc")) for r in e.iter(f"{A}tr")]
                yield n, pos, kind, title, "\n".join(x for x in lines if x), left, top
                pos += 1


def _reader(files: DataFrame, parse: Callable, columns: str) -> DataFrame:
    """files(path, content) -> rows with path and error; a file that cannot be parsed gives one row with its error."""
    import pandas as pd

    names = ["path", "error", *[c.split(":")[0] for c in columns.split(";")]]
    schema = "path string, error string, " + ", ".join(f"`{c.split(':')[0]}` {c.split(':')[1]}" for c in columns.split(";"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, None, *r) for r in list(parse(bytes(content)))]
                except (zipfile.BadZipFile, ET.ParseError, zlib.error, struct.error, LookupError, AttributeError, ValueError, TypeError, RuntimeError) as e:
                    rows.append((path, f"{type(e).__name__}: {e}", *[None] * (len(names) - 2)))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, schema)


def read_xlsx(files: DataFrame) -> DataFrame:
    return _reader(files, xlsx_rows, "sheet:string;pos:long;cells:array<string>")


def read_docx(files: DataFrame) -> DataFrame:
    return _reader(files, docx_paragraphs, "pos:long;text:string;style:string;level:int;in_table:boolean;runs:string")


def read_pptx(files: DataFrame) -> DataFrame:
    return _reader(files, pptx_shapes, "slide:int;pos:int;kind:string;is_title:boolean;text:string;left:long;top:long")


def xlsx_bytes(sheets: dict[str, list[list[str | None]]]) -> bytes:
    """A workbook of text cells; null cells are left out."""
    from xml.sax.saxutils import escape, quoteattr

    def letters(k: int) -> str:
        out = ""
        k += 1
        while k:
            k, r = divmod(k - 1, 26)
            out = chr(65 + r) + out
        return out

    ns, rns = S[1:-1], R[1:-1]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{REL[1:-1]}"><Relationship Id="r1" Type="{rns}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rns}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{REL[1:-1]}">' + "".join(f'<Relationship Id="r{i}" Type="{rns}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{a + 1}">' + "".join(f'<c r="{letters(k)}{a + 1}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for k, v in enumerate(row) if v is not None) + "</row>" for a, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')
    return buf.getvalue()


def sheet_table(rows: DataFrame, sheet: str, header_pos: int = 0) -> DataFrame:
    """One sheet of read_xlsx rows as an all-text table, with the row at header_pos as names; one small job finds them."""
    from pyspark.sql import functions as F

    own = rows.where((F.col("sheet") == sheet) & (F.col("pos") >= header_pos))
    names = own.where(F.col("pos") == header_pos).select("cells").first()
    names = [n if n else f"Unnamed: {k}" for k, n in enumerate(names.cells if names else [])]
    return own.where(F.col("pos") > header_pos).select("pos", *[F.get("cells", F.lit(k)).alias(n) for k, n in enumerate(names)])
