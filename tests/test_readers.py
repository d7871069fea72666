"""Binary workbooks, PDF, books and notebooks, with files written here byte by byte, and sinks read back."""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib

import pytest

from corvane.sources import books as B
from corvane.sources import files as I
from corvane.sources import office as O
from corvane.sources import pdf as P
from corvane.sources import xls as X


def record(kind, data=b""):
    return struct.pack("<HH", kind, len(data)) + data


def short(text):
    wide = any(ord(c) > 255 for c in text)
    return bytes([int(wide)]) + text.encode("utf-16-le" if wide else "latin-1")


def compound(stream):
    """A compound file of one stream, in sectors of 512 bytes, or in small ones below 4096."""
    sector = 512
    pad = lambda b, n: b + bytes(-len(b) % n)
    small = len(stream) < 4096
    minis = pad(stream, 64) if small else b""
    main = pad(minis if small else stream, sector)
    n = len(main) // sector
    mini_fat = pad(struct.pack(f"<{len(minis) // 64}I", *[*range(1, len(minis) // 64), 0xFFFFFFFE]), sector) if small else b""
    entry = lambda name, kind, start, size: pad(name.encode("utf-16-le"), 64)[:64] + struct.pack("<HBBIII", 2 * len(name) + 2, kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, 1 if kind == 5 else 0xFFFFFFFF) + bytes(36) + struct.pack("<IQ", start, size)
    directory = pad(entry("Root Entry", 5, 0 if small else 0xFFFFFFFE, len(minis)) + entry("Workbook", 2, 0, len(stream)), sector)
    dir_at, mini_at = n, n + len(directory) // sector
    fat_at = mini_at + len(mini_fat) // sector
    fat = [*range(1, n), 0xFFFFFFFE, *range(dir_at + 1, mini_at), 0xFFFFFFFE, *([*range(mini_at + 1, fat_at), 0xFFFFFFFE] if small else []), 0xFFFFFFFD]
    assert len(fat) <= 128
    fat += [0xFFFFFFFF] * (128 - len(fat))
    head = X.SIGNATURE + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, dir_at, 0, 4096, mini_at if small else 0xFFFFFFFE, len(mini_fat) // sector, 0xFFFFFFFE, 0) + struct.pack("<109I", fat_at, *[0xFFFFFFFF] * 108)
    assert len(head) == 512
    return head + main + directory + mini_fat + struct.pack("<128I", *fat)


def workbook(filler=0):
    """Two sheets with each kind of cell; the shared strings go on in a second record in the middle of a string."""
    words = ["name", "Größe", "数据", "x" * 300, *[f"word {k}" for k in range(filler)]]
    strings = b"".join(struct.pack("<H", len(w)) + short(w) for w in words)
    cut = strings.index(b"xxxx") + 100
    sst = record(X.SST, struct.pack("<II", len(words), len(words)) + strings[:cut]) + record(X.CONTINUE, b"\x00" + strings[cut:])
    xfs = record(X.XF, struct.pack("<HH", 0, 0) + bytes(16)) + record(X.XF, struct.pack("<HH", 0, 14) + bytes(16)) + record(X.XF, struct.pack("<HH", 0, 170) + bytes(16))
    formats = record(X.FORMAT, struct.pack("<HH", 170, 10) + short("hh:mm \"at\""))
    bof = lambda k: record(0x809, struct.pack("<HHHHII", 0x600, k, 0, 0, 0, 0))
    at = lambda r, c, xf=0: struct.pack("<HHH", r, c, xf)
    one = bof(16) + b"".join([
        *[record(X.LABELSST, at(0, k) + struct.pack("<I", k)) for k in range(4)], record(X.NUMBER, at(1, 0) + struct.pack("<d", 2.5)), record(X.NUMBER, at(1, 1) + struct.pack("<d", 7.0)), record(X.RK, at(1, 3) + struct.pack("<I", (1234 << 2) | 3)),
        record(X.MULRK, struct.pack("<HH", 3, 1) + struct.pack("<HI", 0, (5 << 2) | 2) + struct.pack("<HI", 0, ((-5 << 2) & 0xFFFFFFFF) | 2) + struct.pack("<H", 2)), record(X.NUMBER, at(4, 0, 1) + struct.pack("<d", 45358.0)), record(X.NUMBER, at(4, 1, 2) + struct.pack("<d", 0.75)),
        record(X.BOOLERR, at(5, 0) + b"\x01\x00"), record(X.BOOLERR, at(5, 1) + b"\x07\x01"), record(X.LABEL, at(5, 2) + struct.pack("<H", 2) + short("é!")),
        record(X.FORMULA, at(6, 0) + struct.pack("<d", 0.1) + bytes(8)), record(X.FORMULA, at(6, 1) + b"\x00" + bytes(5) + b"\xff\xff" + bytes(8)), record(X.STRING, struct.pack("<H", 4) + short("text")), record(X.FORMULA, at(6, 2) + b"\x01\x00\x01" + bytes(3) + b"\xff\xff" + bytes(8)),
    ]) + record(X.EOF)
    two = bof(16) + record(X.LABELSST, at(0, 0) + struct.pack("<I", 1)) + record(X.EOF)
    sheet = lambda offset, name: record(X.BOUNDSHEET, struct.pack("<IBBB", offset, 0, 0, len(name)) + short(name))
    size = len(bof(5) + xfs + formats + sheet(0, "One") + sheet(0, "Zwei") + sst + record(X.EOF))
    return bof(5) + xfs + formats + sheet(size, "One") + sheet(size + len(one), "Zwei") + sst + record(X.EOF) + one + two


WANT = [
    ("One", 0, ["name", "Größe", "数据", "x" * 300]), ("One", 1, ["2.5", "7", None, "12.34"]), ("One", 3, [None, "5", "-5"]), ("One", 4, ["2024-03-07 00:00:00", "18:00:00"]), ("One", 5, ["TRUE", "#DIV/0!", "é!"]), ("One", 6, ["0.1", "text", "TRUE"]), ("Zwei", 0, ["Größe"]),
]


@pytest.mark.parametrize("filler", [0, 900])
def test_binary_workbooks(filler):
    assert list(X.xls_rows(compound(workbook(filler)))) == WANT


def test_binary_workbooks_become_zip_based(spark):
    there = O.xlsx_bytes({"A": [["k"], ["v"]]})
    files = spark.createDataFrame([("a.xls", bytearray(compound(workbook()))), ("b.xls", bytearray(there)), ("c.xls", bytearray(b"no workbook")), ("d.xls", bytearray(compound(workbook())[:700]))], "path string, content binary")
    out = {r.path: r for r in X.to_xlsx(files).collect()}
    assert bytes(out["b.xls"].content) == there and out["c.xls"].content is None and "compound" in out["c.xls"].error and out["d.xls"].error
    back = {(s, p): c for s, p, c in O.xlsx_rows(bytes(out["a.xls"].content)) if c}
    assert back == {(s, p): c for s, p, c in WANT}
    assert X.read_xls(files).where("path = 'a.xls'").count() == len(WANT)


def pdf(compressed):
    """Two pages: plain fonts with bold and offsets, and a composite font with a map; objects plain or in an object stream."""
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 2 beginbfchar <0001> <6570> <0002> <636e> endbfchar 1 beginbfrange <0010> <0012> <0041> endbfrange"
    first = b"BT /F1 12 Tf 1 0 0 1 72 700 Tm (Hello \\(big\\) ) Tj /F2 12 Tf [(wor) -20 (ld)] TJ 0 -20 Td /F1 10 Tf (next\\040line) Tj ET q 2 0 0 2 0 0 cm BT /F1 8 Tf 10 100 Td (scaled) ' ET Q"
    second = b"BT /F3 11 Tf 50 500 Td <000100020010> Tj [<0011> -400 <0012>] TJ ET"
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 5 0 R /F2 6 0 R /F3 7 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 10 0 R >>", 4: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 600 800] /Contents [11 0 R] >>",
        5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Times-Roman /FirstChar 32 /Widths [" + b"500 " * 95 + b"] >>", 6: b"<< /Type /Font /Subtype /Type1 /BaseFont /Times-Bold >>",
        7: b"<< /Type /Font /Subtype /Type0 /BaseFont /Song /DescendantFonts [8 0 R] /ToUnicode 12 0 R >>", 8: b"<< /Type /Font /DW 1000 /W [16 [600 600 600]] >>",
    }
    streams = {10: first, 11: second, 12: cmap}
    out = b"%PDF-1.5\n"
    for n, data in streams.items():
        body = zlib.compress(data) if compressed else data
        out += f"{n} 0 obj << /Length {len(body)} {'/Filter /FlateDecode' if compressed else ''} >>\nstream\n".encode() + body + b"\nendstream endobj\n"
    if compressed:
        joined = b" ".join(objects.values())
        offsets, at = [], 0
        for n, o in objects.items():
            offsets.append(f"{n} {at}")
            at += len(o) + 1
        head = " ".join(offsets).encode() + b" "
        body = zlib.compress(head + joined)
        out += f"20 0 obj << /Type /ObjStm /N {len(objects)} /First {len(head)} /Length {len(body)} /Filter /FlateDecode >>\nstream\n".encode() + body + b"\nendstream endobj\n"
        out += b"21 0 obj << /Type /XRef /Root 1 0 R /Length 0 >>\nstream\n\nendstream endobj\n"
    else:
        out += b"".join(f"{n} 0 obj ".encode() + o + b" endobj\n" for n, o in objects.items()) + b"trailer << /Root 1 0 R >>\n"
    return out + b"%%EOF"


@pytest.mark.parametrize("compressed", [False, True])
def test_pdf_text(compressed):
    got = [(p, b, k, t, f, s, bold) for p, b, k, t, f, s, bold, *_ in P.pdf_spans(pdf(compressed))]
    assert got == [
        (1, 1, 0, "Hello (big) ", "Times-Roman", 12.0, False), (1, 1, 1, "world", "Times-Bold", 12.0, True), (1, 1, 2, "next line", "Times-Roman", 10.0, False), (1, 2, 0, "scaled", "Times-Roman", 16.0, False),
        (2, 1, 0, "数据A", "Song", 11.0, False), (2, 1, 1, "B C", "Song", 11.0, False),
    ]
    boxes = [r[7:] for r in P.pdf_spans(pdf(compressed))]
    assert boxes[0] == (72.0, 80.0, 144.0, 92.0) and boxes[2] == (72.0, 102.0, 117.0, 112.0) and boxes[3][0] == 20.0 and boxes[4] == (50.0, 289.0, 78.6, 300.0)


def test_pdf_blocks_and_broken_files(spark):
    files = spark.createDataFrame([("a", bytearray(pdf(True))), ("b", bytearray(b"no pdf")), ("c", bytearray(pdf(True)[:200])), ("d", bytearray(b"%PDF-1.4 trailer << /Encrypt 1 0 R /Root 2 0 R >>"))], "path string, content binary")
    rows = P.read_pdf(files)
    blocks = {(r.page, r.block): (r.text, r.size, r.bold) for r in I.block_spans(rows.where("path = 'a'")).collect()}
    assert blocks[1, 1] == ("Hello (big) worldnext line", 12.0, False) and blocks[2, 1] == ("数据AB C", 11.0, False)
    errors = {r.path: r.error for r in rows.where("error is not null").collect()}
    assert set(errors) <= {"b", "c", "d"} and "no PDF" in errors["b"] and "encrypted" in errors["d"]


def epub(missing=False):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
        z.writestr("OPS/book.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="b" href="two%20b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="../one.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i.png" media-type="image/png"/><item id="x" href="gone.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="i"/><itemref idref="x"/><itemref idref="b"/><itemref idref="none"/></spine></package>')
        z.writestr("one.xhtml", "<html><head><title>T</title></head><body><h1>One</h1><p>First <b>chapter</b>.</p></body></html>")
        z.writestr("OPS/two b.xhtml", "<html><body><h2>Two</h2><ul><li>x</li><li>y</li></ul></body></html>")
    return buf.getvalue()


def test_books_and_notebooks(spark):
    book = {"metadata": {"kernelspec": {"language": "python"}}, "cells": [
        {"cell_type": "markdown", "source": ["# Title\n", "text"]}, {"cell_type": "code", "source": "print(1)", "outputs": [{"text": ["1\n", "2\n"]}, {"data": {"text/plain": "x", "image/png": "aGk="}}]}, {"cell_type": "code", "source": [], "outputs": []}, {"cell_type": "raw", "source": "raw"},
    ]}
    files = spark.createDataFrame([("a.epub", bytearray(epub())), ("b", bytearray(b"x"))], "path string, content binary")
    out = B.read_epub(files)
    assert {r.path: r.markdown for r in B.whole(out).collect()} == {"a.epub": "# One\n\nFirst **chapter**.\n\n## Two\n\n- x\n- y"}
    assert [r.name for r in out.where("error is null").orderBy("pos").collect()] == ["one.xhtml", "OPS/two b.xhtml"] and out.where("error is not null").count() == 1
    notes = B.read_notebook(spark.createDataFrame([("n", bytearray(json.dumps(book).encode())), ("bad", bytearray(b"{"))], "path string, content binary"))
    assert {r.path: r.markdown for r in B.whole(notes).collect()} == {"n": "# Title\ntext\n\n```python\nprint(1)\n```\n\n    1\n    2\n\n    x\n\nraw"}


def test_sinks_are_read_back(spark, small, tmp_path):
    nation = spark.read.parquet(f"{small}/nation.parquet").select("n_regionkey", "n_nationkey", "n_name")
    books = X.workbooks(nation, "n_regionkey", ["n_nationkey"])
    got = {(r.path, r.pos): tuple(r.cells) for r in O.read_xlsx(books.selectExpr("name as path", "content")).collect()}
    want = {(str(k), 0): ("n_nationkey", "n_name") for k in range(5)}
    for k in range(5):
        rows = sorted((r.n_nationkey, r.n_name) for r in nation.collect() if r.n_regionkey == k)
        want |= {(str(k), i): (str(a), b) for i, (a, b) in enumerate(rows, 1)}
    assert got == want
    paragraphs = spark.createDataFrame([("d", 1, "Normal", "a < b & c"), ("d", 0, "heading 1", "Title"), ("e", 0, None, None)], "name string, pos int, style string, text string")
    docs = B.documents_out(paragraphs)
    assert B.save_files(docs.withColumn("name", docs.name), str(tmp_path / "out")) == 2
    back = O.read_docx(I.binary(spark, str(tmp_path / "out"))).where("error is null").orderBy("path", "pos").collect()
    assert [(r.text, r.style, r.level) for r in back] == [("Title", "heading 1", 1), ("a < b & c", "Normal", 0), ("", "Normal", 0)]


def test_archives_and_their_errors(spark):
    from corvane.sources import archives as A

    files = spark.createDataFrame([("p", "a", "output", "x.txt", bytearray(b"1")), ("p", "b", "scratch", "y", bytearray(b"2")), ("p", "b", "input", ".z", bytearray(b"3")), ("q", "a", "summary", "é.md", bytearray(b"44"))], "project string, agent string, folder string, name string, content binary")
    out = A.archives(files)
    back = A.read_archives(out.withColumnRenamed("name", "path")).collect()
    assert {(r.project, r.name, r.bytes, bytes(r.content)) for r in back} == {("p", "a/output/x.txt", 1, b"1"), ("q", "a/summary/é.md", 2, b"44")}
    assert A.exported_files(files, "all").count() == 3 and A.exported_files(files, "outputs").count() == 2

    def packed(parts):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            for k, v in parts.items():
                z.writestr(k, v)
        return bytearray(buf.getvalue())

    odd = spark.createDataFrame([("up", packed({"p/../../etc": "x"})), ("few", packed({"p/project_manifest.json": '{"total_files": 2}', "p/a": "x"})), ("plain", packed({"a/b": "x"})), ("none", bytearray(b"zip"))], "path string, content binary")
    rows = {r.path: r for r in A.read_archives(odd).collect()}
    assert "unsafe" in rows["up"].error and "manifest" in rows["few"].error and rows["none"].error and (rows["plain"].project, rows["plain"].name) == ("project", "a/b")


def test_binary_workbooks_written_here(spark):
    big = {"Ä": [[f"cell {r} {c} ü" for c in range(8)] for r in range(2000)], "数": [[None, "x"], [], ["y"]]}
    back = {}
    for sheet, pos, cells in X.xls_rows(X.xls_bytes(big)):
        back.setdefault(sheet, {})[pos] = cells
    assert back["Ä"] == dict(enumerate(big["Ä"])) and back["数"] == {0: [None, "x"], 2: ["y"]}
    text = ["plain (text) \\ here", "é € ü", ""] * 40
    assert [t for _, _, _, t, *_ in P.pdf_spans(P.pdf_bytes([text[:60], text[60:]]))] == [t for t in text if t]
