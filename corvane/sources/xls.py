"""Reader of binary workbooks (BIFF8 streams in compound files), with the standard library alone."""

from __future__ import annotations

import datetime
import re
import struct
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.office import _reader, xlsx_bytes, xlsx_rows

# fixed values: signature and marks of compound files, record numbers of workbook streams, built-in date formats, error codes
SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
END_OF_CHAIN, FREE = 0xFFFFFFFE, 0xFFFFFFFF
EOF, BOUNDSHEET, SST, CONTINUE, LABELSST, NUMBER, RK, MULRK, LABEL, BOOLERR, FORMULA, STRING, DATEMODE, XF, FORMAT = 0x0A, 0x85, 0xFC, 0x3C, 0xFD, 0x203, 0x27E, 0xBD, 0x204, 0x205, 0x06, 0x207, 0x22, 0xE0, 0x41E
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


def stream(content: bytes, names: tuple[str, ...]) -> bytes:
    """The first of the named streams that a compound file holds."""
    if content[:8] != SIGNATURE:
        raise ValueError("no compound file")
    sector, mini = 1 << struct.unpack_from("<H", content, 0x1E)[0], 1 << struct.unpack_from("<H", content, 0x20)[0]
    first_dir, cutoff, first_mini_fat, difat = struct.unpack_from("<I", content, 0x30)[0], struct.unpack_from("<I", content, 0x38)[0], struct.unpack_from("<I", content, 0x3C)[0], struct.unpack_from("<I", content, 0x44)[0]

    def block(n: int) -> bytes:
        return content[(n + 1) * sector : (n + 2) * sector]

    def numbers(b: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(b) // 4}I", b[: len(b) // 4 * 4]))

    fats = [n for n in struct.unpack_from("<109I", content, 0x4C) if n < END_OF_CHAIN]
    seen = set()
    while difat < END_OF_CHAIN and difat not in seen:
        seen.add(difat)
        *more, difat = numbers(block(difat))
        fats += [n for n in more if n < END_OF_CHAIN]
    fat = [x for n in fats for x in numbers(block(n))]

    def chain(start: int, table: list[int], piece) -> bytes:
        out, seen = [], set()
        while start < len(table) and start not in seen:
            seen.add(start)
            out.append(piece(start))
            start = table[start]
        return b"".join(out)

    directory = chain(first_dir, fat, block)
    entries = {}
    for at in range(0, len(directory) - 127, 128):
        size = struct.unpack_from("<H", directory, at + 64)[0]
        name = directory[at : at + max(0, size - 2)].decode("utf-16-le", "replace")
        entries[name] = (directory[at + 66], *struct.unpack_from("<I", directory, at + 116), *struct.unpack_from("<I", directory, at + 120))
    root = next((e for e in entries.values() if e[0] == 5), (5, END_OF_CHAIN, 0))
    for name in names:
        if name in entries:
            _, start, size = entries[name]
            if size >= cutoff:
                return chain(start, fat, block)[:size]
            small = chain(root[1], fat, block)
            return chain(start, numbers(chain(first_mini_fat, fat, block)), lambda n: small[n * mini : (n + 1) * mini])[:size]
    raise ValueError(f"no stream {' or '.join(names)}")


class _Text:
    """Strings over a record and its continuations: characters that go on in the next part start with a new width there."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.at, self.k = parts, 0, 0

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            part = self.parts[self.k]
            piece = part[self.at : self.at + n]
            out += piece
            n -= len(piece)
            self.at += len(piece)
            if n:
                self.k, self.at = self.k + 1, 0
        return out

    def text(self, count_bytes: int = 2) -> str:
        n = int.from_bytes(self.take(count_bytes), "little")
        flags = self.take(1)[0]
        runs = int.from_bytes(self.take(2), "little") if flags & 8 else 0
        extra = int.from_bytes(self.take(4), "little") if flags & 4 else 0
        out, wide = "", flags & 1
        while n:
            if self.at >= len(self.parts[self.k]):
                self.k, self.at = self.k + 1, 0
                wide = self.take(1)[0] & 1
            room = (len(self.parts[self.k]) - self.at) // (2 if wide else 1)
            got = min(n, max(room, 1))
            out += self.take(got * (2 if wide else 1)).decode("utf-16-le" if wide else "latin-1", "replace")
            n -= got
        self.take(4 * runs + extra)
        return out


def _number(value: float, date: bool, base1904: bool) -> str:
    """Whole numbers without a point, dates as ISO text."""
    if date and 0 <= value < 2958466:
        day = datetime.datetime(1904, 1, 1) if base1904 else datetime.datetime(1899, 12, 30) if value >= 61 else datetime.datetime(1899, 12, 31)
        when = day + datetime.timedelta(seconds=round(value * 86400))
        return when.strftime("%Y-%m-%d %H:%M:%S") if value >= 1 else when.strftime("%H:%M:%S")
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def _rk(n: int) -> float:
    value = float(n - (1 << 32) >> 2 if n & 0x80000000 else n >> 2) if n & 2 else struct.unpack("<d", struct.pack("<Q", (n & 0xFFFFFFFC) << 32))[0]
    return value / 100 if n & 1 else value


def xls_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number from 0, cells as text); content that is a zip-based workbook after all is read as one."""
    if content[:4] == b"PK\x03\x04":
        yield from xlsx_rows(content)
        return
    book = stream(content, ("Workbook",))

    def records(at: int) -> Iterator[tuple[int, list[bytes]]]:
        """Records from `at` to the end of their part, each with its continuations."""
        while at + 4 <= len(book):
            kind, size = struct.unpack_from("<HH", book, at)
            parts = [book[at + 4 : at + 4 + size]]
            at += 4 + size
            while at + 4 <= len(book) and struct.unpack_from("<H", book, at)[0] == CONTINUE:
                size = struct.unpack_from("<H", book, at + 2)[0]
                parts.append(book[at + 4 : at + 4 + size])
                at += 4 + size
            if kind == EOF:
                return
            yield kind, parts

    sheets, strings, formats, styles, base1904 = [], [], {}, [], False
    for kind, parts in records(0):
        if kind == BOUNDSHEET and parts[0][5] == 0:  # worksheets alone
            sheets.append((struct.unpack_from("<I", parts[0])[0], _Text([parts[0][6:]]).text(1)))
        elif kind == SST:
            n = struct.unpack_from("<I", parts[0], 4)[0]
            reader = _Text([parts[0][8:], *parts[1:]])
            strings = [reader.text() for _ in range(n)]
        elif kind == FORMAT:
            formats[struct.unpack_from("<H", parts[0])[0]] = _Text([parts[0][2:]]).text()
        elif kind == XF:
            styles.append(struct.unpack_from("<H", parts[0], 2)[0])
        elif kind == DATEMODE:
            base1904 = parts[0][0] == 1

    def date(xf: int) -> bool:
        f = styles[xf] if xf < len(styles) else 0
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", formats.get(f, ""))
        return f in DATE_FORMATS or bool(re.search(r"[ymdhs]", code, re.I)) and "General" not in code

    for offset, name in sheets:
        cells: dict[int, dict[int, str]] = {}
        waiting = None
        for kind, parts in records(offset):
            d = parts[0]
            if kind == STRING and waiting:
                cells.setdefault(waiting[0], {})[waiting[1]] = _Text(parts).text()
                waiting = None
                continue
            if kind not in (LABELSST, NUMBER, RK, MULRK, LABEL, BOOLERR, FORMULA):
                continue
            row, col, xf = struct.unpack_from("<HHH", d)
            own = cells.setdefault(row, {})
            if kind == LABELSST:
                own[col] = strings[struct.unpack_from("<I", d, 6)[0]]
            elif kind == NUMBER:
                own[col] = _number(struct.unpack_from("<d", d, 6)[0], date(xf), base1904)
            elif kind == RK:
                own[col] = _number(_rk(struct.unpack_from("<I", d, 6)[0]), date(xf), base1904)
            elif kind == MULRK:
                for k in range((len(d) - 6) // 6):
                    xf, n = struct.unpack_from("<HI", d, 4 + 6 * k)
                    own[col + k] = _number(_rk(n), date(xf), base1904)
            elif kind == LABEL:
                own[col] = _Text([d[6:], *parts[1:]]).text()
            elif kind == BOOLERR:
                own[col] = ERRORS.get(d[6], "#N/A") if d[7] else "TRUE" if d[6] else "FALSE"
            elif d[12:14] != b"\xff\xff":
                own[col] = _number(struct.unpack_from("<d", d, 6)[0], date(xf), base1904)
            elif d[6] == 0:
                waiting = (row, col)
            elif d[6] in (1, 2):
                own[col] = ("TRUE" if d[8] else "FALSE") if d[6] == 1 else ERRORS.get(d[8], "#N/A")
        for row in sorted(cells):
            yield name, row, [cells[row].get(k) for k in range(max(cells[row]) + 1)] if cells[row] else []


def xls_bytes(sheets: dict[str, list[list[str | None]]]) -> bytes:
    """A binary workbook of text cells; null cells are left out."""
    def text(t: str) -> bytes:
        return b"\x01" + t.encode("utf-16-le")

    def record(kind: int, data: bytes = b"") -> bytes:
        return struct.pack("<HH", kind, len(data)) + data

    def bof(kind: int) -> bytes:
        return record(0x809, struct.pack("<HHHHII", 0x600, kind, 0, 0, 0, 0))

    bodies = [bof(0x10) + b"".join(record(LABEL, struct.pack("<HHHH", r, c, 0, len(v)) + text(v)) for r, row in enumerate(rows) for c, v in enumerate(row) if v is not None) + record(EOF) for rows in sheets.values()]
    names = [struct.pack("<BBB", 0, 0, len(n)) + text(n) for n in sheets]
    at = len(bof(5)) + sum(8 + len(n) for n in names) + 4
    head = bof(5)
    for n, b in zip(names, bodies, strict=True):
        head += record(BOUNDSHEET, struct.pack("<I", at) + n)
        at += len(b)
    return compound("Workbook", head + record(EOF) + b"".join(bodies))


def compound(name: str, data: bytes, sector: int = 512) -> bytes:
    """A compound file of one stream; it is filled up to the size from which streams lie in whole sectors."""
    body = data + bytes(-len(data) % sector if len(data) >= 4096 else 4096 - len(data))
    n = len(body) // sector
    per = sector // 4
    n_fat = 1
    while n_fat * per < n + 1 + n_fat:
        n_fat += 1
    if n_fat > 109:
        raise ValueError("more than a table of 109 sectors can hold")

    def entry(title: str, kind: int, child: int, start: int, size: int) -> bytes:
        name = title.encode("utf-16-le")
        return name + bytes(64 - len(name)) + struct.pack("<HBBIII", len(name) + 2 if name else 0, kind, 1, FREE, FREE, child) + bytes(36) + struct.pack("<IQ", start, size)

    directory = entry("Root Entry", 5, 1, END_OF_CHAIN, 0) + entry(name, 2, FREE, 0, len(body)) + 2 * entry("", 0, FREE, 0, 0)
    table = [*range(1, n), END_OF_CHAIN, END_OF_CHAIN, *[0xFFFFFFFD] * n_fat]
    table += [FREE] * (n_fat * per - len(table))
    fats = [n + 1 + k for k in range(n_fat)]
    head = SIGNATURE + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<9I", 0, n_fat, n, 0, 4096, END_OF_CHAIN, 0, END_OF_CHAIN, 0)
    return head + struct.pack("<109I", *fats, *[FREE] * (109 - n_fat)) + body + directory + struct.pack(f"<{len(table)}I", *table)


def read_xls(files: DataFrame) -> DataFrame:
    return _reader(files, xls_rows, "sheet:string;pos:long;cells:array<string>")


def to_xlsx(files: DataFrame) -> DataFrame:
    """files(path, content) of binary workbooks -> (path, error, content) as zip-based ones of text cells; those that are so already stay byte for byte."""

    def convert(content: bytes) -> Iterator[tuple[bytes]]:
        if content[:4] == b"PK\x03\x04":
            yield (content,)
            return
        sheets: dict[str, list] = {}
        for sheet, pos, cells in xls_rows(content):
            rows = sheets.setdefault(sheet, [])
            rows += [[]] * (pos - len(rows)) + [cells]
        yield (xlsx_bytes(sheets),)

    return _reader(files, convert, "content:binary")


def workbooks(table: DataFrame, group: str, order: list[str], write: Callable[[dict], bytes] = xlsx_bytes) -> DataFrame:
    """(name, content): a workbook of text cells for each value of `group`, built where the rows are; a header, then rows by `order`. A group is one sheet, so it must be of a size that a sheet can have."""
    import pandas as pd

    columns = [c for c in table.columns if c != group]

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [[None if v is None else str(v) for v in r] for r in pdf.sort_values(order)[columns].astype(object).itertuples(index=False)]
        return pd.DataFrame({"name": [str(key[0])], "content": [write({str(key[0])[:31]: [columns, *rows]})]})

    text = table.select(group, *[F.col(c).cast("string").alias(c) if c not in order else F.col(c) for c in columns])
    return text.groupBy(group).applyInPandas(build, "name string, content binary")
