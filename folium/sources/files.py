"""Readers of small document and table files, as Spark tables of rows.

Every reader takes a folder or pattern and reads with Spark's binaryFile source, so any store will do; a file is parsed by
the task that reads it. Rows carry the file's path. What cannot be parsed gives a row with `error` and nothing else.
"""

from __future__ import annotations

import codecs
import datetime as dt
import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "path string, sheet int, row int, col int, kind string, text string, number double, error string"
MAX_COLUMNS = 16_384
Cell = tuple[int, int, int, str, str | None, float | None]


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length and content of the files below a folder, without lock files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.where(~F.element_at(F.split("path", "/"), -1).rlike(r"^(~\$|[.]~lock[.])")).select("path", "length", "content")


def kind(content: Column) -> Column:
    """What a file is, by its first bytes."""
    head = F.hex(F.substring(content, 1, 8))
    low = F.lower(F.decode(F.substring(content, 1, 64), "ISO-8859-1"))
    return (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("D0CF11E0A1B11AE1"), "ole").when(head.startswith("7B5C727466"), "rtf")
        .when(low.startswith("id;"), "sylk").when(low.startswith("table"), "dif").when(low.rlike(r"^\s*<(!doctype html|html)"), "html").when(low.rlike(r"^\s*<[?]xml"), "xml")
        .when(low.rlike(r"^\s*[{\[]"), "json").otherwise("text")
    )


def read_cells(files: DataFrame, parse: Callable[[bytes], Iterator[Cell]]) -> DataFrame:
    """Cells of all files by a parser that gives (sheet, row, col, kind, text, number)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in CELLS.split(", ")]
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                rows = []
                try:
                    for sheet, row, col, what, text, number in parse(bytes(content)):
                        rows.append((path, sheet, row, col, what, text, number, None))
                        if len(rows) == 50_000:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                except (ValueError, KeyError, struct.error, zipfile.BadZipFile, ElementTree.ParseError, IndexError) as e:
                    rows = [*rows, (path, None, None, None, None, None, None, str(e)[:200])]
                yield pd.DataFrame(rows, columns=columns).astype({"sheet": "Int32", "row": "Int32", "col": "Int32"})

    return files.select("path", "content").mapInPandas(run, CELLS)


# text


def read_blocks(files: DataFrame, parse: Callable[[bytes], Iterator[tuple[int, str, str | None, str]]]) -> DataFrame:
    """Blocks of all files by a parser that gives (place, kind, style, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                try:
                    rows += [(path, *b, None) for b in parse(bytes(content))]
                except (ValueError, KeyError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((path, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "place", "kind", "style", "text", "error"]).astype({"place": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, place int, kind string, style string, text string, error string")


def decode(raw: bytes) -> tuple[str, str]:
    """Text and encoding: a byte order mark, else UTF-16 by its zero bytes, else strict UTF-8, else a vote of old code pages."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(name, "replace"), name
    head = raw[:4096]
    if len(head) >= 4:
        even, odd = head[::2].count(0), head[1::2].count(0)
        if odd * 3 > len(head) and even * 10 < odd:
            return raw.decode("utf-16-le", "replace"), "utf-16-le"
        if even * 3 > len(head) and odd * 10 < even:
            return raw.decode("utf-16-be", "replace"), "utf-16-be"
    try:
        return raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        pass

    def cyrillic(name: str) -> int:
        """Small letters are frequent, a capital after a small letter is not."""
        text = raw.decode(name, "replace")
        small = sum("а" <= c <= "я" for c in text)
        return small - 3 * sum(a.islower() and b.isupper() for a, b in zip(text, text[1:]))

    high = sum(b >= 0xC0 for b in raw)
    if high * 3 > sum(chr(b).isalpha() for b in raw):
        best = max(("windows-1251", "koi8-r"), key=cyrillic)
        return raw.decode(best, "replace"), best
    return raw.decode("windows-1252", "replace"), "windows-1252"


def csv_rows(text: str, mark: str = ",") -> Iterator[list[str]]:
    """Rows of separated values. A field is quoted if, but for spaces at its ends, it is a quote, anything with quotes doubled,
    and a quote; every other field is kept as it is written, with its quotes."""
    stops = re.compile(f"[{re.escape(mark)}\r\n]")
    i, n = 0, len(text)
    while i < n:
        row: list[str] = []
        while True:
            lead = i
            while lead < n and text[lead] == " ":
                lead += 1
            end = _closing(text, lead) if lead < n and text[lead] == '"' else -1
            after = end + 1
            while 0 <= end and after < n and text[after] == " ":
                after += 1
            if end >= 0 and (after == n or stops.match(text, after)):
                row.append(text[lead + 1 : end].replace('""', '"'))
                stop = after
            else:
                found = stops.search(text, i)
                stop = found.start() if found else n
                row.append(text[i:stop])
            i = stop
            if i < n and text[i] == mark:
                i += 1
                if i == n:
                    row.append("")
                    break
                continue
            break
        if text[i : i + 2] == "\r\n":
            i += 2
        elif i < n and text[i] in "\r\n":
            i += 1
        yield row


def _closing(text: str, start: int) -> int:
    i = start + 1
    while (i := text.find('"', i)) >= 0:
        if text[i + 1 : i + 2] != '"':
            return i
        i += 2
    return -1


def csv_cells(raw: bytes) -> Iterator[Cell]:
    text, _ = decode(raw)
    head = text[:10_000].split("\n", 1)[0]
    mark = max(",;\t", key=head.count)
    for r, row in enumerate(csv_rows(text, mark)):
        for c, cell in enumerate(row):
            yield 0, r, c, "text", cell, None


def text_pages(raw: bytes) -> Iterator[tuple[int, int, str]]:
    """(page, line, text): a form feed starts a page, tabs stay, other control characters go."""
    text, _ = decode(raw)
    for p, page in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").split("\f")):
        for i, line in enumerate(page.split("\n")):
            yield p, i, "".join(c for c in line if c == "\t" or not (ord(c) < 32 or 127 <= ord(c) < 160 or ord(c) in (0xFFFE, 0xFFFF)))


# grids

#: Day 0 of spreadsheets.
DAY_ZERO = dt.date(1899, 12, 30)
# Code page by the language driver byte of dBASE files.
CODE_PAGES = {0x01: "cp437", 0x02: "cp850", 0x03: "cp1252", 0x26: "cp866", 0x64: "cp852", 0x65: "cp866", 0xC8: "cp1250", 0xC9: "cp1251", 0xCA: "cp1254", 0xCB: "cp1253"}


def dbf_cells(raw: bytes) -> Iterator[Cell]:
    """dBASE: row 0 holds the names; deleted records are left out."""
    count, head, size = struct.unpack_from("<IHH", raw, 4)
    page = CODE_PAGES.get(raw[29], "cp1252")
    fields, at = [], 32
    while at + 32 <= head and raw[at] != 0x0D:
        fields.append((raw[at : at + 11].split(b"\0")[0].decode(page), chr(raw[at + 11]), raw[at + 16]))
        at += 32
    if not fields or size < 1:
        raise ValueError("not a dBASE file")
    for c, (name, _, _) in enumerate(fields):
        yield 0, 0, c, "text", name, None
    r = 0
    for k in range(count):
        record = raw[head + k * size : head + (k + 1) * size]
        if len(record) < size or record[:1] == b"*":
            continue
        r, off = r + 1, 1
        for c, (_, kind_, width) in enumerate(fields):
            cell = record[off : off + width]
            off += width
            yield 0, r, c, *_dbf_value(kind_, cell, page)


def _dbf_value(kind_: str, cell: bytes, page: str) -> tuple[str, str | None, float | None]:
    text = cell.decode(page, "replace").strip()
    if kind_ in "NF":
        try:
            return "number", text, float(text)
        except ValueError:
            return "empty", None, None
    if kind_ == "D" and len(text) == 8 and text.isdigit():
        day = dt.date(int(text[:4]), int(text[4:6]), int(text[6:]))
        return "date", day.isoformat(), float((day - DAY_ZERO).days)
    if kind_ == "L":
        return ("boolean", "TRUE" if text in "YyTt" else "FALSE", None) if text and text in "YyTtNnFf" else ("empty", None, None)
    if kind_ == "I":
        v = struct.unpack("<i", cell)[0]
        return "number", str(v), float(v)
    if kind_ in "BO" and len(cell) == 8:
        v = struct.unpack("<d", cell)[0]
        return "number", repr(v), v
    if kind_ == "Y":
        v = struct.unpack("<q", cell)[0] / 10_000
        return "number", repr(v), v
    return ("text", text, None) if text else ("empty", None, None)


def sylk_cells(raw: bytes) -> Iterator[Cell]:
    """SYLK: C records set cells, at the row and column last named; ;; is a semicolon."""
    text, _ = decode(raw)
    if not text.startswith("ID"):
        raise ValueError("not a SYLK file")
    row = col = 0
    for line in text.splitlines():
        parts = [p.replace("\0", ";") for p in line.replace(";;", "\0").split(";")]
        if parts[0] not in ("C", "F"):
            continue
        value = None
        for p in parts[1:]:
            if p[:1] == "X":
                col = int(p[1:]) - 1
            elif p[:1] == "Y":
                row = int(p[1:]) - 1
            elif p[:1] == "K":
                value = p[1:]
        if parts[0] == "C" and value is not None:
            yield 0, row, col, *_literal(value)


def _literal(value: str) -> tuple[str, str | None, float | None]:
    if value.startswith('"'):
        return "text", value.strip('"'), None
    if value in ("TRUE", "FALSE"):
        return "boolean", value, None
    if value.startswith("#"):
        return "error", value, None
    try:
        return "number", value, float(value)
    except ValueError:
        return "text", value, None


def dif_cells(raw: bytes) -> Iterator[Cell]:
    """DIF: after DATA, pairs of lines; -1 BOT starts a row, 0 is a number or logical value, 1 a text."""
    text, _ = decode(raw)
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    if not lines or lines[0].strip().upper() != "TABLE":
        raise ValueError("not a DIF file")
    at = lines.index("DATA") + 3
    row, col = -1, 0
    while at + 1 < len(lines):
        what, _, number = lines[at].partition(",")
        note = lines[at + 1].strip()
        at += 2
        if what.strip() == "-1":
            if note.upper() == "EOD":
                return
            row, col = row + 1, 0
            continue
        if what.strip() == "1":
            yield 0, row, col, "text", note[1:-1].replace('""', '"') if note.startswith('"') else note, None
        elif note in ("TRUE", "FALSE"):
            yield 0, row, col, "boolean", note, None
        elif note in ("NA", "ERROR"):
            yield 0, row, col, "error", note, None
        else:
            yield 0, row, col, "number", number.strip(), float(number)
        col += 1


# workbooks and documents in zip files


class Package:
    """Parts of a zip file, with limits on their number, size and ratio of compression."""

    def __init__(self, raw: bytes, entries: int = 10_000, size: int = 512_000_000, ratio: int = 200) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        info = self.zip.infolist()
        if len(info) > entries or sum(i.file_size for i in info) > size or any(i.file_size > 1_000_000 and i.file_size > ratio * max(1, i.compress_size) for i in info):
            raise ValueError("the package is too large")
        self.names = {i.filename for i in info}

    def xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self.zip.read(name))


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def column_index(ref: str) -> int:
    n = 0
    for c in ref:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def xlsx_cells(raw: bytes) -> Iterator[Cell]:
    """Worksheets in the order of their numbers; shared strings are looked up; formulas give the values last shown."""
    p = Package(raw)
    shared = []
    if "xl/sharedStrings.xml" in p.names:
        for si in p.xml("xl/sharedStrings.xml"):
            shared.append("".join(t.text or "" for t in si.iter() if _tag(t) == "t"))
    sheets = sorted((n for n in p.names if n.startswith("xl/worksheets/sheet")), key=lambda n: int("".join(filter(str.isdigit, n.rpartition("/")[2])) or 0))
    if not sheets:
        raise ValueError("no worksheet")
    for s, name in enumerate(sheets):
        row = -1
        for _, e in ElementTree.iterparse(io.BytesIO(p.zip.read(name))):
            if _tag(e) != "row":
                continue
            row = int(e.get("r", row + 2)) - 1
            col = -1
            for c in e:
                col = column_index(c.get("r")) if c.get("r") else col + 1
                kind_ = c.get("t", "n")
                value = next((v.text for v in c if _tag(v) == "v"), None)
                inline = "".join(t.text or "" for t in c.iter() if _tag(t) == "t")
                if kind_ == "s" and value is not None:
                    yield s, row, col, "text", shared[int(value)], None
                elif kind_ == "inlineStr":
                    yield s, row, col, "text", inline, None
                elif value is not None:
                    if kind_ == "b":
                        yield s, row, col, "boolean", "TRUE" if value == "1" else "FALSE", None
                    elif kind_ in ("str", "e", "d"):
                        yield s, row, col, {"str": "text", "e": "error", "d": "date"}[kind_], value, None
                    else:
                        yield s, row, col, "number", value, float(value)
            e.clear()


def ods_cells(raw: bytes) -> Iterator[Cell]:
    """Sheets of an OpenDocument spreadsheet; repeated rows and cells are counted, empty ones not given."""
    body = Package(raw).xml("content.xml")
    sheets = [t for t in body.iter() if _tag(t) == "table"]
    attr = lambda e, name: next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)
    for s, sheet in enumerate(sheets):
        r = 0
        for row in (e for e in sheet.iter() if _tag(e) == "table-row"):
            times = int(attr(row, "number-rows-repeated") or 1)
            cells, c = [], 0
            for cell in row:
                if _tag(cell) not in ("table-cell", "covered-table-cell"):
                    continue
                many = int(attr(cell, "number-columns-repeated") or 1)
                text = "\n".join("".join(x.itertext()) for x in cell if _tag(x) == "p")
                kind_ = attr(cell, "value-type")
                if kind_ and _tag(cell) == "table-cell":
                    number = float(attr(cell, "value")) if attr(cell, "value") else None
                    what = {"float": "number", "percentage": "number", "currency": "number", "date": "date", "boolean": "boolean"}.get(kind_, "text")
                    cells += [(c + i, what, text, number) for i in range(min(many, MAX_COLUMNS))]
                c += many
            for k in range(times if cells else 0):
                for col, what, text, number in cells:
                    yield s, r + k, col, what, text, number
            r += times


def sml_cells(raw: bytes) -> Iterator[Cell]:
    """XML Spreadsheet 2003: rows and cells may skip ahead by an index."""
    root = ElementTree.fromstring(raw)
    attr = lambda e, name: next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)
    sheets = [e for e in root.iter() if _tag(e) == "Worksheet"]
    if not sheets:
        raise ValueError("no worksheet")
    for s, sheet in enumerate(sheets):
        r = -1
        for row in (e for e in sheet.iter() if _tag(e) == "Row"):
            r = int(attr(row, "Index")) - 1 if attr(row, "Index") else r + 1
            c = -1
            for cell in (e for e in row if _tag(e) == "Cell"):
                c = int(attr(cell, "Index")) - 1 if attr(cell, "Index") else c + 1
                data = next((e for e in cell if _tag(e) == "Data"), None)
                if data is not None:
                    text = "".join(data.itertext())
                    what = {"Number": "number", "Boolean": "boolean", "DateTime": "date", "Error": "error"}.get(attr(data, "Type") or "", "text")
                    yield s, r, c, what, text, float(text) if what == "number" else None
                c += int(attr(cell, "MergeAcross") or 0)


def fb2_blocks(raw: bytes) -> Iterator[tuple[int, str, int, str]]:
    """(place, kind, depth, text) of a FictionBook's titles and paragraphs, in reading order."""
    body = next(e for e in ElementTree.fromstring(raw) if _tag(e) == "body")
    out: list[tuple[str, int, str]] = []

    def walk(e: ElementTree.Element, depth: int, title: bool) -> None:
        for x in e:
            name = _tag(x)
            if name in ("p", "v", "subtitle"):
                out.append(("heading" if title or name == "subtitle" else "paragraph", depth, " ".join("".join(x.itertext()).split())))
            else:
                walk(x, depth + (name == "section"), name == "title")

    walk(body, 0, False)
    for i, (what, depth, text) in enumerate(out):
        yield i, what, depth, text


def docx_blocks(raw: bytes) -> Iterator[tuple[int, str, str | None, str]]:
    """(place, kind, style, text) of the body's paragraphs and table rows."""
    body = next(e for e in Package(raw).xml("word/document.xml") if _tag(e) == "body")

    def text(e: ElementTree.Element) -> str:
        return "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(_tag(x), "") for x in e.iter())

    at = 0
    for e in body:
        if _tag(e) == "p":
            style = next((v for x in e.iter() if _tag(x) == "pStyle" for k, v in x.attrib.items() if k.endswith("val")), None)
            yield at, "paragraph", style, text(e)
            at += 1
        elif _tag(e) == "tbl":
            for row in (x for x in e if _tag(x) == "tr"):
                yield at, "row", None, "\t".join(text(c) for c in row if _tag(c) == "tc")
                at += 1


def epub_spine(raw: bytes) -> Iterator[tuple[int, str, str]]:
    """(place, name, text) of a book's chapters in reading order."""
    p = Package(raw)
    root = next(x.get("full-path") for x in p.xml("META-INF/container.xml").iter() if _tag(x) == "rootfile")
    opf = p.xml(root)
    base = root.rpartition("/")[0]
    items = {x.get("id"): x.get("href") for x in opf.iter() if _tag(x) == "item"}
    for i, ref in enumerate(x.get("idref") for x in opf.iter() if _tag(x) == "itemref"):
        name = f"{base}/{items[ref]}".lstrip("/")
        yield i, name, html_text(decode(p.zip.read(name))[0])


# rich text

# Code pages of font character sets, and the characters that control words stand for.
CHARSETS = {0: "cp1252", 77: "mac_roman", 128: "cp932", 129: "cp949", 134: "gbk", 136: "big5", 161: "cp1253", 162: "cp1254", 163: "cp1258", 177: "cp1255", 178: "cp1256", 186: "cp1257", 204: "cp1251", 222: "cp874", 238: "cp1250"}
RTF_CHARACTERS = {"tab": "\t", "line": "\n", "emdash": "—", "endash": "–", "emspace": " ", "enspace": " ", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "~": "\xa0", "_": "‑", "-": "\xad", "{": "{", "}": "}", "\\": "\\"}
#: Groups whose text is not the body's.
RTF_APART = {"colortbl", "info", "pict", "fldinst", "header", "headerl", "headerr", "headerf", "footer", "footerl", "footerr", "footerf", "footnote", "annotation", "listtext", "pntext", "nonshppict", "object", "filetbl", "revtbl", "listtable", "listoverridetable", "xe", "tc", "template"}
RTF_TOKEN = re.compile(rb"\\([a-zA-Z]+)(-?[0-9]+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z])|([{}])|[\r\n\0]+|([^\\{}\r\n\0]+)", re.DOTALL)


def rtf_blocks(raw: bytes) -> Iterator[tuple[int, str, str | None, str]]:
    """(place, kind, style, text) of a rich text's paragraphs and table rows, whose cells are apart by tabs.

    Hidden and deleted text and all destinations but the body are left out; bytes are read by the font's character set.
    """
    start = raw.lstrip(b"\xef\xbb\xbf \t\r\n")
    if not start.startswith(b"{\\rtf"):
        raise ValueError("not rich text")
    page, fonts, styles = "cp1252", {}, {}
    default, font_at, style_at = 0, 0, 0
    state = {"to": "body", "font": None, "uc": 1, "hidden": False, "deleted": False, "table": False}
    stack: list[dict] = []
    text: list[str] = []
    cells: list[str] = []
    held, named, style, place, skip, starred, at, high = bytearray(), "", None, 0, 0, False, 0, ""

    def put(s: str) -> None:
        nonlocal named
        if state["to"] == "body" and not state["hidden"] and not state["deleted"]:
            text.append(s)
        elif state["to"] in ("fonts", "styles"):
            named += s
            if ";" in named:
                name = named.split(";")[0].strip()
                if state["to"] == "styles":
                    styles.setdefault(style_at, name)
                named = ""

    def flush() -> None:
        if held:
            font = state["font"] if state["font"] is not None else default
            put(bytes(held).decode(fonts.get(font, page), "replace"))
            held.clear()

    def block(kind: str, shown: str) -> tuple[int, str, str | None, str]:
        nonlocal place
        place += 1
        return place - 1, kind, styles.get(style) if kind == "paragraph" else None, shown

    while at < len(start) and (m := RTF_TOKEN.match(start, at)):
        at = m.end()
        word, number, code, mark, brace, plain = m.groups()
        if code or plain:
            data = bytes.fromhex(code.decode()) if code else plain
            gone = min(skip, len(data))
            skip -= gone
            held += data[gone:]
            continue
        if not (word or mark or brace):
            continue
        flush()
        if brace:
            skip = 0
            if brace == b"{":
                stack.append(dict(state))
                starred = False
            elif stack:
                state = stack.pop()
                if not stack:
                    break
            continue
        name = (word or mark).decode("latin-1")
        n = int(number) if number else None
        if skip and name not in ("u", "bin"):
            skip -= 1
            continue
        on = n != 0
        if name == "*":
            starred = True
            continue
        if name == "fonttbl":
            state["to"] = "fonts"
        elif name == "stylesheet":
            state["to"] = "styles"
        elif name in RTF_APART or (starred and name not in ("cs", "shppict")):
            state["to"] = "apart"
        elif name == "bin":
            at += max(0, n or 0)
        elif name == "ansicpg":
            page = _page(n)
        elif name == "deff":
            default = n or 0
        elif name == "f":
            font_at = n or 0
            if state["to"] != "fonts":
                state["font"] = n
        elif name == "fcharset" and state["to"] == "fonts" and n in CHARSETS:
            fonts[font_at] = CHARSETS[n]
        elif name == "cpg" and state["to"] == "fonts":
            fonts[font_at] = _page(n)
        elif name == "s":
            style_at = n or 0
            if state["to"] == "body":
                style = n
        elif name == "uc":
            state["uc"] = max(0, n or 0)
        elif name == "u":
            unit = (n or 0) % 65536
            if 0xD800 <= unit < 0xDC00:
                high = chr(unit)
            else:
                put((high + chr(unit)).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace"))
                high = ""
            skip = state["uc"]
        elif name == "v":
            state["hidden"] = on
        elif name == "deleted":
            state["deleted"] = on
        elif name == "plain":
            state.update(hidden=False, deleted=False, font=None)
        elif name == "pard":
            state["table"] = False
            style = None
        elif name == "intbl":
            state["table"] = on
        elif state["to"] == "body" and name in ("par", "sect", "page", "\n", "\r"):
            if state["table"]:
                text.append(" ")
            else:
                yield block("paragraph", "".join(text))
                text.clear()
        elif state["to"] == "body" and name in ("cell", "nestcell"):
            cells.append("".join(text).strip())
            text.clear()
        elif state["to"] == "body" and name in ("row", "nestrow"):
            yield block("row", "\t".join(cells))
            cells.clear()
        elif name in RTF_CHARACTERS:
            put(RTF_CHARACTERS[name])
        starred = False
    flush()
    if cells:
        yield block("row", "\t".join(cells))
    if "".join(text).strip():
        yield block("paragraph", "".join(text))


def _page(n: int | None) -> str:
    """The codec of a code page's number; Western where there is none of it."""
    try:
        return codecs.lookup({65001: "utf-8", 10000: "mac_roman", 936: "gbk", 950: "big5"}.get(n or 1252, f"cp{n or 1252}")).name
    except LookupError:
        return "cp1252"


# markup

SKIPPED = {"script", "style", "template", "noscript", "head"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "section", "article", "header", "footer", "nav", "blockquote", "pre", "main", "aside"}
VOID = {"br", "img", "wbr", "hr", "meta", "link", "input"}


class _Flow(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.tables: list[list[list[tuple[str, int, int, bool]]]] = []
        self.cell: list[str] | None = None
        self.span = (1, 1, False)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "br":
            self.put("\n")
        elif tag == "img" and a.get("alt"):
            self.put(a["alt"])
        elif tag == "q":
            self.put("“")
        elif tag in BLOCKS:
            self.put("\n")
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []
            whole = lambda v: int(v) if v and v.isdigit() and 0 < int(v) < 1000 else 1
            self.span = (whole(a.get("rowspan")), whole(a.get("colspan")), tag == "th")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "q":
            self.put("”")
        elif tag in BLOCKS:
            self.put("\n")
        elif tag in ("td", "th"):
            if self.cell is not None:
                self.tables[-1][-1].append((" ".join("".join(self.cell).split()), *self.span))
                self.cell = None
            self.put("\t")

    def handle_data(self, data):
        self.put(data if data.strip() else " ")

    def put(self, text: str) -> None:
        if not self.skip:
            self.out.append(text if text in ("\n", "\t") else " ".join(text.split(" ")).replace("\n", " "))
            if self.cell is not None:
                self.cell.append(text)


def html_text(html: str) -> str:
    """What a page shows, a line for each block, white space collapsed."""
    flow = _Flow()
    flow.feed(html or "")
    lines = [" ".join(line.split()) for line in "".join(flow.out).split("\n")]
    return "\n".join(x for x in lines if x)


def html_tables(html: str, columns: int = 63, rows: int = 20_000) -> Iterator[tuple[int, int, int, int, int, bool, str]]:
    """(table, row, col, rowspan, colspan, header, text) with spans laid out on a grid of so many columns and rows at most."""
    flow = _Flow()
    flow.feed(html or "")
    for t, table in enumerate(flow.tables):
        n = min(len(table), rows)
        free = [0] * columns  # the row from which each column is free
        for r, row in enumerate(table[:n]):
            c = 0
            for text, down, across, head in row:
                while c < columns and free[c] > r:
                    c += 1
                if c >= columns:
                    break
                down, across = min(down, n - r), min(across, columns - c)
                free[c : c + across] = [max(x, r + down) for x in free[c : c + across]]
                yield t, r, c, down, across, head, text
                c += across


def html_texts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text) of pages."""
    shown = F.pandas_udf(lambda s: s.map(html_text), "string")
    return pages.select(key, shown(F.coalesce(F.col(html), F.lit(""))).alias("text"))


def html_table_cells(pages: DataFrame, key: str, html: str) -> DataFrame:
    grid = F.pandas_udf(lambda s: s.map(lambda h: [dict(zip(("tbl", "row", "col", "rowspan", "colspan", "header", "text"), c)) for c in html_tables(h)]), "array<struct<tbl int, row int, col int, rowspan int, colspan int, header boolean, text string>>")
    return pages.select(key, F.explode(grid(F.coalesce(F.col(html), F.lit("")))).alias("c")).select(key, "c.*")


READERS = {"csv": csv_cells, "tsv": csv_cells, "dbf": dbf_cells, "slk": sylk_cells, "dif": dif_cells, "xlsx": xlsx_cells, "ods": ods_cells, "xml": sml_cells}


def read_grid(spark: SparkSession, path: str, format: str) -> DataFrame:
    """Cells of all files of a format below a folder."""
    return read_cells(scan(spark, path, f"*.{format}"), READERS[format])


def json_model(files: DataFrame) -> DataFrame:
    """Blocks of documents in JSON: unknown fields are ignored, a document that does not parse gives `error`."""
    schema = "title string, author string, body array<struct<type string, style string, text string>>"
    doc = F.from_json(F.decode("content", "UTF-8"), schema, {"mode": "PERMISSIVE"})
    rows = files.select("path", doc.alias("d"))
    return rows.select("path", "d.title", F.posexplode_outer("d.body").alias("place", "b")).select("path", "title", "place", "b.*", F.when(F.col("b").isNull(), "no body").alias("error"))
