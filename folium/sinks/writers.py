"""Documents and tables as text, Markdown, separated values, JSON and workbooks.

Blocks are rows (doc, place, kind, level, text); cells are rows (doc, row, col, text). Lines are built by expressions; only
a workbook, which is one file, is put together by the task that writes it.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import text as X


def in_order(df: DataFrame, doc: str, order: list[str], line: Column, between: str) -> DataFrame:
    """(doc, value): a document's lines in order, joined."""
    pairs = df.select(doc, F.struct(*order, line.alias("line")).alias("p")).groupBy(doc).agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return pairs.select(doc, F.array_join(F.transform("ps", lambda p: p["line"]), between).alias("value"))


def plain_text(blocks: DataFrame) -> DataFrame:
    return in_order(blocks, "doc", ["place"], F.expr(X.clean("text")), "\n")


def markdown(blocks: DataFrame) -> DataFrame:
    """Headings, list entries, code in fences longer than any run of back-ticks inside, and paragraphs; a blank line between."""
    t = F.expr(X.line_guard(X.markdown("text")))
    runs = F.regexp_extract_all("text", F.lit("(`+)"), F.lit(1))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)) + 1))
    line = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.col("level"), F.lit(6))), F.lit(" "), F.regexp_replace(F.expr(X.markdown("text")), r"(#+)$", r"\\$1")))
        .when(F.col("kind") == "item", F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- "), t))
        .when(F.col("kind") == "code", F.concat(fence, F.lit("\n"), F.col("text"), F.lit("\n"), fence))
        .otherwise(t)
    )
    return in_order(blocks, "doc", ["place"], line, "\n\n")


def csv(cells: DataFrame) -> DataFrame:
    """Rows of separated values ended by CR LF, padded to the table's width, formulas made inert, fields quoted where needed."""
    width = cells.groupBy("doc").agg((F.max("col") + 1).alias("width"))
    field = cells.withColumn("safe", F.expr(X.inert("text"))).withColumn("field", F.expr(X.csv_quote("safe")))
    rows = field.groupBy("doc", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "field"))).alias("m")).join(width, "doc")
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(""))), ",")
    return in_order(rows, "doc", ["row"], F.concat(line, F.lit("\r\n")), "")


def json_documents(blocks: DataFrame) -> DataFrame:
    body = F.sort_array(F.collect_list(F.struct("place", "kind", "level", "text")))
    return blocks.groupBy("doc").agg(body.alias("b")).select("doc", F.to_json(F.struct(F.transform("b", lambda x: F.struct(x["kind"].alias("type"), x["level"].alias("level"), x["text"].alias("text"))).alias("body"))).alias("value"))


def html(blocks: DataFrame) -> DataFrame:
    t = F.expr(X.xml("text"))
    line = F.when(F.col("kind") == "heading", F.concat(F.lit("<h"), F.col("level"), F.lit(">"), t, F.lit("</h"), F.col("level"), F.lit(">"))).when(F.col("kind") == "item", F.concat(F.lit("<li>"), t, F.lit("</li>"))).otherwise(F.concat(F.lit("<p>"), t, F.lit("</p>")))
    return in_order(blocks, "doc", ["place"], line, "\n")


def chapters(blocks: DataFrame) -> DataFrame:
    """Numbers the chapters of books: a heading of the first level starts one if anything stands before it."""
    w = Window.partitionBy("doc").orderBy("place")
    starts = (F.col("kind") == "heading") & (F.col("level") == 1) & F.lag("place").over(w).isNotNull()
    return blocks.withColumn("starts", F.when(starts, 1).otherwise(0)).withColumn("chapter", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def column_name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(rows: list[tuple[int, int, str | None, float | None]]) -> bytes:
    """One worksheet with its table of shared strings."""
    strings: dict[str, int] = {}
    lines: dict[int, list[str]] = {}
    for r, c, text, number in sorted(rows, key=lambda x: (x[0], x[1])):
        ref = f"{column_name(c)}{r + 1}"
        if number is not None and number == number:
            lines.setdefault(r, []).append(f'<c r="{ref}"><v>{number!r}</v></c>')
        elif text is not None:
            lines.setdefault(r, []).append(f'<c r="{ref}" t="s"><v>{strings.setdefault(text, len(strings))}</v></c>')
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kinds = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{kinds}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sharedStrings+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{kinds}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{kinds}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{rel}/sharedStrings" Target="sharedStrings.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>' + "".join(f'<row r="{r + 1}">{"".join(c)}</row>' for r, c in sorted(lines.items())) + "</sheetData></worksheet>",
        "xl/sharedStrings.xml": f'<sst xmlns="{main}">' + "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings) + "</sst>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def workbooks(cells: DataFrame) -> DataFrame:
    """(doc, content): a workbook for each document of cells (doc, row, col, text, number)."""

    def build(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(r), int(c), t, None if n is None or n != n else float(n)) for r, c, t, n in zip(f["row"], f["col"], f["text"], f["number"])]
        return pd.DataFrame({"doc": [key[0]], "content": [workbook(rows)]})

    doc = cells.schema["doc"].dataType.simpleString()
    return cells.groupBy("doc").applyInPandas(build, f"doc {doc}, content binary")


def write_text(documents: DataFrame, path: str) -> None:
    """One text file for each part of (doc, value), a document after another."""
    documents.select("value").write.text(path)

