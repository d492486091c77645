import datetime as dt
import random
import struct

import pytest

from folium.sinks import writers as W
from folium.sources import files as S
from folium.streaming import ingest


@pytest.mark.parametrize("ends", ["\n", "\r\n", "\r"])
def test_values_survive_a_round_trip(ends):
    """Fields as RFC 4180 writes them, from a generator, with every kind of line end."""
    rnd = random.Random(ends)
    field = lambda: "".join(rnd.choice('kö7 ,;"\t') for _ in range(rnd.randint(0, 6)))
    rows = [[field() for _ in range(rnd.randint(2, 5))] for _ in range(200)]
    quoted = lambda x: '"' + x.replace('"', '""') + '"' if set(x) & set('," ') or rnd.random() < 0.2 else x
    assert list(S.csv_rows(ends.join(",".join(map(quoted, r)) for r in rows) + ends)) == rows


def test_fields_that_are_not_quoted_are_kept():
    got = {line: next(S.csv_rows(line)) for line in ('north"east,2', '"half" open,2', '"never closed,2', ' "spaced" ,2', '"",2', "  plain  ,2", '"a""b"c,2')}
    assert [r[0] for r in got.values()] == ['north"east', '"half" open', '"never closed', "spaced", "", "  plain  ", '"a""b"c']
    assert {r[1] for r in got.values()} == {"2"}
    assert list(S.csv_rows("")) == [] and list(S.csv_rows("k,")) == [["k", ""]] and list(S.csv_rows("k\n\nm")) == [["k"], [""], ["m"]]
    assert list(S.csv_rows('"two\nlines";z', ";")) == [["two\nlines", "z"]]
    wide = ",".join(map(str, range(20_000)))
    assert len(next(S.csv_rows(wide))) == 20_000


@pytest.mark.parametrize("name", ["utf-8", "utf-16-le", "utf-16-be", "windows-1251", "koi8-r", "windows-1252"])
def test_encodings(name):
    text = {"windows-1252": "Größe und Maß, café crème", "windows-1251": "Привет, это простой текст", "koi8-r": "Привет, это простой текст"}.get(name, "plain text with é and more words")
    assert S.decode(text.encode(name)) == (text, name)


def dbf():
    fields = [(b"NAME", b"C", 10), (b"PRICE", b"N", 7), (b"SOLD", b"D", 8), (b"ACTIVE", b"L", 1)]
    head = struct.pack("<BBBBIHH", 3, 24, 1, 1, 3, 32 + 32 * len(fields) + 1, 27) + bytes(20)
    for n, k, w in fields:
        head += n.ljust(11, b"\0") + k + bytes(4) + bytes([w, 0]) + bytes(14)
    row = lambda flag, *c: flag + b"".join(x.ljust(w) if i != 1 else x.rjust(w) for i, (x, (_, _, w)) in enumerate(zip(c, fields)))
    return head + b"\r" + row(b" ", b"Widget", b"12.50", b"20040305", b"T") + row(b"*", b"Gone", b"1", b"20000101", b"T") + row(b" ", b"Gadget", b"3.25", b"19991231", b"F")


def test_dbf():
    cells = list(S.dbf_cells(dbf()))
    assert [c[4] for c in cells if c[1] == 0] == ["NAME", "PRICE", "SOLD", "ACTIVE"]
    assert [c[3:] for c in cells if c[1] == 1] == [("text", "Widget", None), ("number", "12.50", 12.5), ("date", "2004-03-05", float((dt.date(2004, 3, 5) - dt.date(1899, 12, 30)).days)), ("boolean", "TRUE", None)]
    assert [c[4] for c in cells if c[1] == 2] == ["Gadget", "3.25", "1999-12-31", "FALSE"] and max(c[1] for c in cells) == 2


def test_sylk_and_dif():
    sylk = 'ID;PWXL\nC;Y1;X1;K"Item;;name"\nC;X2;K"Total"\nC;Y2;X1;K0.25\nC;X2;KTRUE\nE\n'
    assert [c[1:] for c in S.sylk_cells(sylk.encode())] == [(0, 0, "text", "Item;name", None), (0, 1, "text", "Total", None), (1, 0, "number", "0.25", 0.25), (1, 1, "boolean", "TRUE", None)]
    dif = 'TABLE\n0,1\n"x"\nVECTORS\n0,2\n""\nDATA\n0,0\n""\n-1,0\nBOT\n1,0\n"Name"\n1,0\n"Count"\n-1,0\nBOT\n1,0\n"Apples"\n0,12\nV\n-1,0\nEOD\n'
    assert [c[1:] for c in S.dif_cells(dif.encode())] == [(0, 0, "text", "Name", None), (0, 1, "text", "Count", None), (1, 0, "text", "Apples", None), (1, 1, "number", "12", 12.0)]


def test_workbook_round_trip(spark, tmp_path):
    rows = [("d", 0, 0, "Region", None), ("d", 0, 1, "Units", None), ("d", 1, 0, "North <&>", None), ("d", 1, 27, None, 1250.5), ("d", 2, 0, "Region", None)]
    got = W.workbooks(spark.createDataFrame(rows, "doc string, row int, col int, text string, number double")).collect()
    raw = bytes(got[0].content)
    assert [(r, c, t, n) for _, r, c, _, t, n in S.xlsx_cells(raw)] == [(0, 0, "Region", None), (0, 1, "Units", None), (1, 0, "North <&>", None), (1, 27, "1250.5", 1250.5), (2, 0, "Region", None)]
    (tmp_path / "a.xlsx").write_bytes(raw)
    (tmp_path / "b.xlsx").write_bytes(b"PK nothing")
    (tmp_path / "~$a.xlsx").write_bytes(b"lock")
    cells = S.read_grid(spark, str(tmp_path), "xlsx").collect()
    assert sum(c.error is None for c in cells) == 5 and sum(c.error is not None for c in cells) == 1
    assert [r.k for r in S.scan(spark, str(tmp_path)).select(S.kind(S.F.col("content")).alias("k")).collect()].count("zip") == 1


def test_html():
    page = "<html><head><title>x</title></head><body><h1>A&amp;B</h1><p>one  <b>two</b><br>three <q>four</q></p><script>no</script><ul><li>i</li></ul></body></html>"
    assert S.html_text(page) == "A&B\none two\nthree “four”\ni"
    table = "<table><tr><th colspan=2>H</th><th rowspan=2>V</th></tr><tr><td>a</td><td>b</td></tr></table>"
    assert list(S.html_tables(table)) == [(0, 0, 0, 1, 2, True, "H"), (0, 0, 2, 2, 1, True, "V"), (0, 1, 0, 1, 1, False, "a"), (0, 1, 1, 1, 1, False, "b")]


def test_sinks(spark):
    cells = spark.createDataFrame([("s", 0, 0, "Region"), ("s", 0, 2, 'Say "hi", then\n'), ("s", 1, 0, "=X()"), ("s", 1, 1, "-1,250.5"), ("s", 1, 2, "-")], "doc string, row int, col int, text string")
    assert W.csv(cells).first().value == 'Region,,"Say ""hi"", then\n"\r\n\'=X(),"-1,250.5",-\r\n'
    blocks = spark.createDataFrame([("d", 0, "heading", 2, "Title #"), ("d", 1, "text", 0, "&copy; *x* a|b <i>"), ("d", 2, "item", 2, "entry"), ("d", 3, "code", 0, "a ``` b"), ("d", 4, "text", 0, "# not a heading")], "doc string, place int, kind string, level int, text string")
    assert W.markdown(blocks).first().value == "## Title \\#\n\n&amp;copy; \\*x\\* a\\|b &lt;i>\n\n  - entry\n\n````\na ``` b\n````\n\n\\# not a heading"
    assert W.plain_text(blocks).first().value.startswith("Title #\n&copy;")
    assert '{"type":"item","level":2,"text":"entry"}' in W.json_documents(blocks).first().value
    assert "<h2>Title #</h2>" in W.html(blocks).first().value
    assert [r.chapter for r in W.chapters(blocks.withColumn("level", W.F.lit(1))).orderBy("place").collect()] == [0, 0, 0, 0, 0]


def test_json_model(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"title": "T", "new": 1, "body": [{"type": "paragraph", "text": "x"}, {"type": "heading", "style": "Heading1", "text": "y"}]}')
    (tmp_path / "b.json").write_text("{broken")
    rows = S.json_model(S.scan(spark, str(tmp_path))).collect()
    assert sorted((r.title or "", r.text or "", r.error or "") for r in rows) == [("", "", "no body"), ("T", "x", ""), ("T", "y", "")]


def test_stream(spark, tmp_path):
    place = tmp_path / "in"
    place.mkdir()
    (place / "a.csv").write_text("x,y\n1,2\n")
    for name, more in (("", 4), ("b.csv", 6)):
        if name:
            (place / name).write_text("only,two\n")
        ingest.drain(ingest.watch_grid(spark, str(place), "csv"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
        assert spark.read.parquet(f"{tmp_path}/out").count() == more
    lines = ingest.watch_text(spark, str(place))
    ingest.drain(lines, f"{tmp_path}/lines", f"{tmp_path}/state2").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/lines").where("text = '1,2'").count() == 1


def test_markup_documents():
    sml = '<?xml version="1.0"?><Workbook xmlns="urn:s" xmlns:ss="urn:s"><Worksheet><Table><Row ss:Index="2"><Cell><Data ss:Type="String">a</Data></Cell><Cell ss:Index="4"><Data ss:Type="Number">1.5</Data></Cell></Row></Table></Worksheet></Workbook>'
    assert list(S.sml_cells(sml.encode())) == [(0, 1, 0, "text", "a", None), (0, 1, 3, "number", "1.5", 1.5)]
    fb2 = "<FictionBook><description/><body><section><title><p>T</p></title><p>one <b>two</b></p><section><p>deep</p></section></section></body></FictionBook>"
    assert list(S.fb2_blocks(fb2.encode())) == [(0, "heading", 1, "T"), (1, "paragraph", 1, "one two"), (2, "paragraph", 2, "deep")]


def zipped(**parts):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_x", ".x").replace("_o", ".o"), text)
    return out.getvalue()


def test_packages():
    docx = zipped(word__document_xml='<w:document xmlns:w="urn:w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert list(S.docx_blocks(docx)) == [(0, "paragraph", "Heading1", "Title"), (1, "row", None, "a\tb")]
    ods = zipped(content_xml='<o:d xmlns:o="urn:o" xmlns:t="urn:t"><t:table><t:table-row t:number-rows-repeated="2"><t:table-cell o:value-type="float" o:value="2.5"><t:p>2.5</t:p></t:table-cell><t:table-cell t:number-columns-repeated="3"/><t:table-cell o:value-type="string"><t:p>x</t:p></t:table-cell></t:table-row></t:table></o:d>')
    assert list(S.ods_cells(ods)) == [(0, 0, 0, "number", "2.5", 2.5), (0, 0, 4, "text", "x", None), (0, 1, 0, "number", "2.5", 2.5), (0, 1, 4, "text", "x", None)]
    epub = zipped(**{"META-INF__container_xml": '<c><rootfile full-path="b/p.opf"/></c>', "b__p_opf": '<p><item id="i" href="one.xhtml"/><itemref idref="i"/></p>', "b__one_xhtml": "<body><p>Hello</p></body>"})
    assert list(S.epub_spine(epub)) == [(0, "b/one.xhtml", "Hello")]


def test_rich_text():
    page = rb"{\rtf1\ansi{\fonttbl{\f0\fcharset0 A;}{\f3\fcharset204 C;}}{\stylesheet{\s0 Normal;}{\s2\b Big;}{\*\cs10 Em;}}{\*\generator x;}\pard\s2 Caf\'e9 {\f3\'c4\'e0}\u-10179\'3f\u-8704\'3f\uc2\u26085ab!\par" b"\r\n" rb"\pard\plain {\v hidden}{\deleted old}{\field{\*\fldinst HYPERLINK x}{\fldrslt link}}\line two{\pict\bin3 }}}}\par\trowd\intbl one\par more\cell{\b two}\cell\row\pard end}"
    assert list(S.rtf_blocks(page)) == [(0, "paragraph", "Big", "Café Да😀日!"), (1, "paragraph", None, "link\ntwo"), (2, "row", None, "one more\ttwo"), (3, "paragraph", None, "end")]
    assert list(S.rtf_blocks(b"{\\rtf1}")) == []


def test_rich_text_files(spark):
    files = spark.createDataFrame([("a", bytearray(b"{\\rtf1 x\\par}")), ("b", bytearray(b"PK")), ("c", bytearray(b"{\\rtf1 open"))], "path string, content binary")
    assert sorted((r.path, r.text or "", r.error or "") for r in S.read_blocks(files, S.rtf_blocks).collect()) == [("a", "x", ""), ("b", "", "not rich text"), ("c", "open", "")]
