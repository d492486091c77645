"""Queries on readers: small files are made from rows of the tables, read, and their cells held against the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.plans.base import Catalogue
from folium.sinks import writers
from folium.sources import files

catalogue = Catalogue()
add = catalogue.add

#: A supplier as two rows of two cells: titles, then name and balance in whole cents.
_CENTS = "cast(round(s_acctbal * 100) AS BIGINT)"
_WANT = f"""WITH c AS (SELECT s_suppkey::VARCHAR AS path, s_name, {_CENTS} AS cents FROM supplier)
  SELECT path, 0 AS row, 0 AS col, 'text' AS kind, 'Name' AS text, NULL::DOUBLE AS number FROM c UNION ALL SELECT path, 0, 1, 'text', 'Balance', NULL FROM c
  UNION ALL SELECT path, 1, 0, 'text', s_name, NULL FROM c UNION ALL SELECT path, 1, 1, 'number', cents::VARCHAR, cents::DOUBLE FROM c"""


def _read(supplier: DataFrame, content: str, parse: Callable[[bytes], Iterator[files.Cell]]) -> DataFrame:
    made = supplier.selectExpr("cast(s_suppkey AS STRING) AS path", f"cast({content.format(name='s_name', cents=_CENTS)} AS BINARY) AS content")
    return files.read_cells(made, parse).select("path", "row", "col", "kind", "text", "number")


@add(_WANT, "supplier")
def sylk_files(supplier: DataFrame) -> DataFrame:
    return _read(supplier, r"""concat('ID;PWXL\nC;Y1;X1;K"Name"\nC;X2;K"Balance"\nC;Y2;X1;K"', {name}, '"\nC;X2;K', {cents}, '\nE\n')""", files.sylk_cells)


@add(_WANT, "supplier")
def dif_files(supplier: DataFrame) -> DataFrame:
    return _read(supplier, r"""concat('TABLE\n0,1\n""\nDATA\n0,0\n""\n-1,0\nBOT\n1,0\n"Name"\n1,0\n"Balance"\n-1,0\nBOT\n1,0\n"', {name}, '"\n0,', {cents}, '\nV\n-1,0\nEOD\n')""", files.dif_cells)


@add(_WANT, "supplier")
def xml_spreadsheets(supplier: DataFrame) -> DataFrame:
    cell = "<Cell><Data ss:Type=\"{0}\">{1}</Data></Cell>"
    head = "<?xml version=\"1.0\"?><Workbook xmlns=\"urn:s\" xmlns:ss=\"urn:s\"><Worksheet><Table><Row>" + cell.format("String", "Name") + cell.format("String", "Balance") + "</Row><Row>"
    return _read(supplier, "concat('" + head + cell.format("String", "', {name}, '") + cell.format("Number", "', {cents}, '") + "</Row></Table></Worksheet></Workbook>')", files.sml_cells)


@add("""SELECT (o_custkey % 20)::VARCHAR AS path, row, c::INT AS col, CASE c WHEN 0 THEN o_orderpriority || ', "' || o_orderkey || '"' ELSE o_clerk || chr(10) || 'x' END AS text
  FROM (SELECT *, (row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - 1)::INT AS row FROM (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus AS o_clerk FROM orders)), generate_series(0, 1) g(c)""", "orders")
def separated_files(orders: DataFrame) -> DataFrame:
    shown = F.array(F.concat("o_orderpriority", F.lit(', "'), "o_orderkey", F.lit('"')), F.concat("o_orderstatus", F.lit("\nx")))
    cells = orders.select((F.col("o_custkey") % 20).cast("string").alias("doc"), F.col("o_orderkey").alias("row"), F.posexplode(shown).alias("col", "text"))
    made = writers.csv(cells).select(F.col("doc").alias("path"), F.col("value").cast("binary").alias("content"))
    return files.read_cells(made, files.csv_cells).select("path", "row", "col", "text")


@add("""SELECT n_nationkey::VARCHAR AS path, CASE n_nationkey % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16-le' ELSE 'utf-16-be' END AS encoding, 'Grüße aus ' || n_name AS text FROM nation""", "nation")
def encodings(nation: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Grüße aus "), "n_name")
    raw = F.when(F.col("n_nationkey") % 3 == 0, F.encode(text, "UTF-8")).when(F.col("n_nationkey") % 3 == 1, F.encode(text, "UTF-16LE")).otherwise(F.encode(text, "UTF-16BE"))
    made = nation.select(F.col("n_nationkey").cast("string").alias("path"), raw.alias("content"))

    def run(frames):
        for f in frames:
            got = [files.decode(bytes(c)) for c in f["content"]]
            yield f[["path"]].assign(encoding=[g[1] for g in got], text=[g[0] for g in got])

    return made.mapInPandas(run, "path string, encoding string, text string")


@add(r"""WITH s AS (SELECT s_suppkey::VARCHAR AS path, s_name, s_nationkey, s_suppkey FROM supplier)
  SELECT path, 0 AS place, 'paragraph' AS kind, 'heading 1' AS style, s_name AS text FROM s
  UNION ALL SELECT path, 1, 'paragraph', 'Normal', 'Привет € {' || s_nationkey || '}' || chr(9) || '—' FROM s
  UNION ALL SELECT path, 2, 'row', NULL, 'Key' || chr(9) || s_suppkey FROM s""", "supplier")
def rich_texts(supplier: DataFrame) -> DataFrame:
    head = r"{\\rtf1\\ansi\\ansicpg1252\\deff0{\\fonttbl{\\f0\\fcharset0 A;}{\\f1\\fcharset204 B;}}{\\stylesheet{\\s0 Normal;}{\\s1\\b heading 1;}}{\\info{\\title no}}"
    body = r"\\pard\\s1 ', s_name, '\\par\\pard\\plain\\s0 {\\f1 \\\'cf\\\'f0\\\'e8\\\'e2\\\'e5\\\'f2} \\u8364?{\\v no} \\{', s_nationkey, '\\}\\tab\\emdash\\par\\pard\\intbl Key\\cell ', s_suppkey, '\\cell\\row\\pard}"
    made = supplier.selectExpr("cast(s_suppkey AS STRING) AS path", f"cast(concat('{head}{body}') AS BINARY) AS content")
    return files.read_blocks(made, files.rtf_blocks).select("path", "place", "kind", "style", "text")
