"""Texts with the values they stand for, written out: readings of numbers, dates, times, markers and links held against a literal table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folium.functions import dates as D
from folium.functions import numbers as N
from folium.functions import text as X
from folium.functions.dialect import SPARK, quoted
from folium.plans.base import Catalogue

catalogue = Catalogue()

#: (text, decimal mark of the column, number)
NUMBERS = [
    ("1,234.56", "ANY", "1234.56"), ("1.234,56", "ANY", "1234.56"), ("1 234 567", "ANY", "1234567"), ("1'234.50", "ANY", "1234.5"), ("12,34,567.89", "ANY", "1234567.89"), ("42", "ANY", "42"), ("12,5", "ANY", "12.5"),
    ("(1,234)", "ANY", "-1234"), ("($1,234.56)", "ANY", "-1234.56"), ("$(1,234)", "ANY", "-1234"), ("€ 9.308,03", "ANY", "9308.03"), ("12.5%", "ANY", "0.125"), ("12,5 %", "ANY", "0.125"), ("+5.2%", "ANY", "0.052"), ("1,234.00-", "ANY", "-1234"), ("−7", "ANY", "-7"), ("–8.5", "ANY", "-8.5"),
    ("1,234", "ANY", "1234"), ("1,234", "POINT", "1234"), ("1,234", "COMMA", "1.234"), ("1.234", "ANY", "1.234"), ("1.234", "POINT", "1.234"), ("1.234", "COMMA", "1234"), ("12,5", "POINT", None), ("12.5", "COMMA", None), ("1.234.567", "POINT", "1234567"), ("1,234,567", "COMMA", "1234567"),
    ("0.123", "ANY", "0.123"), ("0.123", "COMMA", "0.123"), ("0,123", "ANY", "0.123"), ("0,123", "POINT", "0.123"), (".75", "ANY", "0.75"), (".75", "COMMA", None), (",5", "COMMA", "0.5"), ("1 234,5", "POINT", None), ("1 234,5", "COMMA", "1234.5"), ("1 234.5", "COMMA", None), ("1 234.5", "POINT", "1234.5"),
    ("₩ 1,000", "ANY", "1000"), ("CAD 5", "ANY", "5"), ("CAD5", "ANY", None), ("5 zł", "ANY", "5"), ("12 Kč", "ANY", "12"), ("Rs. 12,34,567", "ANY", "1234567"), ("NZ$-7", "ANY", "-7"), ("HK$ 3.50", "ANY", "3.5"), ("₽100", "ANY", "100"), ("100 ₽", "ANY", "100"), ("5 kr.", "ANY", "5"), ("US$1,000.5", "ANY", "1000.5"),
    ("1 234", "ANY", "1234"), ("1 234", "ANY", "1234"), ("1 234", "ANY", "1234"), ("1 234", "ANY", "1234"), ("1 234", "ANY", "1234"), ("1 234", "ANY", "1234"),
    ("02134", "ANY", None), ("007", "ANY", None), ("0123.45", "ANY", None), ("123456789012", "ANY", None), ("555-1234", "ANY", None), ("1.2.3", "ANY", None), ("192.168.0.1", "ANY", None), ("3/4", "ANY", None), ("1e5", "ANY", None), ("5-", "ANY", None), ("lot A", "ANY", None), ("1'234,5", "ANY", None),
]
#: (text, decimal mark that it proves)
PROOFS = [
    ("12.5", "POINT"), ("12,5", "COMMA"), ("1,234", None), ("1.234", None), ("1,234.5", "POINT"), ("1.234,5", "COMMA"), ("1,234,567", "POINT"), ("1.234.567", "COMMA"), ("0.123", "POINT"), ("0,123", "COMMA"), ("1 234,5", "COMMA"), ("1 234.5", "POINT"), ("1 234", None), ("1'234", "POINT"), ("12,34,567", "POINT"), ("42", None), ("x", None),
]
#: (text, order of the column, date and time, order that it proves)
DATES = [
    ("2024-01-05", "ANY", "2024-01-05 00:00:00", None), ("2024/1/5", "ANY", "2024-01-05 00:00:00", None), ("05.01.2024", "ANY", "2024-01-05 00:00:00", None), ("5 Jan 2024", "ANY", "2024-01-05 00:00:00", None), ("05-Jan-24", "ANY", "2024-01-05 00:00:00", None), ("January 5, 2024", "ANY", "2024-01-05 00:00:00", None),
    ("01/05/2024", "ANY", None, None), ("01/05/2024", "MDY", "2024-01-05 00:00:00", None), ("05/01/2024", "DMY", "2024-01-05 00:00:00", None), ("25/12/2024", "MDY", "2024-12-25 00:00:00", "DMY"), ("12/25/2024", "DMY", "2024-12-25 00:00:00", "MDY"), ("31/02/2024", "ANY", None, "DMY"), ("1899-12-31", "ANY", None, None), ("1900-02-28", "ANY", None, None), ("1900-03-01", "ANY", "1900-03-01 00:00:00", None),
    ("2024-03-05 10:20", "ANY", "2024-03-05 10:20:00", None), ("2024-03-05T10:20:30", "ANY", "2024-03-05 10:20:30", None), ("03.25.2024", "ANY", "2024-03-25 00:00:00", "MDY"), ("03.04.2024", "MDY", "2024-03-04 00:00:00", None), ("03.04.2024", "ANY", "2024-04-03 00:00:00", None), ("Mar 2024", "ANY", "2024-03-01 00:00:00", None), ("3. Mar 2024", "ANY", "2024-03-03 00:00:00", None),
    ("March 3 2024", "ANY", "2024-03-03 00:00:00", None), ("3 Sept. 2024", "ANY", "2024-09-03 00:00:00", None), ("3 sep 2024", "ANY", "2024-09-03 00:00:00", None), ("SEPTEMBER 2024", "ANY", "2024-09-01 00:00:00", None), ("2024/3-5", "ANY", None, None), ("3 Mar-2024", "ANY", None, None), ("5/6/24 7:08 p.m.", "DMY", "2024-06-05 19:08:00", None), ("5/6/24 12:08 am", "MDY", "2024-05-06 00:08:00", None), ("5/6/24 13:08 pm", "MDY", None, None),
    ("5/6/24 24:00", "MDY", None, None), ("3 Mar 2024 10:00", "ANY", None, None), ("13/13/2024", "DMY", None, None), ("2024-02-30", "ANY", None, None), ("2024-02-29", "ANY", "2024-02-29 00:00:00", None), ("2023-02-29", "ANY", None, None), ("1 May 29", "ANY", "2029-05-01 00:00:00", None), ("1 May 30", "ANY", "1930-05-01 00:00:00", None), ("03/03/2024", "ANY", "2024-03-03 00:00:00", None), ("on F", "ANY", None, None), ("", "ANY", None, None),
]
#: (text, seconds of the day)
CLOCKS = [("2:30 PM", 52200), ("14:30", 52200), ("14:30:59", 52259), ("25:00", None), ("12:15 am", 900), ("12:15 pm", 44100), ("2:30 p.m.", 52200), ("0:10 pm", None), ("9 am", None), ("7:60", None), ("23:59:60", None), ("0:00", 0)]
#: (word, kind, value if Roman)
MARKERS = [("12.", "decimal", None), ("(b)", "letter", None), ("IV.", "roman", 4), ("xlii)", "roman", 42), ("MCMXCIV.", "roman", 1994), ("i.", "roman", 1), ("hello", None, None), ("12", None, None), ("0.", None, None), ("(a]", None, None), ("iiii.", None, None), ("•", "bullet", None), ("-", "bullet", None)]
#: (text, link that may be kept)
LINKS = [("  https://example.com/a b?q=1#top ", "https://example.com/a%20b?q=1#top"), ("javascript:x", None), ("mailto:a@b.c", "mailto:a@b.c"), ("file:///x", None), ("FTP://h/x", "FTP://h/x"), ("//h/x", None), ("http://", None), ("data:text/html,x", None)]
#: (text, cell that a spreadsheet does not run)
INERT = [("=HYPERLINK(1)", "'=HYPERLINK(1)"), ("-cmd", "'-cmd"), ("-1,250.5", "-1,250.5"), ("-", "-"), ("@x", "'@x"), ("+12%", "+12%"), ("+a", "'+a"), ("\t=x", "'\t=x"), ("plain", "plain")]


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    return quoted(x) if isinstance(x, str) else str(x)


def case(name: str, rows: list[tuple], given: str, steps: list[list[str]], want: str) -> None:
    """A query of Spark steps over the given columns of rows; the SQL states rows as they are, with the last step's columns as `want` names and casts them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        names = [c.split(" ")[0] for c in given.split(", ")]
        df = spark.createDataFrame([(i, *r[: len(names)]) for i, r in enumerate(rows)], f"place int, {given}")
        for step in steps:
            df = df.selectExpr("*", *step)
        return df.selectExpr("place", *names, *[c.rpartition(" AS ")[2] for c in steps[-1]])

    values = ", ".join(f"({i}, " + ", ".join(map(_literal, r)) + ")" for i, r in enumerate(rows))
    columns = ", ".join(["place", *(f"c{i}" for i in range(len(rows[0])))])
    catalogue.queries[name] = run
    catalogue.oracle[name] = f"SELECT place::INT AS place, {want} FROM (VALUES {values}) v({columns})"


_READ = [[f"{N.clean('t')} AS c"], [f"{N.bare('c')} AS b", f"{N.negative('c')} AS neg"], [f"CASE WHEN NOT {N.is_code('b')} THEN {N.shape('b')} END AS kind"]]
case("number_cases", NUMBERS, "t string, mark string", [*_READ, [f"{N.value('b', 'kind', 'mark')} AS v"], ["round(CASE WHEN neg THEN -v ELSE v END / CASE WHEN c RLIKE '%$' THEN 100 ELSE 1 END, 9) AS number"]], "c0 AS t, c1 AS mark, c2::DOUBLE AS number")
case("proof_cases", PROOFS, "t string", [*_READ, [f"{N.evidence('b', 'kind')} AS proof"]], "c0 AS t, c1::VARCHAR AS proof")
case("date_cases", DATES, "t string, fallback string", [[f"{D.parts('t')} AS p"], [f"{D.proof_of('p')} AS proof", f"{D.way_of('p', 'fallback')} AS way"], [f"{D.date_of('p', 'way')} AS day", f"{D.time_of('t')} AS part"], [f"{D.guarded('day')} AS kept"],
    ["CASE WHEN kept IS NOT NULL AND part IS NOT NULL THEN concat(cast(kept AS STRING), ' ', date_format(timestamp_seconds(cast(round(part * 86400) AS BIGINT)), 'HH:mm:ss')) END AS shown", "proof AS proves"]], "c0 AS t, c1 AS fallback, c2::VARCHAR AS shown, c3::VARCHAR AS proves")
case("clock_cases", CLOCKS, "t string", [[f"cast(round({D.clock('t')} * 86400) AS INT) AS seconds"]], "c0 AS t, c1::INT AS seconds")
case("marker_cases", MARKERS, "w string", [[f"{X.marker_kind('w')} AS kind"], ["kind AS sort", f"CASE WHEN kind = 'roman' THEN cast({X.roman_value('w')} AS INT) END AS value"]], "c0 AS w, c1::VARCHAR AS sort, c2::INT AS value")
case("link_cases", LINKS, "u string", [[f"{X.safe_url('u', SPARK)} AS link"]], "c0 AS u, c1::VARCHAR AS link")
case("inert_cases", INERT, "t string", [[f"{X.inert('t', SPARK)} AS field"]], "c0 AS t, c1 AS field")
