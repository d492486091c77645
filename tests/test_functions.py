import datetime as dt

import pytest

from folium.functions import dates as D
from folium.functions import numbers as N
from folium.functions import text as X
from folium.functions.dialect import DUCK, SPARK

NUMBERS = [
    ("1,234.56", "ANY", 1234.56), ("1.234,56", "ANY", 1234.56), ("1 234 567", "ANY", 1234567), ("1'234.50", "ANY", 1234.5), ("12,34,567.89", "ANY", 1234567.89), ("42", "ANY", 42), ("12,5", "ANY", 12.5),
    ("(1,234)", "ANY", -1234), ("($1,234.56)", "ANY", -1234.56), ("€ 9.308,03", "ANY", 9308.03), ("12.5%", "ANY", 0.125), ("12,5 %", "ANY", 0.125), ("+5.2%", "ANY", 0.052), ("1,234.00-", "ANY", -1234),
    ("1,234", "ANY", 1234), ("1,234", "POINT", 1234), ("1,234", "COMMA", 1.234), ("1.234", "COMMA", 1234), ("12,5", "POINT", None), ("12.5", "COMMA", None),
    ("0.123", "ANY", 0.123), ("0.123", "COMMA", 0.123), ("0,123", "POINT", 0.123), (".75", "ANY", 0.75), (",5", "COMMA", 0.5), ("1 234,5", "POINT", None), ("1 234,5", "COMMA", 1234.5), ("1 234.5", "COMMA", None), ("1’234", "ANY", 1234),
    ("₩ 1,000", "ANY", 1000), ("CAD 5", "ANY", 5), ("5 zł", "ANY", 5), ("1\u20021", "ANY", None), ("1\u2003000", "ANY", 1000), ("Rs. 12,34,567", "ANY", 1234567), ("$(1,234)", "ANY", -1234), ("NZ$-7", "ANY", -7), ("12 Kč", "ANY", 12), ("CAD5", "ANY", None), ("1'234,5", "ANY", None), ("1.234", "ANY", 1.234), ("1.234.567", "ANY", 1234567),
    ("02134", "ANY", None), ("007", "ANY", None), ("0123.45", "ANY", None), ("123456789012", "ANY", None), ("555-1234", "ANY", None), ("1.2.3", "ANY", None), ("192.168.0.1", "ANY", None), ("3/4", "ANY", None), ("1e5", "ANY", None), ("5-", "ANY", None), ("4 111 1111 1111 1111", "ANY", None),
]
DATES = [
    ("2024-01-05", "ANY", "2024-01-05"), ("05.01.2024", "ANY", "2024-01-05"), ("5 Jan 2024", "ANY", "2024-01-05"), ("05-Jan-24", "ANY", "2024-01-05"), ("January 5, 2024", "ANY", "2024-01-05"), ("01/05/2024", "ANY", None),
    ("2024-03-05 10:20", "ANY", "2024-03-05"), ("03.25.2024", "ANY", "2024-03-25"), ("03.04.2024", "MDY", "2024-03-04"), ("03.04.2024", "ANY", "2024-04-03"), ("Mar 2024", "ANY", "2024-03-01"), ("3. Mar 2024", "ANY", "2024-03-03"), ("March 3 2024", "ANY", "2024-03-03"), ("3 Sept. 2024", "ANY", "2024-09-03"),
    ("2024/3-5", "ANY", None), ("3 Mar-2024", "ANY", None), ("5/6/24 7:08 p.m.", "DMY", "2024-06-05"), ("3 Mar 2024 10:00", "ANY", None), ("13/13/2024", "DMY", None), ("2024-02-30", "ANY", None), ("1 May 29", "ANY", "2029-05-01"), ("1 May 30", "ANY", "1930-05-01"),
    ("01/05/2024", "MDY", "2024-01-05"), ("05/01/2024", "DMY", "2024-01-05"), ("25/12/2024", "ANY", "2024-12-25"), ("12/25/2024", "ANY", "2024-12-25"), ("31/02/2024", "ANY", None), ("1899-12-31", "ANY", None), ("03/03/2024", "ANY", "2024-03-03"),
]


@pytest.fixture(scope="module")
def duck():
    return pytest.importorskip("duckdb").connect()


def both(spark, duck, rows, columns, steps):
    spark_df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    place = ", ".join("(" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
    sql = f"(SELECT * FROM (VALUES {place}) t({', '.join(columns)}))"
    for name, make in steps:
        spark_df = spark_df.selectExpr("*", f"{make(SPARK)} AS {name}")
        sql = f"(SELECT *, {make(DUCK)} AS {name} FROM {sql})"
    a = [r[steps[-1][0]] for r in spark_df.collect()]
    b = [r[0] for r in duck.execute(f"SELECT {steps[-1][0]} FROM {sql}").fetchall()]
    return a, b


def test_numbers(spark, duck):
    steps = [("c", lambda d: N.clean("t", d)), ("b", lambda d: N.bare("c", d)), ("neg", lambda d: N.negative("c", d)), ("kind", lambda d: f"CASE WHEN NOT {N.is_code('b', d)} THEN {N.shape('b', d)} END"), ("v", lambda d: N.value("b", "kind", "mark", d)), ("number", lambda d: f"CASE WHEN neg THEN -v ELSE v END / CASE WHEN {d.matches('c', '%$')} THEN 100 ELSE 1 END")]
    a, b = both(spark, duck, [(t, m) for t, m, _ in NUMBERS], ["t", "mark"], steps)
    for (t, m, want), x, y in zip(NUMBERS, a, b):
        assert (x is None) == (want is None) and (x is None or abs(x - want) < 1e-9), (t, m, x, want)
        assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9), (t, m, x, y)


def test_dates(spark, duck):
    a, b = both(spark, duck, [(t, o) for t, o, _ in DATES], ["t", "o"], [("d", lambda d: D.parse("t", "o", d))])
    want = [w and dt.date.fromisoformat(w) for _, _, w in DATES]
    assert a == want and b == want


def test_clocks(spark, duck):
    a, b = both(spark, duck, [("2:30 PM",), ("14:30",), ("25:00",), ("12:15 am",), ("2:30 p.m.",), ("0:10 pm",)], ["t"], [("c", lambda d: D.clock("t", d))])
    assert [x and round(float(x), 6) for x in a] == [x and round(float(x), 6) for x in b] == [round(14.5 / 24, 6), round(14.5 / 24, 6), None, round(0.25 / 24, 6), round(14.5 / 24, 6), None]


def test_markers(spark, duck):
    words = [("12.", "decimal"), ("(b)", "letter"), ("IV.", "roman"), ("hello", None), ("", None), ("12", None), ("0.", None), ("(a]", None), ("iiii.", None), ("•", "bullet")]
    a, b = both(spark, duck, [(w,) for w, _ in words], ["t"], [("k", lambda d: X.marker_kind("t", d))])
    assert a == b == [k for _, k in words]


def test_import_numbers(spark, duck):
    rows = [("00123", 123.0), ("5.", 5.0), ("1,234,567", 1234567.0), ("-0", 0.0), ("1.5E+10", 1.5e10), ("1,00", None), ("-1,5", None), ("45%", None), ("(12)", None), ("NaN", None), ("1e309", None), ("03/04/2021", None)]
    a, b = both(spark, duck, [(t,) for t, _ in rows], ["t"], [("v", lambda d: N.csv_number("t", d))])
    assert a == b == [v for _, v in rows]


def test_links_and_guards(spark, duck):
    a, b = both(spark, duck, [("  https://example.com/a b?q=1#top ",), ("javascript:x",), ("mailto:a@b.c",), ("file:///x",)], ["t"], [("u", lambda d: X.safe_url("t", d))])
    assert a == b == ["https://example.com/a%20b?q=1#top", None, "mailto:a@b.c", None]
    a, b = both(spark, duck, [("=HYPERLINK(1)",), ("-cmd",), ("-1,250.5",), ("-",), ("@x",)], ["t"], [("u", lambda d: X.inert("t", d))])
    assert a == b == ["'=HYPERLINK(1)", "'-cmd", "-1,250.5", "-", "'@x"]
