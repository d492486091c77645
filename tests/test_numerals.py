import pytest

from folium.functions import numerals as N


def test_numerals():
    assert [N.roman(n) for n in (4, 1994, 42)] == ["IV", "MCMXCIV", "XLII"]
    assert [N.cardinal(n) for n in (0, 13, 21, 100, 342, 1_000_001)] == ["zero", "thirteen", "twenty-one", "one hundred", "three hundred forty-two", "one million one"]
    assert [N.ordinal(n) for n in (1, 2, 3, 4, 11, 112, 121)] == ["1st", "2nd", "3rd", "4th", "11th", "112th", "121st"]
    assert [N.cjk(n) for n in (0, 10, 12, 20, 105, 110, 2024)] == ["〇", "十", "十二", "二十", "一百〇五", "一百一十", "二千〇二十四"]
    assert N.full_width(105) == "１０５" and [N.hebrew(n) for n in (1, 15, 16, 27, 418)] == ["א", "טו", "טז", "כז", "תיח"]


def test_direction():
    assert [N.direction(t) for t in ("12 שלום abc", "  abc שלום", "123", None, "مرحبا")] == ["rtl", "ltr", None, None, "rtl"]


@pytest.mark.parametrize(("text", "points"), [("10pt", 10), ("96px", 72), ("calc(100% - 20pt)", 180), ("min(10pt, 1in)", 10), ("max(2em, 10pt)", 24), ("clamp(5pt, 50%, 90pt)", 90), ("calc(2 * (3pt + 1pt) / 4)", 2), ("calc(1pt +", None), ("10furlong", None), ("-5pt", -5)])
def test_lengths(text, points):
    got = N.length(text, 200)
    assert got == points if points is None else abs(got - points) < 1e-9


def test_columns(spark):
    df = spark.createDataFrame([(4,), (None,)], "n long")
    assert [r.x for r in df.select(N.column(N.roman, N.F.col("n")).alias("x")).collect()] == ["IV", None]
