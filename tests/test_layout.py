import random

from folium.functions import formats
from folium.operators import graph, layout


def test_formats():
    rows = [
        ("0", 3.5, "4"), ("#,##0.00", 1234567.891, "1,234,567.89"), ("#,##0;(#,##0)", -1234, "(1,234)"), ("0.0%", 0.125, "12.5%"), ('"$"#,##0', 5, "$5"), ("0.00E+00", 12345, "1.23E+04"),
        ("#,##0,", 1234567, "1,235"), ("yyyy-mm-dd", 45296, "2024-01-05"), ("h:mm AM/PM", 0.604166667, "2:30 PM"), ("00000", 42, "00042"), ("0.##", 1.5, "1.5"), ("0;-0;nil", 0, "nil"),
        ("General", 1e-10, "1E-10"), ("General", 9007199254740993.0, "9.00719925474099E+015"), ("General", 1e16, "1E+016"), ("General", 0.1 + 0.2, "0.3"), ("General", -5, "-5"),
    ]
    for code, x, want in rows:
        assert formats.show(code, x) == want, (code, x)
    assert formats.show("0", None) is None


def test_paragraphs(spark):
    lines = [("d", 0, 0.0, 10.0, True, "Title"), ("d", 1, 20.0, 10.0, False, "one"), ("d", 2, 32.0, 10.0, False, "two"), ("d", 3, 44.0, 10.0, False, "three"), ("d", 4, 70.0, 10.0, False, "far"), ("d", 5, 82.0, 10.0, False, "1. entry"), ("d", 6, 94.0, 14.0, False, "large")]
    got = layout.paragraphs(spark.createDataFrame(lines, "doc string, place int, top double, size double, bold boolean, text string")).orderBy("place").collect()
    assert [r.paragraph for r in got] == [0, 1, 1, 1, 2, 3, 4]


def test_glyphs(spark):
    rows = [(1, 0, "a", 10.0, 5.0, 4.0, 10.0, 0), (1, 1, "a", 10.3, 5.0, 4.0, 10.0, 0), (1, 2, "b", 10.0, 5.0, 4.0, 10.0, 0), (1, 3, "b", 10.1, 5.1, 4.0, 10.0, 9), (1, 4, "a", 30.0, 5.0, 4.0, 10.0, 0)]
    got = layout.near_glyphs(spark.createDataFrame(rows, "page int, seq int, text string, x double, y double, width double, size double, rgb int")).collect()
    assert sorted((r.seq, r.text, r.rgb, r.bold) for r in got) == [(0, "a", 0, True), (3, "b", 9, False), (4, "a", 0, False)]


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in root}


def test_structural_classes(spark):
    nodes = [(i, "leaf" if i >= 4 else "node") for i in range(8)]
    edges = [(0, 0, 4), (1, 0, 5), (2, 0, 0), (3, 0, 1), (2, 1, 6), (3, 1, 7)]
    got = graph.structural_classes(spark.createDataFrame(nodes, "node long, signature string"), spark.createDataFrame(edges, "node long, place int, target long"))
    assert {r.node: r.representative for r in got.collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 4}


def test_ruled_tables(spark):
    from folium.operators import detect

    across = spark.createDataFrame([(1, i, float(y), 0.0, 200.0) for i, y in enumerate((0, 20, 40))] + [(1, 9, 300.0, 0.0, 50.0), (2, 0, 0.0, 0.0, 50.0), (2, 1, 1.0, 0.0, 50.0)], "page int, across_id int, y double, x0 double, x1 double")
    down = spark.createDataFrame([(1, i, float(x), 0.0, 40.0) for i, x in enumerate((0, 100, 101, 200))] + [(2, 0, 10.0, 0.0, 5.0), (2, 1, 40.0, 0.0, 5.0)], "page int, down_id int, x double, y0 double, y1 double")
    words = spark.createDataFrame([(1, 0, 10.0, 5.0, "a"), (1, 1, 30.0, 5.0, "b"), (1, 2, 150.0, 5.0, "c"), (1, 3, 150.0, 30.0, "d"), (1, 4, 500.0, 5.0, "out")], "page int, word_id int, x double, y double, text string")
    tables = detect.ruled_tables(across, down, "page")
    got = tables.collect()
    assert [(r.page, r.xs, r.ys) for r in got] == [(1, [0.0, 100.0, 200.0], [0.0, 20.0, 40.0])]
    assert sorted((r.row, r.col, r.text) for r in detect.table_cells(tables, words, "page").collect()) == [(0, 0, "a b"), (0, 1, "c"), (1, 1, "d")]
    assert [r.text for r in detect.free_words(tables, words, "page").collect()] == ["out"]


def test_chapters_by_size(spark):
    rows = [("d", 0, False, 40), ("d", 1, False, 70), ("d", 2, True, 10), ("d", 3, False, 20), ("d", 4, False, 95), ("e", 0, True, 500), ("e", 1, False, 1)]
    got = layout.chapters_by_size(spark.createDataFrame(rows, "doc string, place int, heading boolean, chars int"), 100).collect()
    assert {(r.doc, r.place): r.chapter for r in got} == {("d", 0): 0, ("d", 1): 1, ("d", 2): 2, ("d", 3): 2, ("d", 4): 3, ("e", 0): 0, ("e", 1): 1}


def test_key_values(spark):
    rows = [("d", r, x) for r, x in [(0, 100.0), (1, 101.5), (2, 102.0), (3, 102.5), (0, 300.0), (1, 301.0), (1, 300.5)]]
    got = layout.key_values(spark.createDataFrame(rows, "doc string, row int, x double")).collect()
    assert [tuple(r) for r in got] == [("d", 100.0, 3)]  # 102.5 begins a cluster of its own, 300 has two rows


def test_row_groups(spark):
    rows = [("d", i, top, 8.0) for i, top in enumerate([0.0, 10.0, 40.0, 50.0, 90.0])] + [("e", 0, 5.0, 8.0)]
    got = layout.row_groups(spark.createDataFrame(rows, "doc string, place int, top double, size double")).collect()
    assert {(r.doc, r.place): r.row for r in got} == {("d", 0): 0, ("d", 1): 0, ("d", 2): 1, ("d", 3): 1, ("d", 4): 2, ("e", 0): 0}


def test_polynomial_trend(spark):
    import numpy as np

    from folium.operators import charts

    rnd = np.random.default_rng(1)
    rows = [("a", float(x), float(2 - x + 0.5 * x**3 + rnd.normal())) for x in range(-6, 7)] + [("b", 1.0, 2.0), ("b", 2.0, 3.0)]
    got = {r.k: r for r in charts.polynomial_trend(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y", 3).collect()}
    want = np.polynomial.polynomial.polyfit([x for k, x, _ in rows if k == "a"], [y for k, _, y in rows if k == "a"], 3)
    assert np.allclose([got["a"][f"c{k}"] for k in range(4)], want, atol=1e-6)
    assert got["b"].c0 is None or got["b"].c0 != got["b"].c0


def test_placed_cells(spark):
    rows = [("t", 0, 0, 0, 1, 3, "a"), ("t", 1, 1, 1, 1, 1, "b"), ("t", 2, 1, 0, 2, 3, "c"), ("t", 3, 0, 2, 1, 1, "d"), ("t", 4, 0, 3, 3, 9, "e"), ("t", 5, 9, 0, 1, 1, "gone"), ("t", 6, 2, 0, 1, 1, None), ("u", 0, 0, 0, 0, 0, None)]
    df = spark.createDataFrame(rows, "table string, place int, row int, col int, row_span int, col_span int, text string")
    got = sorted(tuple(r) for r in layout.placed_cells(df, ["table"], 3, 5).collect())
    assert got == [("t", 0, 0, 1, 3, "a\nd"), ("t", 0, 3, 3, 2, "e"), ("t", 1, 0, 2, 1, "c"), ("t", 1, 1, 1, 1, "b"), ("u", 0, 0, 1, 1, "")]
    assert layout.placed_cells(df.limit(0), ["table"]).count() == 0
