"""Queries over all rows and whole texts against brute force."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from folium import plans
from folium.operators import geometry as G
from folium.operators import graph
from folium.plans import documents as D
from folium.plans import more as M
from folium.sources import files


def roots(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(near):
        todo = [] if n in out else [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return out


def test_components_of_all_orders(spark):
    rnd = random.Random(1)
    chain = [(i, i + 1) for i in range(1000, 1150)]
    hub = [(5, i) for i in range(2000, 2400)]
    rest = [(rnd.randint(3000, 3200), rnd.randint(3000, 3200)) for _ in range(90)]
    rows = chain + hub + rest
    orders = spark.createDataFrame(rows, "o_custkey long, o_orderkey long")
    assert {r.node: r.root for r in D.components_chained(orders).collect()} == roots(rows)
    assert {r.node: r.root for r in D.components(orders).collect()} == roots([(a, -b) for a, b in rows])


def test_components_in_few_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(graph, "cut", lambda df, made=graph.cut: tables.append(1) or made(df))
    rnd = random.Random(3)
    chain = [(i, i + 1) for i in range(300)]
    mixed = rnd.sample(range(1000, 1600), 600)
    rows = chain + list(zip(mixed, mixed[1:])) + [(5000, i) for i in range(2000, 2300)] + [(7000, 7000), (None, 1), (8000, None)]
    for kind in ("long", "string"):
        edges = spark.createDataFrame([tuple(x if x is None else x if kind == "long" else f"n{x:05}" for x in r) for r in rows], f"src {kind}, dst {kind}")
        want = roots([tuple(r) for r in map(tuple, edges.collect()) if None not in r])
        assert {r.node: r.root for r in graph.connected_components(edges).collect()} == want and len(tables) <= 2
        tables.clear()
        assert {r.node: r.root for r in graph.connected_components(edges, small=40).collect()} == want
        tables.clear()
    assert graph.connected_components(edges.where("false")).count() == 0


def test_all_boxes_are_looked_up(spark):
    rnd = random.Random(2)
    part = [(i, rnd.randint(1, 50)) for i in range(1, 400)]
    lines = [(i, rnd.randint(1, 7), i, rnd.randint(1, 40), float(rnd.randint(900, 105_000))) for i in range(300)]
    boxes = [(i, i % 10, z * 100.0, z * 100.0 + 150, 1.0, 1.0 + z % 5) for i, z in part]
    want = set()
    for o, n, p, s, price in lines:
        x = price // 20
        hit = [((r - l) * (b - t), i) for i, page, l, r, t, b in boxes if page == s % 10 and l <= x <= r and t <= n <= b]
        if hit:
            want.add((o, n, p, min(hit)[1]))
    got = M.merged_ranges(spark.createDataFrame(part, "p_partkey long, p_size int"), spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double"))
    assert {tuple(r) for r in got.collect()} == want and any(i % 25 for *_, i in want)


def test_copies_of_boxes_are_compared_once(spark):
    rnd = random.Random(4)
    kinds = [(rnd.randint(0, 2), x := rnd.randint(-60, 200) / 2, x + rnd.randint(-1, 60) / 2, y := rnd.randint(-20, 80) / 2, y + rnd.randint(0, 30) / 2) for _ in range(120)]
    kinds += [(1, -500.0, 500.0, -300.0, 300.0), (1, 7.0, 7.0, 3.0, 3.0), (None, 0.0, 9.0, 0.0, 9.0)]
    ids = rnd.sample(range(10_000, 20_000), 60 * len(kinds))
    boxes = [(i, *kinds[n % len(kinds)]) for n, i in enumerate(ids)]
    points = [(n, rnd.choice([0, 1, 2, 3, None]), rnd.randint(-80, 260) / 2, rnd.randint(-30, 110) / 2) for n in range(500)] + [(-1, 1, 7.0, 3.0), (None, 1, 7.0, 3.0), (-2, 0, None, 3.0)]

    def least(page, x, y):
        if page is None or x is None:
            return None
        return min((((r - l) * (b - t), i) for i, p, l, r, t, b in boxes if p == page and l <= x <= r and t <= y <= b), default=(0, None))[1]

    given = spark.createDataFrame(points + points[:50], "id long, page int, x double, y double")
    laid = spark.createDataFrame(boxes, "box_id long, page int, left double, right double, top double, bottom double")
    want = sorted(((*p, least(*p[1:])) for p in points), key=repr)
    for cell in (3.0, 50.0, 10_000.0):
        assert sorted(map(tuple, G.in_boxes(given, laid, "page", cell, ["id", "page", "x", "y"]).collect()), key=repr) == want
    named = given.distinct().where("id is not null").withColumn("text", F.lit("t"))
    got = G.in_boxes(named, laid, "page", 50.0, ["page", "id"]).select("id", "page", "x", "y", "box_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == [p for p in want if p[0] is not None]
    assert {r.box_id for r in G.in_boxes(given, laid.where("false"), "page", 50.0, ["id", "page", "x", "y"]).collect()} == {None}
    assert {r.box_id for r in G.in_boxes(given, laid.where("left = right"), "page", 50.0, ["id", "page", "x", "y"]).collect()} > {None}


def test_crossings_move_no_pairs(spark):
    rnd = random.Random(5)
    across = [(i, rnd.choice([1, 2, None]), float(rnd.randint(-60, 60)), x := float(rnd.randint(-50, 50)), x + rnd.randint(-6, 90)) for i in range(120)]
    down = [(i, rnd.choice([1, 2, None]), float(rnd.randint(-60, 140)), y := float(rnd.randint(-80, 50)), y + rnd.randint(-6, 60)) for i in range(150)]
    across, down = across + across[:5] + [(500, 1, None, 0.0, 9.0)], down + down[:5] + [(600, 1, 4.0, None, 9.0)]
    want = sorted((p, i, j) for i, p, y, x0, x1 in across for j, q, x, y0, y1 in down if p == q is not None and None not in (y, y0) and x0 - 2.5 <= x <= x1 + 2.5 and y0 - 2.5 <= y <= y1 + 2.5)
    got = G.crossings(spark.createDataFrame(across, "across_id long, page int, y double, x0 double, x1 double"), spark.createDataFrame(down, "down_id long, page int, x double, y0 double, y1 double"), "page", 2.5, 25.0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > len(set(want))  # rules that stand twice cross twice, as in SQL
    assert "HashAggregate" not in got._jdf.queryExecution().toString()


def test_styles_beyond_the_limit_of_recursion(spark):
    sizes = {i: (i * 7 + 1) % 50 + 1 for i in range(400) if i % 11}
    parts = spark.createDataFrame([(i, z) for i, z in sizes.items()] + [(400, None), (401, 9), (401, 12), (2005, 4), (2006, 4)], "p_partkey long, p_size int")

    def size(i):
        z = sizes.get(i)
        return z if z is None or z % 3 == 0 else None if i % 5 == 0 else size(i // 5)

    was = spark.conf.get("spark.sql.cteRecursionRowLimit")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "300")
    try:
        got = {r.id: r["size"] for r in D.style_inheritance(parts).collect()}
    finally:
        spark.conf.set("spark.sql.cteRecursionRowLimit", was)
    assert got == {i: size(i) for i in sizes} | {400: None, 401: 12, 2005: None, 2006: 12}


def test_long_chains_and_circles_of_bases(spark):
    rows = [(i, i - 1, 7 if i == 0 else None) for i in range(300)] + [(1000, 1001, None), (1001, 1000, None), (1002, 1001, None), (1003, 5000, None), (1004, 1000, 3)]
    got = {r.id: r.size for r in graph.inherited(spark.createDataFrame(rows, "id long, base long, size int"), "id", "base", "size").collect()}
    assert got == {i: 7 for i in range(300)} | {1000: None, 1001: None, 1002: None, 1003: None, 1004: 3}


def test_tables_of_many_cells():
    page = "<table>" + "".join(f"<tr><td rowspan=2>{r}</td>" + "<td>x</td>" * 5 + "</tr>" for r in range(20_010)) + "</table>"
    cells = list(files.html_tables(page))
    assert len(cells) == 6 * 20_000 and {c[1] for c in cells} == set(range(20_000))
    assert cells[6] == (0, 1, 1, 2, 1, False, "1") and cells[-6][3] == 1
    wide = "<table>" + ("<tr>" + "<td>x</td>" * 70 + "</tr>") * 400 + "<tr><td>last</td></tr></table>"
    cells = list(files.html_tables(wide))
    assert len(cells) == 63 * 400 + 1 and cells[-1] == (0, 400, 0, 1, 1, False, "last")


def test_texts_are_taken_whole(spark, tmp_path):
    texts = ["Page 12\nété 3 of 40\n xii ", '# a*b\n1. c\n> d\né #', 'one\r\ntwo "x"', "plain", "-" * 20_000 + "\nx\n. . . . . . . . . . .\ny", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {q: [r[1] for r in plans.queries()[q](spark, str(tmp_path)).orderBy("doc_id").collect()] for q in ("signature_norm", "markdown_escape", "csv_quote", "leaders")}
    assert got["signature_norm"][0] == "page #\nété # of #\n#"
    assert got["markdown_escape"][1] == "\\# a\\*b\n1\\. c\n\\> d\né #"
    assert got["csv_quote"][2:4] == ['"one\r\ntwo ""x"""', "plain"]
    assert [len(x) for x in got["leaders"][:4]] == [3, 4, 2, 1] and got["leaders"][4] == "1010"  # eight dots are too few
    assert all(x[5] is None for x in got.values())
