"""Ruled tables from rules and words: crossings, components, grids, and words placed into cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.operators import geometry as G
from folium.operators.graph import connected_components


def ruled_tables(across: DataFrame, down: DataFrame, page: str, slack: float = 2.5, cell: float = 100.0) -> DataFrame:
    """(page, box_id, left, top, right, bottom, xs, ys): a table for every connected lattice of two rules each way or more.

    across: across_id, y, x0, x1; down: down_id, x, y0, y1. Rules within slack of one another count as one edge.
    """
    hits = G.crossings(across, down, page, slack, cell).withColumn("a", F.concat_ws(":", page, F.lit("a"), "across_id")).withColumn("d", F.concat_ws(":", page, F.lit("d"), "down_id"))
    roots = connected_components(hits, "a", "d")
    edges = lambda values: F.aggregate(F.array_sort(values), F.array().cast("array<double>"), lambda out, v: F.when((F.size(out) > 0) & (v - F.element_at(out, -1) <= slack), out).otherwise(F.concat(out, F.array(v))))
    ys = hits.join(roots, hits.a == roots.node).join(across.select(page, "across_id", F.col("y").cast("double").alias("y")), [page, "across_id"]).groupBy(page, "root").agg(edges(F.collect_set("y")).alias("ys"))
    xs = hits.join(roots, hits.a == roots.node).join(down.select(page, "down_id", F.col("x").cast("double").alias("x")), [page, "down_id"]).groupBy(page, "root").agg(edges(F.collect_set("x")).alias("xs"))
    grid = xs.join(ys, [page, "root"]).where((F.size("xs") >= 2) & (F.size("ys") >= 2))
    return grid.select(page, F.col("root").alias("box_id"), F.element_at("xs", 1).alias("left"), F.element_at("ys", 1).alias("top"), F.element_at("xs", -1).alias("right"), F.element_at("ys", -1).alias("bottom"), "xs", "ys")


def table_cells(tables: DataFrame, words: DataFrame, page: str, cell: float = 100.0) -> DataFrame:
    """(page, box_id, row, col, text): words (word_id, x, y, text) by the cell their centre lies in, in reading order."""
    placed = G.in_boxes(words, tables.drop("xs", "ys"), page, cell, [page, "word_id"]).where("box_id IS NOT NULL")
    placed = placed.join(tables.select(page, "box_id", "xs", "ys"), [page, "box_id"])
    placed = placed.withColumn("row", G.band(F.col("ys"), F.col("y"))).withColumn("col", G.band(F.col("xs"), F.col("x")))
    lines = placed.groupBy(page, "box_id", "row", "col").agg(F.sort_array(F.collect_list(F.struct("y", "x", "text"))).alias("w"))
    return lines.select(page, "box_id", "row", "col", F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("text"))


def free_words(tables: DataFrame, words: DataFrame, page: str, cell: float = 100.0) -> DataFrame:
    """The words outside all tables."""
    return G.in_boxes(words, tables.drop("xs", "ys"), page, cell, [page, "word_id"]).where("box_id IS NULL").drop("box_id")


def restored_rows(tables: DataFrame, lines: DataFrame, page: str, reach: float = 1.6) -> DataFrame:
    """(page, box_id, side, row, col, text): lines that a table's edges left out, as cells of the table with them.

    tables: box_id, xs, ys. lines: line_id, top, bottom, baseline, words (x, right, text), wide (a gap beyond a space),
    running, flow. Lines within 2 of one another's baseline are a band. Bands inside go to the row they stand in; above and
    below the table the next band joins while it is within reach times the usual row height of what it would join, and
    looks like a row: above by two columns, a gap, and no running text; below unless it is a running line without those, or
    running text that fills less than half of three columns or more. Rows count from the first that was restored.
    """
    size = F.size("ys") - 1
    heights = F.array_sort(F.transform(F.sequence(F.lit(1), size), lambda i: F.element_at("ys", i + 1) - F.element_at("ys", i)))
    usual = F.greatest(F.lit(8.0), F.element_at(heights, (F.floor(size / 2) + 1).cast("int")))
    inner = lambda edges, v: F.size(F.filter(F.slice(edges, 2, F.size(edges) - 2), lambda e: e <= v))
    t = tables.where((F.size("xs") > 1) & (F.size("ys") > 1)).select(page, "box_id", "xs", "ys", (usual * reach).alias("reach"))
    near = lines.where(F.size("words") > 0).join(t, page).where((F.array_min("words.x") >= F.element_at("xs", 1) - 4) & (F.array_max("words.right") <= F.element_at("xs", -1) + 4))
    table = Window.partitionBy(page, "box_id")
    step = F.col("baseline") - F.lag("baseline").over(table.orderBy("baseline", "line_id"))
    near = near.withColumn("new", F.when(step <= 2, 0).otherwise(1)).withColumn("band", F.sum("new").over(table.orderBy("baseline", "line_id").rowsBetween(Window.unboundedPreceding, 0)))
    near = near.withColumn("placed", F.transform("words", lambda w: F.struct(inner(F.col("xs"), (w["x"] + w["right"]) / 2).alias("col"), w["x"].alias("x"), w["text"].alias("text"))))
    bands = near.groupBy(page, "box_id", "band").agg(
        F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.flatten(F.collect_list("placed")).alias("placed"), ((F.count(F.lit(1)) > 1) | F.max("wide")).alias("tabular"),
        F.max("running").alias("running"), F.max("flow").alias("flow"), F.first("xs").alias("xs"), F.first("ys").alias("ys"), F.first("reach").alias("reach"),
    )
    first, last, centre = F.element_at("ys", 1), F.element_at("ys", -1), (F.col("top") + F.col("bottom")) / 2
    bands = bands.withColumn("centre", centre).withColumn("side", F.when(F.col("centre") < first, "above").when(F.col("centre") > last, "below").otherwise("inside"))
    outward = Window.partitionBy(page, "box_id", "side").orderBy(F.when(F.col("side") == "above", -F.col("centre")).otherwise(F.col("centre")), "band")
    gap = F.when(F.col("side") == "above", F.coalesce(F.lag("top").over(outward), first) - F.col("bottom")).otherwise(F.col("top") - F.coalesce(F.lag("bottom").over(outward), last))
    filled, columns = F.size(F.array_distinct("placed.col")), F.size("xs") - 1
    like_row = (filled >= 2) & F.col("tabular")
    fits = F.when(F.col("side") == "above", like_row & ~F.col("flow")).otherwise(~(F.col("running") & ~like_row) & ~(F.col("flow") & ((columns < 3) | (filled * 2 < columns))))
    bands = bands.withColumn("ok", (F.col("side") == "inside") | (fits & (gap <= F.col("reach"))))
    bands = bands.withColumn("kept", F.min("ok").over(outward.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(outward)).where("kept")
    bands = bands.withColumn("more", F.sum(F.when(F.col("side") == "above", 1).otherwise(0)).over(table))
    row = F.when(F.col("side") == "above", F.col("more") - F.col("nth")).when(F.col("side") == "below", F.col("more") + size + F.col("nth") - 1).otherwise(F.col("more") + inner(F.col("ys"), F.col("centre")))
    cells = bands.select(page, "box_id", "side", "band", row.cast("int").alias("row"), F.explode("placed").alias("w"))
    cells = cells.groupBy(page, "box_id", "side", "row", F.col("w.col").alias("col")).agg(F.array_sort(F.collect_list(F.struct("band", "w.x", "w.text"))).alias("ws"))
    return cells.select(page, "box_id", "side", "row", "col", F.array_join(F.transform("ws", lambda w: w["text"]), " ").alias("text"))
