"""Queries on joins of ranges and dictionaries, group rules, references, tags and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.functions.dialect import SPARK
from folium.operators import geometry as G
from folium.operators import tables as T
from folium.plans.base import Catalogue
from folium.plans.scalars import KEY, dual

catalogue = Catalogue()
add = catalogue.add

dual("field_tags", "customer", lambda d: [{"c_custkey": "c_custkey", "tag": "concat('k=', replace(url_encode(c_mktsegment || ' &' || c_name), '+', '%20'))"}, {"c_custkey": "c_custkey", "tag": "tag", "value": "url_decode(substring(tag, 3))"}])
dual("resolve_refs", "pages", lambda d: [{"page_id": "page_id", "ref": "concat('a/b/../', CASE page_id % 4 WHEN 0 THEN './x.png' WHEN 1 THEN '../../../up' WHEN 2 THEN 'c/../d' ELSE 'plain%20name' END)"},
    {"page_id": "page_id", "p": d.replace(d.replace("ref", r"(^|/)[.]/", "$1"), r"[^/.]+/[.][.]/", "")}, {"page_id": "page_id", "p": d.replace("p", r"[^/.]+/[.][.]/", "")},
    {"page_id": "page_id", "path": f"CASE WHEN {d.matches('p', r'^[.][.]/|^/')} THEN NULL ELSE url_decode(p) END"}])
dual("css_vars", "lineitem", lambda d: [KEY | {"v": "concat('var(--', CASE l_returnflag WHEN 'A' THEN 'ink' WHEN 'N' THEN 'deep' ELSE 'none' END, ', black)')"}, KEY | {"v": "replace(v, 'var(--deep, black)', 'var(--ink, grey)')"}, KEY | {"v": "replace(replace(v, 'var(--ink, black)', 'navy'), 'var(--ink, grey)', 'navy')"}, KEY | {"colour": d.replace("v", r"^var[(]--[a-z]+, (.*)[)]$", "$1")}])
dual("media_sniff", "orders", lambda d: [{"o_orderkey": "o_orderkey", "head": "CASE o_orderkey % 4 WHEN 0 THEN 'iVBORw0KGgo=' WHEN 1 THEN '/9j/4AAQ' WHEN 2 THEN 'R0lGODlh' ELSE 'AAAA' END"}, {"o_orderkey": "o_orderkey", "h": "hex(unbase64(head))" if d is SPARK else "hex(from_base64(head))"}, {"o_orderkey": "o_orderkey", "kind": "CASE WHEN h LIKE '89504E47%' THEN 'png' WHEN h LIKE 'FFD8FF%' THEN 'jpeg' WHEN h LIKE '474946%' THEN 'gif' END"}])
dual("sheet_escapes", "part", lambda d: [{"p_partkey": "p_partkey", "t": "concat(p_name, CASE p_size % 2 WHEN 0 THEN '_x0041_' ELSE '' END)"}, {"p_partkey": "p_partkey", "shown": d.replace("t", r"_x([0-9A-Fa-f]{4})_", "_x005F_x$1_")}])
dual("w3c_times", "orders", lambda d: [{"o_orderkey": "o_orderkey", "t": "CASE o_orderkey % 3 WHEN 0 THEN concat(cast(cast(o_orderdate AS DATE) AS VARCHAR(20)), 'T10:20:30') WHEN 1 THEN cast(cast(o_orderdate AS DATE) AS VARCHAR(20)) ELSE 'soon' END"}, {"o_orderkey": "o_orderkey", "day": f"CASE WHEN {d.matches('t', '^[0-9]{4}-[0-9]{2}-[0-9]{2}(T[0-9:]{8})?$')} THEN cast(try_cast(substring(t, 1, 10) AS DATE) AS VARCHAR(20)) END"}])
dual("active_content", "pages", lambda d: [{"page_id": "page_id", "part": "CASE page_id % 5 WHEN 0 THEN 'word/vbaProject.bin' WHEN 1 THEN 'word/embeddings/oleObject1.bin' WHEN 2 THEN 'xl/externalLinks/externalLink1.xml' WHEN 3 THEN 'word/activeX/a.xml' ELSE 'word/document.xml' END"}, {"page_id": "page_id", "kind": f"CASE WHEN {d.matches('part', 'vbaProject')} THEN 'macro' WHEN {d.matches('part', 'oleObject|embeddings/')} THEN 'object' WHEN {d.matches('part', 'externalLink')} THEN 'link' WHEN {d.matches('part', 'activeX/')} THEN 'control' END"}])


@add("""WITH b AS (SELECT p_partkey AS box_id, p_partkey % 10 AS page, p_size * 100.0 AS "left", p_size * 100.0 + 150 AS "right", 1.0 AS top, 1.0 + p_size % 5 AS bottom FROM part),
  p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 10 AS page, floor(l_extendedprice / 20) AS x, l_linenumber::DOUBLE AS y FROM lineitem),
  h AS (SELECT l_orderkey, l_linenumber, l_partkey, box_id, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, p.page, x ORDER BY ("right" - "left") * (bottom - top), box_id) AS r FROM (SELECT DISTINCT * FROM p) p JOIN b ON p.page = b.page AND x BETWEEN "left" AND "right" AND y BETWEEN top AND bottom)
  SELECT l_orderkey, l_linenumber, l_partkey, box_id FROM h WHERE r = 1""", "part", "lineitem")
def merged_ranges(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    b = part.selectExpr("p_partkey AS box_id", "p_partkey % 10 AS page", "p_size * 100.0D AS left", "p_size * 100.0D + 150 AS right", "1.0D AS top", "1.0D + p_size % 5 AS bottom")
    p = lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey % 10 AS page", "cast(floor(l_extendedprice / 20) AS DOUBLE) AS x", "cast(l_linenumber AS DOUBLE) AS y")
    return G.in_boxes(p, b, "page", 500.0, ["l_orderkey", "l_linenumber", "l_partkey", "page", "x", "y"]).where("box_id IS NOT NULL").select("l_orderkey", "l_linenumber", "l_partkey", "box_id")


@add("""WITH g AS (SELECT l_orderkey, l_linenumber, l_suppkey % 20 AS page, floor(l_extendedprice % 1000 / 24) AS cx, floor(l_quantity / 24) AS cy, l_returnflag FROM lineitem)
  SELECT l_orderkey, l_linenumber FROM g WHERE l_returnflag = 'A' AND NOT EXISTS (SELECT 1 FROM g o WHERE o.l_returnflag = 'N' AND o.page = g.page AND o.cx = g.cx AND o.cy = g.cy AND o.l_linenumber = g.l_linenumber)""", "lineitem")
def ocr_gaps(lineitem: DataFrame) -> DataFrame:
    g = lineitem.withColumn("page", F.col("l_suppkey") % 20).withColumn("cx", F.floor(F.col("l_extendedprice") % 1000 / 24)).withColumn("cy", F.floor(F.col("l_quantity") / 24))
    shown = g.where("l_returnflag = 'N'").select("page", "cx", "cy", "l_linenumber")
    return g.where("l_returnflag = 'A'").join(shown, ["page", "cx", "cy", "l_linenumber"], "left_anti").select("l_orderkey", "l_linenumber")


@add("""WITH d AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS idx FROM (SELECT DISTINCT p_type FROM part)), c AS (SELECT l_orderkey, l_linenumber, l_partkey % 200 AS idx FROM lineitem) SELECT l_orderkey, l_linenumber, p_type AS text FROM c LEFT JOIN d USING (idx)""", "part", "lineitem")
def shared_strings(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    table = part.select("p_type").distinct().withColumn("idx", (F.row_number().over(Window.orderBy("p_type")) - 1).cast("long"))  # a table of strings is bounded by its file
    return lineitem.withColumn("idx", F.col("l_partkey") % 200).join(table, "idx", "left").select("l_orderkey", "l_linenumber", F.col("p_type").alias("text"))


@add("""WITH t AS (SELECT l_suppkey, count(*) AS cells, count(DISTINCT l_orderkey) AS rows, count(DISTINCT l_linenumber) AS cols, avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) AS filled FROM lineitem GROUP BY 1)
  SELECT l_suppkey, rows >= 2 AND cols >= 2 AND filled >= 0.3 AS plausible, rows >= 5 AND cells >= 30 AS large FROM t""", "lineitem")
def plausible_tables(lineitem: DataFrame) -> DataFrame:
    t = lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("l_orderkey").alias("rows"), F.countDistinct("l_linenumber").alias("cols"), F.avg(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)).alias("filled"))
    return t.select("l_suppkey", ((F.col("rows") >= 2) & (F.col("cols") >= 2) & (F.col("filled") >= 0.3)).alias("plausible"), ((F.col("rows") >= 5) & (F.col("cells") >= 30)).alias("large"))


@add("""WITH k AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'table' ELSE 'prose' END AS kind FROM orders), l AS (SELECT *, lag(kind) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS was FROM k)
  SELECT o_custkey, o_orderkey, kind, (sum(CASE WHEN was = kind THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::BIGINT AS sheet FROM l""", "orders")
def sheet_assembly(orders: DataFrame) -> DataFrame:
    k = orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", "table").otherwise("prose").alias("kind"))
    was = F.lag("kind").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return T.runs(k, ["o_custkey"], ["o_orderkey"], was == F.col("kind"), "sheet")


@add("""SELECT l_orderkey, max(w) AS width FROM (SELECT l_orderkey, l_linenumber, sum(l_linenumber % 3 + 1)::BIGINT AS w FROM lineitem GROUP BY 1, 2) GROUP BY 1""", "lineitem")
def grid_spans(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.col("l_linenumber") % 3 + 1).alias("w")).groupBy("l_orderkey").agg(F.max("w").alias("width"))


@add("SELECT source, sum(len(string_split(text, chr(10))))::BIGINT AS weight FROM documents GROUP BY 1", "documents")
def page_weight(documents: DataFrame) -> DataFrame:
    return documents.groupBy("source").agg(F.sum(F.size(F.split("text", "\n"))).alias("weight"))


@add("SELECT event_type, array_to_string(list_sort(list(DISTINCT user_id))[1:5], ',') AS first_users FROM events GROUP BY 1", "events")
def capped_warnings(events: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("event_type").orderBy("user_id"))
    kept = events.select("event_type", "user_id").distinct().withColumn("r", place).where("r <= 5")
    return kept.groupBy("event_type").agg(F.array_join(F.sort_array(F.collect_list("user_id")).cast("array<string>"), ",").alias("first_users"))


@add("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_quantity / 10), l_extendedprice, l_partkey)::INT AS place FROM lineitem", "lineitem")
def reading_order(lineitem: DataFrame) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(F.round(F.col("l_quantity") / 10), "l_extendedprice", "l_partkey")
    return lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(w).alias("place"))


@add("""SELECT o_orderkey, (o_orderkey % 12 // 3 * 3 + o_orderkey % 3)::INT AS over_down, (o_orderkey % 3 * 4 + o_orderkey % 12 // 3)::INT AS down_over FROM orders""", "orders")
def page_tiles(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return orders.select("o_orderkey", (F.floor(k % 12 / 3) * 3 + k % 3).cast("int").alias("over_down"), (k % 3 * 4 + F.floor(k % 12 / 3)).cast("int").alias("down_over"))


@add("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT (l_linenumber % 5 = 0 OR l_returnflag = 'R')", "lineitem")
def hidden_rows(lineitem: DataFrame) -> DataFrame:
    return lineitem.where(~((F.col("l_linenumber") % 5 == 0) | (F.col("l_returnflag") == "R"))).select("l_orderkey", "l_linenumber", "l_quantity")


@add("""WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS x, l_quantity AS w FROM lineitem), s AS (SELECT *, x - lag(x + w) OVER (PARTITION BY l_orderkey ORDER BY x, l_partkey, l_linenumber) AS gap FROM g)
  SELECT l_orderkey, l_linenumber, l_partkey, (sum(CASE WHEN gap > 0.9 * 1200 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY x, l_partkey, l_linenumber ROWS UNBOUNDED PRECEDING))::BIGINT AS segment FROM s""", "lineitem")
def line_segments(lineitem: DataFrame) -> DataFrame:
    g = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("w"))
    return G.words_from_gaps(g, ["l_orderkey"], ["x", "l_partkey", "l_linenumber"], "x", "w", F.lit(0.9 * 1200)).select("l_orderkey", "l_linenumber", "l_partkey", F.col("word").alias("segment"))


@add("""SELECT s_suppkey AS id, s_name AS name, 'supplier' AS finder FROM supplier UNION ALL SELECT c_custkey, c_name, 'customer' FROM customer""", "supplier", "customer")
def union_tables(supplier: DataFrame, customer: DataFrame) -> DataFrame:
    a = supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("finder"))
    return a.unionByName(customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("finder")))


@add("""WITH b AS (SELECT (o_custkey % 100)::VARCHAR AS doc, o_orderkey AS place, o_orderpriority AS t FROM orders)
  SELECT doc, string_agg('- ' || replace(replace(t, '_', '\\_'), '*', '\\*'), chr(10) || chr(10) ORDER BY place) AS value FROM b GROUP BY 1""", "orders")
def markdown_documents(orders: DataFrame) -> DataFrame:
    from folium.sinks.writers import markdown

    return markdown(orders.select((F.col("o_custkey") % 100).cast("string").alias("doc"), F.col("o_orderkey").alias("place"), F.lit("item").alias("kind"), F.lit(1).alias("level"), F.concat(F.lit("a"), "o_orderpriority").alias("text"))).withColumn("value", F.replace("value", F.lit("- a"), F.lit("- ")))


@add("""WITH c AS (SELECT o_custkey % 100 AS doc, o_orderkey AS row, o_orderstatus AS a, '-x' || o_orderpriority AS b FROM orders)
  SELECT doc, string_agg(a || ',' || '''' || b || chr(13) || chr(10), '' ORDER BY row) AS value FROM c GROUP BY 1""", "orders")
def csv_documents(orders: DataFrame) -> DataFrame:
    from folium.sinks.writers import csv

    cells = orders.select((F.col("o_custkey") % 100).alias("doc"), F.col("o_orderkey").alias("row"), F.posexplode(F.array(F.col("o_orderstatus"), F.concat(F.lit("-x"), "o_orderpriority"))).alias("col", "text"))
    return csv(cells)
