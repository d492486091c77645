"""Queries on corpus statistics, tables of cells, geometry, joins and graphs. Geometry is derived from columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folium.functions import dates as D
from folium.functions import numbers as N
from folium.functions import text as X
from folium.functions.dialect import DUCK, SPARK
from folium.operators import corpus as C
from folium.operators import detect
from folium.operators import geometry as G
from folium.operators import graph
from folium.operators import tables as T
from folium.plans.base import Catalogue
from folium.plans.scalars import date_text, number_text

catalogue = Catalogue()
add = catalogue.add


@add("""WITH s AS (SELECT l_suppkey, l_quantity, sum(l_linenumber) AS w FROM lineitem GROUP BY 1, 2)
  SELECT l_suppkey, arg_min(l_quantity, (-w * 1000 + l_quantity)) AS mode, max(w)::BIGINT AS weight FROM s GROUP BY 1""", "lineitem")
def weighted_mode(lineitem: DataFrame) -> DataFrame:
    return C.weighted_mode(lineitem, ["l_suppkey"], "l_quantity", F.col("l_linenumber"))


@add("SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) * 2 > sum(l_quantity) AS mostly FROM lineitem GROUP BY 1", "lineitem")
def majority_flag(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_suppkey").agg(C.majority(F.col("l_returnflag") == "N", F.col("l_quantity")).alias("mostly"))


@add("""WITH b AS (SELECT l_suppkey, round(l_quantity / 0.5) * 0.5 AS bin, sum(l_linenumber) AS w FROM lineitem GROUP BY 1, 2),
  r AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY bin) AS upto, sum(w) OVER (PARTITION BY l_suppkey) AS total FROM b)
  SELECT l_suppkey, min(bin) AS median FROM r WHERE upto > floor(total / 2) GROUP BY 1""", "lineitem")
def weighted_median(lineitem: DataFrame) -> DataFrame:
    return C.weighted_median(lineitem, ["l_suppkey"], "l_quantity", F.col("l_linenumber"))


@add("""SELECT l_suppkey, l_quantity AS value FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)
  WHERE r = floor(n / 3) + 1""", "lineitem")
def order_statistic(lineitem: DataFrame) -> DataFrame:
    return C.order_statistic(lineitem, ["l_suppkey"], "l_quantity", F.floor(F.col("count") / 3))


@add("""WITH b AS (SELECT l_linenumber, round(l_quantity / 7 * 4) / 4 AS q, count(*) AS c FROM lineitem GROUP BY 1, 2),
  m AS (SELECT l_linenumber, arg_min(q, -c * 1000 + q) AS q, max(c) AS c FROM b GROUP BY 1)
  SELECT l_linenumber, least(CASE WHEN c >= 2 THEN q ELSE l_linenumber * 1.2 END, l_linenumber * 1.5)::DOUBLE AS pitch FROM m""", "lineitem")
def pitch_histogram(lineitem: DataFrame) -> DataFrame:
    return C.pitch_modes(lineitem.withColumn("p", F.col("l_quantity") / 7), "l_linenumber", "p").select("l_linenumber", F.col("pitch").cast("double").alias("pitch"))


@add("""WITH s AS (SELECT l_quantity AS size, l_returnflag = 'A' AS bold, sum(l_linenumber) AS chars FROM lineitem GROUP BY 1, 2), t AS (SELECT sum(chars) AS total FROM s),
  k AS (SELECT size, bold FROM s, t WHERE (size >= 1.12 * 30 OR (bold AND size > 30 - 0.6)) AND chars * 4 < total)
  SELECT size, bold, tier::INT AS tier FROM (SELECT *, row_number() OVER (ORDER BY size DESC, bold DESC) AS tier FROM k) WHERE tier <= 6""", "lineitem")
def heading_tiers(lineitem: DataFrame) -> DataFrame:
    styles = lineitem.select(F.col("l_quantity").alias("size"), (F.col("l_returnflag") == "A").alias("bold"), F.col("l_linenumber").alias("chars"))
    return C.heading_tiers(styles, "size", "bold", "chars", F.lit(30))


#: Every document is a page that begins with a line of its source and number.
_LINES = "SELECT source, doc_id, unnest(string_split('Report of ' || source || ' no. ' || doc_id || chr(10) || text, chr(10))) AS t FROM documents"


def _lines(documents: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Report of "), "source", F.lit(" no. "), "doc_id", F.lit("\n"), "text")
    return documents.select("source", "doc_id", F.explode(F.split(text, "\n")).alias("t"))


@add(f"""WITH l AS ({_LINES}), s AS (SELECT source, doc_id, {X.signature('t', DUCK)} AS sig FROM l), p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM s GROUP BY 1),
  n AS (SELECT source, sig, count(DISTINCT doc_id) AS seen FROM s WHERE length(sig) > 0 GROUP BY 1, 2)
  SELECT source, sig, seen, pages FROM n JOIN p USING (source) WHERE seen >= greatest(2, ceil(pages * 0.4))""", "documents")
def running_lines(documents: DataFrame) -> DataFrame:
    lines = _lines(documents).withColumn("sig", F.expr(X.signature("t", SPARK)))
    return C.running_lines(lines, "source", "doc_id", "sig")


@add(f"""WITH l AS ({_LINES}), s AS (SELECT source, doc_id, {X.signature('t', DUCK)} AS sig FROM l), p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM s GROUP BY 1),
  f AS (SELECT source, sig FROM (SELECT source, sig, count(DISTINCT doc_id) AS seen FROM s WHERE length(sig) > 0 GROUP BY 1, 2) JOIN p USING (source) WHERE seen >= greatest(2, ceil(pages * 0.4)))
  SELECT doc_id, count(*) AS kept FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.source = s.source AND f.sig = s.sig) GROUP BY 1""", "documents")
def furniture_removed(documents: DataFrame) -> DataFrame:
    lines = _lines(documents).withColumn("sig", F.expr(X.signature("t", SPARK)))
    furniture = C.running_lines(lines, "source", "doc_id", "sig").select("source", "sig")
    return lines.join(furniture, ["source", "sig"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@add("""WITH v AS (SELECT o_custkey % 50 AS run, (o_orderkey % 7) + CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE 0 END - (o_orderkey % 7) AS off FROM orders),
  c AS (SELECT run, off AS "offset", count(*) AS votes FROM v GROUP BY 1, 2), r AS (SELECT *, sum(votes) OVER (PARTITION BY run) AS sampled, row_number() OVER (PARTITION BY run ORDER BY votes DESC, "offset") AS r FROM c)
  SELECT run, "offset", votes, sampled::BIGINT AS sampled FROM r WHERE r = 1 AND votes >= greatest(3, ceil(sampled * 0.3))""", "orders")
def page_offset_vote(orders: DataFrame) -> DataFrame:
    v = orders.select((F.col("o_custkey") % 50).alias("run"), (F.col("o_orderkey") % 7).alias("i"), (F.col("o_orderkey") % 7 + F.when(F.col("o_orderkey") % 3 == 0, 5).otherwise(0)).alias("n"))
    return C.offset_vote(v, ["run"], "n", "i")


@add("""SELECT conv_id, min(turn + conv_id % 3 - turn) AS "offset", count(*) AS seen FROM conversations GROUP BY 1 HAVING count(*) >= 2""", "conversations")
def offset_proof(conversations: DataFrame) -> DataFrame:
    return C.constant_offsets(conversations.withColumn("n", F.col("turn") + F.col("conv_id") % 3), ["conv_id"], "n", "turn")


def _points(code: str) -> str:
    words = "|".join(C.FUNCTION_WORDS[code])
    marks = f" + len(regexp_extract_all(t, '[{C.MARKER_LETTERS[code]}]'))" if C.MARKER_LETTERS[code] else ""
    return f"2 * len(regexp_extract_all(w, ' (?:{words}) ')){marks}"


@add(f"""WITH d AS (SELECT doc_id, lower(text) AS t, ' ' || regexp_replace(lower(text), '[\\s.,]+', '  ', 'g') || ' ' AS w FROM documents),
  p AS (SELECT doc_id, {', '.join(f"({_points(c)})::BIGINT AS {c}" for c in C.FUNCTION_WORDS)} FROM d)
  SELECT doc_id, greatest(en, fr, de, es) AS points, CASE WHEN greatest(en, fr, de, es) < 4 THEN NULL WHEN en = greatest(en, fr, de, es) THEN 'en' WHEN fr = greatest(en, fr, de, es) THEN 'fr'
  WHEN de = greatest(en, fr, de, es) THEN 'de' ELSE 'es' END AS language FROM p""", "documents")
def language_vote(documents: DataFrame) -> DataFrame:
    return C.language_vote(documents, "doc_id", "text")


@add("""WITH d AS (SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN repeat('שלום ', 9000) WHEN 1 THEN 'かな漢字' WHEN 2 THEN '한국어' WHEN 3 THEN '漢字' || repeat('漢', 90) || 'か' ELSE '' END AS t FROM documents),
  n AS (SELECT doc_id, len(regexp_extract_all(t, '[\\x{0590}-\\x{08FF}]')) AS r, len(regexp_extract_all(t, '\\p{L}')) AS l, len(regexp_extract_all(t, '[\\x{3040}-\\x{30FF}]')) AS k, len(regexp_extract_all(t, '[\\x{AC00}-\\x{D7AF}]')) AS g, len(regexp_extract_all(t, '[\\x{4E00}-\\x{9FFF}]')) AS h FROM d)
  SELECT doc_id, r * 2 > l AS rtl, CASE WHEN k + g + h = 0 THEN NULL WHEN k > 0 AND k / (h + g + 0.0) >= 0.05 THEN 'ja' WHEN g >= 0.2 * greatest(h, 1) THEN 'ko' ELSE 'zh' END AS cjk FROM n""", "documents")
def script_direction(documents: DataFrame) -> DataFrame:
    more = F.expr("CASE doc_id % 6 WHEN 0 THEN repeat('שלום ', 9000) WHEN 1 THEN 'かな漢字' WHEN 2 THEN '한국어' WHEN 3 THEN concat('漢字', repeat('漢', 90), 'か') ELSE '' END")
    text = F.concat(F.col("text"), more)
    return documents.select("doc_id", C.right_to_left(text).alias("rtl"), C.cjk_language(text).alias("cjk"))


@add(f"""WITH l AS ({_LINES}) SELECT source, sum(CASE WHEN regexp_matches(t, '\\p{{L}}-$') THEN 1 ELSE 0 END)::BIGINT AS hyphens, count(*) AS lines,
  sum(CASE WHEN regexp_matches(t, '\\p{{L}}-$') THEN 1 ELSE 0 END) >= 3 AND sum(CASE WHEN regexp_matches(t, '\\p{{L}}-$') THEN 1 ELSE 0 END) * 50 > count(*) AS auto FROM l GROUP BY 1""", "documents")
def auto_hyphen(documents: DataFrame) -> DataFrame:
    return C.auto_hyphenated(_lines(documents), ["source"], "t")


@add("""SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, 'an ', 'an-' || chr(10)), '­\n?', '', 'g'), '(\\p{L})-\n(\\p{Ll})', '\\1\\2', 'g')) AS joined FROM documents""", "documents")
def dehyphenate(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.md5(C.dehyphenate(F.replace(F.col("text"), F.lit("an "), F.lit("an-\n")))).alias("joined"))


@add("""WITH p AS (SELECT o_custkey % 40 AS book, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) - 1 AS page, count(*) OVER (PARTITION BY o_custkey % 40) AS pages FROM orders),
  s AS (SELECT b.book, floor(20 + (b.pages - 25) * k / 16)::BIGINT AS at FROM (SELECT DISTINCT book, pages FROM p) b, generate_series(1, 15) g(k))
  SELECT book, o_orderkey, page::INT AS page FROM p WHERE pages <= 40 OR page < 20 OR page >= pages - 5 OR EXISTS (SELECT 1 FROM s WHERE s.book = p.book AND (s.at = p.page OR s.at = p.page - 1))""", "orders")
def page_sample(orders: DataFrame) -> DataFrame:
    return C.page_sample(orders.withColumn("book", F.col("o_custkey") % 40), ["book"], ["o_orderkey"]).select("book", "o_orderkey", "page")


def _cells(lineitem: DataFrame) -> DataFrame:
    df = lineitem.withColumn("t", F.expr(number_text())).withColumn("dt", F.expr(date_text()))
    df = df.withColumn("c", F.expr(N.clean("t"))).withColumn("b", F.expr(N.bare("c"))).withColumn("code", F.expr(N.is_code("b"))).withColumn("kind", F.expr(f"CASE WHEN NOT code THEN {N.shape('b')} END"))
    return df.withColumn("proof", F.expr(N.evidence("b", "kind"))).withColumn("way", F.expr(D.order_proof("dt"))).withColumn("grp", F.col("l_suppkey") % 20)


_DUCK_CELLS = f"""a AS (SELECT *, {number_text()} AS t, {date_text()} AS dt FROM lineitem), c1 AS (SELECT *, {N.clean('t', DUCK)} AS c FROM a), c2 AS (SELECT *, {N.bare('c', DUCK)} AS b FROM c1),
  c3 AS (SELECT *, {N.is_code('b', DUCK)} AS code FROM c2), c4 AS (SELECT *, CASE WHEN NOT code THEN {N.shape('b', DUCK)} END AS kind FROM c3),
  cells AS (SELECT *, l_suppkey % 20 AS grp, {N.evidence('b', 'kind', DUCK)} AS proof, {D.order_proof('dt', DUCK)} AS way FROM c4)"""
_VOTES = "sum(CASE WHEN proof = 'POINT' THEN 1 ELSE 0 END) AS p, sum(CASE WHEN proof = 'COMMA' THEN 1 ELSE 0 END) AS c, sum(CASE WHEN way = 'MDY' THEN 1 ELSE 0 END) AS m, sum(CASE WHEN way = 'DMY' THEN 1 ELSE 0 END) AS d, sum(CASE WHEN contains(t, '$') THEN 1 ELSE 0 END) AS usd, sum(CASE WHEN regexp_matches(t, '[£€]') THEN 1 ELSE 0 END) AS eur"
_PICK = """CASE WHEN p > c THEN 'POINT' WHEN c > p THEN 'COMMA' ELSE 'UNKNOWN' END AS mark, CASE WHEN m > d THEN 'MDY' WHEN d > m THEN 'DMY' WHEN usd > eur THEN 'MDY' WHEN eur > usd THEN 'DMY' ELSE 'UNKNOWN' END AS "order" """


@add(f"""WITH {_DUCK_CELLS}, v AS (SELECT grp, l_linenumber, {_VOTES} FROM cells GROUP BY 1, 2) SELECT grp, l_linenumber, p::BIGINT AS n_point, c::BIGINT AS n_comma, {_PICK} FROM v""", "lineitem")
def column_conventions(lineitem: DataFrame) -> DataFrame:
    v = T.conventions(_cells(lineitem), ["grp", "l_linenumber"], F.col("proof"), F.col("way"), F.col("t"))
    return v.select("grp", "l_linenumber", "n_point", "n_comma", "mark", "order")


@add(f"""WITH {_DUCK_CELLS}, v AS (SELECT grp, l_linenumber, {_VOTES} FROM cells GROUP BY 1, 2), col AS (SELECT *, {_PICK} FROM v), dv AS (SELECT grp, {_VOTES} FROM cells GROUP BY 1), doc AS (SELECT grp, {_PICK} FROM dv)
  SELECT grp, l_linenumber, CASE WHEN col.mark <> 'UNKNOWN' AND (doc.mark = 'UNKNOWN' OR col.mark = doc.mark OR greatest(p, c) >= 2) THEN col.mark ELSE doc.mark END AS mark,
  CASE WHEN col."order" <> 'UNKNOWN' THEN col."order" ELSE doc."order" END AS "order" FROM col JOIN doc USING (grp)""", "lineitem")
def prior_conventions(lineitem: DataFrame) -> DataFrame:
    cells = _cells(lineitem)
    votes = lambda by: T.conventions(cells, by, F.col("proof"), F.col("way"), F.col("t"))
    return T.inherit(votes(["grp", "l_linenumber"]), votes(["grp"]), ["grp"]).select("grp", "l_linenumber", "mark", "order")


@add(f"""WITH {_DUCK_CELLS}, v AS (SELECT l_suppkey, sum(CASE WHEN kind IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS numbers, sum(CASE WHEN code THEN 1 ELSE 0 END)::BIGINT AS codes,
  sum(CASE WHEN regexp_matches(c, '^[a-z]') THEN 1 ELSE 0 END)::BIGINT AS words, count(*) AS filled FROM cells GROUP BY 1)
  SELECT *, CASE WHEN codes >= 0.2 * filled OR words >= 0.6 * filled THEN 'text' WHEN numbers * 2 > filled THEN 'number' ELSE 'text' END AS type FROM v""", "lineitem")
def typed_columns(lineitem: DataFrame) -> DataFrame:
    return T.typed_columns(_cells(lineitem), ["l_suppkey"], F.col("kind").isNotNull(), F.col("code"), F.col("c").rlike("^[a-z]"), F.lit(True))


_GRID = "SELECT o_custkey AS t, (o_orderkey % 5)::INT AS row, c::INT AS col, CASE WHEN c = 0 THEN o_orderpriority WHEN o_orderkey % 5 = 0 THEN 'head' || c WHEN o_orderkey % 4 = 0 THEN '' ELSE (floor(o_totalprice)::INT)::VARCHAR END AS x FROM orders, generate_series(0, 2) g(c)"


def _grid(orders: DataFrame) -> DataFrame:
    price = F.expr("cast(cast(floor(o_totalprice) AS INT) AS STRING)")
    return orders.select(F.col("o_custkey").alias("t"), (F.col("o_orderkey") % 5).cast("int").alias("row"), "o_orderkey", "o_orderpriority", price.alias("p"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("col")).select(
        "t", "row", "col", F.when(F.col("col") == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("head"), "col")).when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("p")).alias("x"))


@add(f"""WITH g AS ({_GRID}), n AS (SELECT *, regexp_matches(x, '^[0-9]+$') AS num FROM g),
  p AS (SELECT t, col, max(CASE WHEN row = 0 AND NOT num AND length(x) > 0 THEN 1 ELSE 0 END) AS label, max(CASE WHEN row = 0 AND num THEN 1 ELSE 0 END) AS numeric, sum(CASE WHEN row > 0 AND length(x) > 0 THEN 1 ELSE 0 END) AS filled,
    sum(CASE WHEN row > 0 AND num THEN 1 ELSE 0 END) AS numbers, max(row) AS last FROM n GROUP BY 1, 2)
  SELECT t, max(numeric) = 0 AND sum(label) >= 2 AND max(last) >= 2 AND max(CASE WHEN label = 1 AND filled > 0 AND numbers * 2 >= filled THEN 1 ELSE 0 END) = 1 AS header FROM p GROUP BY 1""", "orders")
def infer_header(orders: DataFrame) -> DataFrame:
    return T.inferred_header(_grid(orders), ["t"], "row", "col", "x", F.col("x").rlike("^[0-9]+$"))


@add(f"""WITH g AS ({_GRID}), f AS (SELECT t, col, sum(CASE WHEN length(trim(x)) > 0 THEN 1 ELSE 0 END) AS c FROM g GROUP BY 1, 2) SELECT t, arg_min(col, -c * 10 + col) AS key_column FROM f GROUP BY 1""", "orders")
def key_column(orders: DataFrame) -> DataFrame:
    return T.key_column(_grid(orders), ["t"], "col", "x")


@add(f"""WITH g AS ({_GRID}), f AS (SELECT t, row FROM g WHERE col > 0 GROUP BY 1, 2 HAVING bool_or(length(trim(x)) > 0)), k AS (SELECT t, row, row_number() OVER (PARTITION BY t ORDER BY row) - 1 AS line FROM f)
  SELECT t, row, col, x, line::INT AS line FROM g JOIN k USING (t, row) WHERE col > 0""", "orders")
def drop_empty_lines(orders: DataFrame) -> DataFrame:
    return T.drop_empty_lines(_grid(orders).where("col > 0"), ["t"], "row", "x", "line").select("t", "row", "col", "x", "line")


@add("""WITH p AS (SELECT p_brand, p_partkey, len(string_split(p_name, ' ')) + (p_partkey % 5 = 0)::INT AS n FROM part), c AS (SELECT p_brand, n, count(*) AS r FROM p GROUP BY 1, 2),
  b AS (SELECT p_brand, arg_min(n, -r * 100 + n) AS pieces, max(r) AS agree, sum(r)::BIGINT AS rows FROM c GROUP BY 1) SELECT * FROM b WHERE pieces >= 2 AND agree >= 2 AND agree >= 0.6 * rows""", "part")
def split_plan(part: DataFrame) -> DataFrame:
    return T.split_plan(part.withColumn("n", (F.size(F.split("p_name", " ")) + (F.col("p_partkey") % 5 == 0).cast("int"))), ["p_brand"], "p_partkey", "n")


_ORDERED = "SELECT o_custkey AS t, o_orderkey AS page, 3 + o_orderkey % 2 AS cols, 400.0 + o_orderkey % 9 AS width, 72.0 + o_orderkey % 4 * 5 AS lft FROM orders"


@add(f"""WITH o AS ({_ORDERED}), l AS (SELECT *, lag(cols) OVER w AS c, lag(width) OVER w AS wd, lag(lft) OVER w AS lf FROM o WINDOW w AS (PARTITION BY t ORDER BY page))
  SELECT t, page, (sum(CASE WHEN c = cols AND abs(width - wd) <= greatest(6, abs(width) * 0.1) AND abs(lft - lf) <= 12 THEN 0 ELSE 1 END) OVER (PARTITION BY t ORDER BY page))::BIGINT AS run FROM l""", "orders")
def continuation_runs(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    o = orders.select(F.col("o_custkey").alias("t"), k.alias("page"), (3 + k % 2).alias("cols"), (400.0 + k % 9).alias("width"), (72.0 + k % 4 * 5).alias("lft"))
    return T.runs(o, ["t"], ["page"], T.continues(["t"], ["page"], "cols", "width", "lft")).select("t", "page", "run")


@add("""WITH h AS (SELECT o_custkey, o_orderkey, lower(trim(regexp_replace(o_orderpriority, '\\s+', ' ', 'g'))) AS x, row_number() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
  f AS (SELECT *, first_value(x) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS head FROM h) SELECT o_custkey, o_orderkey FROM f WHERE r = 1 OR x <> head""", "orders")
def repeated_headers(orders: DataFrame) -> DataFrame:
    return T.repeated_headers(orders, ["o_custkey"], ["o_orderkey"], "o_orderpriority").select("o_custkey", "o_orderkey")


@add("""WITH m AS (SELECT c_nationkey, list_sort(list(c_acctbal))[(count(*) // 2 + 1)::INT] AS med FROM customer GROUP BY 1),
  t AS (SELECT c_nationkey, c_custkey, c_mktsegment = 'BUILDING' AND c_acctbal >= 1.25 * med AS title FROM customer JOIN m USING (c_nationkey))
  SELECT c_nationkey, c_custkey, (sum(CASE WHEN title THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey ORDER BY c_custkey))::BIGINT AS part FROM t""", "customer")
def split_tables(customer: DataFrame) -> DataFrame:
    return T.split_at_titles(customer, ["c_nationkey"], ["c_custkey"], "c_acctbal", F.col("c_mktsegment") == "BUILDING").select("c_nationkey", "c_custkey", "part")


_PIPES = "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), n AS (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS line, unnest(ls) AS t FROM l), p AS (SELECT doc_id, line, string_split(t, ' | ') AS cs FROM n WHERE contains(t, ' | ')), cells AS (SELECT doc_id, line, unnest(generate_series(0, len(cs) - 1)) AS col, unnest(cs) AS cell FROM p)"


@add(_PIPES + " SELECT doc_id, line::INT AS line, col::INT AS col, cell FROM cells", "documents")
def pipe_cells(documents: DataFrame) -> DataFrame:
    return T.pipe_cells(documents, "doc_id", "text")


@add(_PIPES + """, w AS (SELECT doc_id, max(col) + 1 AS width FROM cells GROUP BY 1)
  SELECT doc_id, line::INT AS row, '| ' || string_agg(coalesce(replace(cell, '|', '\\|'), ''), ' | ' ORDER BY col) || repeat(' | ', (max(width) - count(*))::INT) || ' |' AS line FROM cells JOIN w USING (doc_id) GROUP BY doc_id, cells.line""", "documents")
def pipe_tables(documents: DataFrame) -> DataFrame:
    return T.pipe_table(T.pipe_cells(documents, "doc_id", "text").withColumnRenamed("line", "row"), ["doc_id"], "row", "col", "cell")


@add(_PIPES + """, r AS (SELECT doc_id, line, sum(len(string_split_regex(trim(cell), '\\s+'))) AS words, arg_min(cell, col) AS f, max(regexp_matches(cell, '[.!?] ')::INT) AS ends FROM cells GROUP BY 1, 2)
  SELECT doc_id, count(*) >= 2 AND avg(words) >= 3 AND avg(CASE WHEN regexp_matches(f, '^\\p{Ll}') THEN 1.0 ELSE 0.0 END) >= 0.5 AND max(ends) = 1 AS prose FROM r GROUP BY 1""", "documents")
def prose_tables(documents: DataFrame) -> DataFrame:
    return T.prose_like(T.pipe_cells(documents, "doc_id", "text"), ["doc_id"], "line", "cell").select("doc_id", "prose")


@add("""WITH i AS (SELECT o_custkey, o_orderkey, (o_orderkey % 3 + 1)::INT AS lv FROM orders),
  r AS (SELECT *, sum((lv < 1)::INT) OVER w AS r1, sum((lv < 2)::INT) OVER w AS r2, sum((lv < 3)::INT) OVER w AS r3 FROM i WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
  n AS (SELECT *, sum((lv = 1)::INT) OVER (PARTITION BY o_custkey, r1 ORDER BY o_orderkey) AS n1, sum((lv = 2)::INT) OVER (PARTITION BY o_custkey, r2 ORDER BY o_orderkey) AS n2, sum((lv = 3)::INT) OVER (PARTITION BY o_custkey, r3 ORDER BY o_orderkey) AS n3 FROM r)
  SELECT o_custkey, o_orderkey, greatest(n1, 1)::VARCHAR || CASE WHEN lv >= 2 THEN '.' || greatest(n2, 1) ELSE '' END || CASE WHEN lv >= 3 THEN '.' || greatest(n3, 1) ELSE '' END AS label FROM n""", "orders")
def list_numbering(orders: DataFrame) -> DataFrame:
    items = orders.select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 3 + 1).cast("int").alias("lv"))
    return T.list_labels(items, ["o_custkey"], ["o_orderkey"], "lv").select("o_custkey", "o_orderkey", "label")


_BOXES = "SELECT p_partkey AS box_id, p_partkey % 20 AS page, (p_partkey % 97) * 10.0 AS \"left\", (p_partkey % 97) * 10.0 + p_size AS \"right\", 0.0 AS top, p_size * 2.0 AS bottom FROM part"
_POINTS = "SELECT l_orderkey, l_linenumber, l_suppkey % 20 AS page, l_extendedprice % 1000 AS x, l_quantity AS y FROM lineitem"


def _boxes(part: DataFrame) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return part.select(k.alias("box_id"), (k % 20).alias("page"), ((k % 97) * 10.0).alias("left"), ((k % 97) * 10.0 + s).alias("right"), F.lit(0.0).alias("top"), (s * 2.0).alias("bottom"))


def _points_of(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 20).alias("page"), (F.col("l_extendedprice") % 1000).alias("x"), F.col("l_quantity").alias("y"))




@add(f"""WITH b AS ({_BOXES}), p AS (SELECT DISTINCT * FROM ({_POINTS})), h AS (SELECT p.*, box_id, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, p.page, x, y ORDER BY ("right" - "left") * (bottom - top), box_id) AS r
  FROM p JOIN b ON p.page = b.page AND x BETWEEN "left" AND "right" AND y BETWEEN top AND bottom)
  SELECT box_id, count(*) AS n FROM h WHERE r = 1 GROUP BY 1""", "part", "lineitem")
def word_in_box(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    got = G.in_boxes(_points_of(lineitem), _boxes(part), "page", 50.0, ["l_orderkey", "l_linenumber", "page", "x", "y"])
    return got.where("box_id IS NOT NULL").groupBy("box_id").agg(F.count(F.lit(1)).alias("n"))


@add("SELECT l_orderkey, l_linenumber, greatest(0, least(3, len(list_filter([1.0, 10.0, 20.0, 35.0, 48.0], lambda e: e <= l_quantity)) - 1))::INT AS band FROM lineitem", "lineitem")
def band_lookup(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", G.band(F.array(*[F.lit(x) for x in (1.0, 10.0, 20.0, 35.0, 48.0)]), F.col("l_quantity")).cast("int").alias("band"))


_ACROSS = "SELECT s_suppkey AS across_id, s_suppkey % 5 AS page, s_acctbal % 300 AS y, s_acctbal % 100 AS x0, s_acctbal % 100 + 80 AS x1 FROM supplier"
_DOWN = "SELECT c_custkey AS down_id, c_custkey % 5 AS page, abs(c_acctbal) % 200 AS x, abs(c_acctbal) % 150 AS y0, abs(c_acctbal) % 150 + 60 AS y1 FROM customer"


def _rules(supplier: DataFrame, customer: DataFrame) -> tuple[DataFrame, DataFrame]:
    across = supplier.selectExpr("s_suppkey AS across_id", "s_suppkey % 5 AS page", "s_acctbal % 300 AS y", "s_acctbal % 100 AS x0", "s_acctbal % 100 + 80 AS x1")
    return across, customer.selectExpr("c_custkey AS down_id", "c_custkey % 5 AS page", "abs(c_acctbal) % 200 AS x", "abs(c_acctbal) % 150 AS y0", "abs(c_acctbal) % 150 + 60 AS y1")


@add(f"""WITH a AS ({_ACROSS}), d AS ({_DOWN}) SELECT a.page, across_id, down_id FROM a JOIN d ON a.page = d.page AND x BETWEEN x0 - 2.5 AND x1 + 2.5 AND y BETWEEN y0 - 2.5 AND y1 + 2.5""", "supplier", "customer")
def ruling_crossings(supplier: DataFrame, customer: DataFrame) -> DataFrame:
    return G.crossings(*_rules(supplier, customer), "page", 2.5, 25.0)


@add(f"""WITH a AS ({_ACROSS}), e AS (SELECT across_id AS edge_id, page, x0 AS s, x1 AS e FROM a), r AS (SELECT page, y, x0 + 10 AS rs, x0 + 14 + across_id % 3 AS re FROM a),
  p AS (SELECT page, x, sum(d) AS d FROM (SELECT page, rs AS x, 1 AS d FROM r UNION ALL SELECT page, re, -1 FROM r) GROUP BY 1, 2), q AS (SELECT page, x, sum(d) OVER (PARTITION BY page ORDER BY x) AS depth, lead(x) OVER (PARTITION BY page ORDER BY x) AS nx FROM p),
  cover AS (SELECT edge_id, e.page, e.s, e.e, coalesce(sum(greatest(0, least(e.e, nx) - greatest(e.s, x))), 0) AS len FROM e LEFT JOIN q ON q.page = e.page AND depth > 0 GROUP BY 1, 2, 3, 4)
  SELECT page, edge_id, len >= 0.6 * (e - s) - 1e-9 AS drawn FROM cover""", "supplier", "customer")
def ruling_cover(supplier: DataFrame, customer: DataFrame) -> DataFrame:
    a = _rules(supplier, customer)[0]
    edges = a.selectExpr("across_id AS edge_id", "page", "x0 AS start", "x1 AS end")
    return G.coverage(edges, a.selectExpr("page", "x0 + 10 AS r_start", "x0 + 14 + across_id % 3 AS r_end"), ["page"])


@add("""WITH i AS (SELECT user_id, value AS s, value + 3 AS e FROM events), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
  p AS (SELECT *, sum(CASE WHEN s <= reach + 3.5 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS part FROM m)
  SELECT user_id, part::BIGINT AS part, round(min(s), 6) AS s, round(max(e), 6) AS e, count(*) AS merged FROM p GROUP BY 1, 2""", "events")
def merge_rulings(events: DataFrame) -> DataFrame:
    i = events.select("user_id", F.col("value").alias("s"), (F.col("value") + 3).alias("e"))
    return G.merge_intervals(i, ["user_id"], "s", "e", 3.5).select("user_id", "part", F.round("s", 6).alias("s"), F.round("e", 6).alias("e"), "merged")


@add("""WITH s AS (SELECT l_suppkey, floor(l_extendedprice / 10) AS a, floor(l_extendedprice / 10) + l_quantity AS b FROM lineitem), ev AS (SELECT l_suppkey, x, sum(d) AS d FROM (SELECT l_suppkey, a AS x, 1 AS d FROM s UNION ALL SELECT l_suppkey, b, -1 FROM s) GROUP BY 1, 2),
  p AS (SELECT *, sum(d) OVER (PARTITION BY l_suppkey ORDER BY x) AS depth, lead(x) OVER (PARTITION BY l_suppkey ORDER BY x) AS nx FROM ev)
  SELECT l_suppkey, x AS gap_left, nx AS gap_right FROM p WHERE depth <= 0 AND nx IS NOT NULL AND nx - x >= 4""", "lineitem")
def column_gutters(lineitem: DataFrame) -> DataFrame:
    s = lineitem.select("l_suppkey", F.floor(F.col("l_extendedprice") / 10).cast("double").alias("a"), (F.floor(F.col("l_extendedprice") / 10) + F.col("l_quantity")).alias("b"))
    return G.gutters(s, ["l_suppkey"], "a", "b", 0, 4.0)


@add("""WITH g AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, l_quantity AS w, l_partkey FROM lineitem), l AS (SELECT *, x - lag(x + w) OVER (PARTITION BY l_orderkey ORDER BY x, l_partkey, l_linenumber) AS gap FROM g)
  SELECT l_orderkey, l_linenumber, x, (sum(CASE WHEN gap > w * 100 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY x, l_partkey, l_linenumber ROWS UNBOUNDED PRECEDING))::BIGINT AS word FROM l""", "lineitem")
def words_from_gaps(lineitem: DataFrame) -> DataFrame:
    g = lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("x"), F.col("l_quantity").alias("w"), "l_partkey")
    return G.words_from_gaps(g, ["l_orderkey"], ["x", "l_partkey", "l_linenumber"], "x", "w", F.col("w") * 100).select("l_orderkey", "l_linenumber", "x", "word")


@add(f"""WITH b AS ({_BOXES}) SELECT box_id FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.page = b.page AND o.box_id < b.box_id AND b."left" < o."right" AND o."left" < b."right" AND b.top < o.bottom AND o.top < b.bottom)""", "part")
def overlap_suppression(part: DataFrame) -> DataFrame:
    return G.suppress_overlaps(_boxes(part), "page", "box_id", 50.0).select("box_id")


#: All orders, each an edge between its customer and itself; orders are below zero, so that no id stands for both.
@add("""WITH RECURSIVE e AS (SELECT o_custkey AS a, -o_orderkey AS b FROM orders), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  r(node, root) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.root = u.a) SELECT node, min(root) AS root FROM r GROUP BY 1""", "orders")
def components(orders: DataFrame) -> DataFrame:
    return graph.connected_components(orders.selectExpr("o_custkey AS src", "-o_orderkey AS dst"))


#: All orders with customers and orders as nodes of one kind: long chains and large components, too many pairs for recursive SQL.
@add(None, "orders")
def components_chained(orders: DataFrame) -> DataFrame:
    return graph.connected_components(orders.selectExpr("o_custkey AS src", "o_orderkey AS dst"))


@add("SELECT p_partkey, p_type, (dense_rank() OVER (ORDER BY p_type) - 1)::INT AS code FROM part", "part")
def dictionary_encode(part: DataFrame) -> DataFrame:
    codes = part.select("p_type").distinct().withColumn("code", F.row_number().over(Window.orderBy("p_type")) - 1)
    return part.join(codes, "p_type").select("p_partkey", "p_type", "code")


@add("""SELECT c_custkey, CASE WHEN r = 1 THEN c_mktsegment ELSE c_mktsegment || ' (' || r || ')' END AS name FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS r FROM customer)""", "customer")
def unique_names(customer: DataFrame) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("c_mktsegment", "c_nationkey").orderBy("c_custkey"))
    return customer.withColumn("r", r).select("c_custkey", F.when(F.col("r") == 1, F.col("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit(" ("), "r", F.lit(")"))).alias("name"))


@add("SELECT c_name, count(*) > 1 AS collides FROM (SELECT lower(c_mktsegment) || c_nationkey AS c_name FROM customer) GROUP BY 1", "customer")
def name_collisions(customer: DataFrame) -> DataFrame:
    return customer.groupBy(F.concat(F.lower("c_mktsegment"), "c_nationkey").alias("c_name")).agg((F.count(F.lit(1)) > 1).alias("collides"))


@add("""WITH m AS (SELECT o_custkey, bool_and(c_custkey IS NOT NULL) AS whole FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 GROUP BY 1)
  SELECT o_orderkey, o_custkey, whole FROM orders JOIN m USING (o_custkey)""", "orders", "customer")
def footnote_join(orders: DataFrame, customer: DataFrame) -> DataFrame:
    notes = customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("hit"))
    whole = orders.join(notes, "o_custkey", "left").groupBy("o_custkey").agg(F.bool_and(F.col("hit").isNotNull()).alias("whole"))
    return orders.join(whole, "o_custkey").select("o_orderkey", "o_custkey", "whole")


@add("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", "customer", "orders")
def leftover_notes(customer: DataFrame, orders: DataFrame) -> DataFrame:
    return customer.join(orders.where("o_totalprice > 400000"), customer.c_custkey == orders.o_custkey, "left_anti").select("c_custkey")


@add("""WITH RECURSIVE t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey // 5 END AS base, CASE WHEN p_size % 3 = 0 THEN p_size END AS size FROM part),
  r(id, base, size) AS (SELECT id, base, size FROM t UNION ALL SELECT r.id, t.base, t.size FROM r JOIN t ON r.base = t.id WHERE r.size IS NULL) SELECT id, max(size)::INT AS size FROM r GROUP BY 1""", "part")
def style_inheritance(part: DataFrame) -> DataFrame:
    styles = part.select(F.col("p_partkey").alias("id"), F.expr("CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey div 5 END").alias("base"), F.expr("CASE WHEN p_size % 3 = 0 THEN p_size END").alias("size"))
    return graph.inherited(styles, "id", "base", "size")


@add("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS line, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 7)::INT AS page FROM documents", "documents")
def line_numbers(documents: DataFrame) -> DataFrame:
    line = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return documents.select("doc_id", line.alias("line"), F.floor((line - 1) / 7).cast("int").alias("page"))


@add("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10 AS kept FROM documents", "documents")
def page_limit(documents: DataFrame) -> DataFrame:
    return documents.select("source", "doc_id", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) <= 10).alias("kept"))


@add("SELECT doc_id FROM documents WHERE doc_id + 1 BETWEEN 10 AND 500", "documents")
def page_range(documents: DataFrame) -> DataFrame:
    return documents.where((F.col("doc_id") + 1).between(10, 500)).select("doc_id")


@add("""WITH h AS (SELECT conv_id, turn, role = 'user' AS head, length(text) AS n FROM conversations) SELECT conv_id, turn, (sum(head::INT) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS chapter FROM h""", "conversations")
def chapters(conversations: DataFrame) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return conversations.select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).alias("chapter"))


@add("SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) > 4 * sum(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) AS dominates FROM lineitem GROUP BY 1", "lineitem")
def hidden_dominates(lineitem: DataFrame) -> DataFrame:
    hidden = F.col("l_returnflag") == "N"
    return lineitem.groupBy("l_orderkey").agg((F.sum(F.when(hidden, 1).otherwise(0)) > 4 * F.sum(F.when(~hidden, 1).otherwise(0))).alias("dominates"))


@add("""SELECT l_suppkey, round(max(l_extendedprice + l_quantity - l_extendedprice), 4) AS width, max(l_linenumber) AS cols FROM lineitem GROUP BY 1""", "lineitem")
def column_width(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_suppkey").agg(F.round(F.max(F.col("l_extendedprice") + F.col("l_quantity") - F.col("l_extendedprice")), 4).alias("width"), F.max("l_linenumber").alias("cols"))


@add("SELECT source, count(DISTINCT lower(lang)) AS langs, count(*) AS docs FROM documents GROUP BY 1", "documents")
def distinct_texts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("source").agg(F.countDistinct(F.lower("lang")).alias("langs"), F.count(F.lit(1)).alias("docs"))


@add("""WITH l AS (SELECT l_partkey AS page, l_orderkey * 10 + l_linenumber AS id, floor(l_extendedprice)::BIGINT % 400 AS b, l_quantity AS q, l_linenumber % 2 = 0 AS wide, l_returnflag = 'R' AND l_linestatus = 'F' AS running, l_returnflag = 'A' AND l_linenumber = 1 AS flow, concat('w', l_suppkey) AS text FROM lineitem WHERE l_quantity * 2 + 6 <= 94),
  n AS (SELECT *, CASE WHEN b - lag(b) OVER (PARTITION BY page ORDER BY b, id) <= 2 THEN 0 ELSE 1 END AS new FROM l), g AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY b, id ROWS UNBOUNDED PRECEDING) AS band FROM n),
  w AS (SELECT page, band, x, text, CASE WHEN x + 3 < 30 THEN 0 WHEN x + 3 < 60 THEN 1 ELSE 2 END AS col FROM (SELECT page, band, q * 2 AS x, text FROM g UNION ALL SELECT page, band, q, '+' || text FROM g WHERE wide)),
  c AS (SELECT *, (top + bottom) / 2 AS centre, CASE WHEN (top + bottom) / 2 < 100 THEN 'above' WHEN (top + bottom) / 2 > 180 THEN 'below' ELSE 'inside' END AS side FROM (
    SELECT page, band, min(b) - 10 AS top, max(b) + 2 AS bottom, count(*) > 1 OR bool_or(wide) AS tab, bool_or(running) AS running, bool_or(flow) AS flow FROM g GROUP BY 1, 2) JOIN (SELECT page, band, count(DISTINCT col) AS filled FROM w GROUP BY 1, 2) USING (page, band)),
  o AS (SELECT *, CASE side WHEN 'above' THEN -centre ELSE centre END AS far FROM c),
  k AS (SELECT *, row_number() OVER z AS nth, CASE side WHEN 'inside' THEN true WHEN 'above' THEN coalesce(lag(top) OVER z, 100) - bottom <= 32 AND filled >= 2 AND tab AND NOT flow
    ELSE top - coalesce(lag(bottom) OVER z, 180) <= 32 AND NOT (running AND (filled < 2 OR NOT tab)) AND NOT (flow AND filled < 2) END AS ok FROM o WINDOW z AS (PARTITION BY page, side ORDER BY far, band)),
  h AS (SELECT *, min(ok::INT) OVER (PARTITION BY page, side ORDER BY far, band ROWS UNBOUNDED PRECEDING) AS kept FROM k),
  m AS (SELECT *, sum((side = 'above')::INT) OVER (PARTITION BY page) AS more FROM h WHERE kept = 1),
  r AS (SELECT page, band, side, CASE side WHEN 'above' THEN more - nth WHEN 'below' THEN more + 4 + nth - 1 ELSE more + CASE WHEN centre < 120 THEN 0 WHEN centre < 140 THEN 1 WHEN centre < 160 THEN 2 ELSE 3 END END::INT AS row FROM m)
  SELECT page, side, row, col::INT AS col, string_agg(text, ' ' ORDER BY band, x, text) AS text FROM r JOIN w USING (page, band) GROUP BY 1, 2, 3, 4""", "part", "lineitem")
def restored_rows(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    tables = part.select(F.col("p_partkey").alias("page"), F.lit(0).alias("box_id"), F.array(*[F.lit(v) for v in (0.0, 30.0, 60.0, 90.0)]).alias("xs"), F.array(*[F.lit(v) for v in (100.0, 120.0, 140.0, 160.0, 180.0)]).alias("ys"))
    word = lambda x, text: F.struct(x.cast("double").alias("x"), (x + 6).cast("double").alias("right"), text.alias("text"))
    q, base, wide = F.col("l_quantity"), (F.floor("l_extendedprice") % 400).cast("double"), F.col("l_linenumber") % 2 == 0
    lines = lineitem.select(
        F.col("l_partkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"), (base - 10).alias("top"), (base + 2).alias("bottom"), base.alias("baseline"),
        F.when(wide, F.array(word(q, F.concat(F.lit("+w"), "l_suppkey")), word(q * 2, F.concat(F.lit("w"), "l_suppkey")))).otherwise(F.array(word(q * 2, F.concat(F.lit("w"), "l_suppkey")))).alias("words"),
        wide.alias("wide"), F.expr("l_returnflag = 'R' AND l_linestatus = 'F'").alias("running"), F.expr("l_returnflag = 'A' AND l_linenumber = 1").alias("flow"),
    )
    return detect.restored_rows(tables, lines, "page").drop("box_id")
