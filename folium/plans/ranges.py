"""Queries on rules over ranges and on chart statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folium.operators import charts as C
from folium.operators import ranges as R
from folium.plans.base import Catalogue

catalogue = Catalogue()
add = catalogue.add


@add("""SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM
  (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS r FROM lineitem) WHERE r <= 10""", "lineitem")
def cf_top10(lineitem: DataFrame) -> DataFrame:
    return R.top_n(lineitem, ["l_returnflag"], "l_extendedprice", 10).select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")


@add("""SELECT o_orderpriority, o_orderkey, o_totalprice FROM
  (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
  WHERE r <= greatest(1, floor(n * 3 / 100))""", "orders")
def cf_bottom_percent(orders: DataFrame) -> DataFrame:
    return R.top_n(orders, ["o_orderpriority"], "o_totalprice", 3, percent=True, bottom=True).select("o_orderpriority", "o_orderkey", "o_totalprice")


@add("""SELECT c.c_custkey, c.c_mktsegment, round(s.m + s.d, 4) AS bound FROM customer c JOIN
  (SELECT c_mktsegment, avg(c_acctbal) AS m, coalesce(stddev_samp(c_acctbal), 0) AS d FROM customer GROUP BY 1) s USING (c_mktsegment)
  WHERE c.c_acctbal > s.m + s.d""", "customer")
def cf_above_average(customer: DataFrame) -> DataFrame:
    return R.above_average(customer, ["c_mktsegment"], "c_acctbal", 1.0).select("c_custkey", "c_mktsegment", F.round("bound", 4).alias("bound"))


@add("""SELECT c.c_custkey, c.c_nationkey FROM customer c JOIN (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1) s USING (c_nationkey)
  WHERE c.c_acctbal <= s.m""", "customer")
def cf_below_or_equal_average(customer: DataFrame) -> DataFrame:
    return R.above_average(customer, ["c_nationkey"], "c_acctbal", below=True, equal=True).select("c_custkey", "c_nationkey")


@add("""SELECT p_partkey, p_type, count(*) OVER (PARTITION BY lower(p_type)) AS seen FROM part QUALIFY seen > 1""", "part")
def cf_duplicates(part: DataFrame) -> DataFrame:
    return R.occurrences(part, [], R.identity(F.col("p_type"), F.lit(None).cast("double"))).where("seen > 1").select("p_partkey", "p_type", "seen")


@add("""SELECT c_custkey, c_name FROM customer QUALIFY count(*) OVER (PARTITION BY lower(c_name)) = 1""", "customer")
def cf_unique(customer: DataFrame) -> DataFrame:
    return R.occurrences(customer, [], R.identity(F.col("c_name"), F.lit(None).cast("double"))).where("seen = 1").select("c_custkey", "c_name")


@add("""SELECT l_orderkey, l_linenumber, l_quantity, l_quantity BETWEEN 10 AND 20 AS inside, NOT (l_quantity BETWEEN 10 AND 20) AS outside, l_quantity > 45 AS over FROM lineitem""", "lineitem")
def cf_cell_is(lineitem: DataFrame) -> DataFrame:
    q = F.col("l_quantity")
    return lineitem.select("l_orderkey", "l_linenumber", "l_quantity", R.cell_is(q, "between", F.lit(20), F.lit(10)).alias("inside"), R.cell_is(q, "notBetween", F.lit(20), F.lit(10)).alias("outside"), R.cell_is(q, "greaterThan", F.lit(45)).alias("over"))


@add("""SELECT p_partkey, contains(lower(p_type), 'brass') AS has, NOT contains(lower(p_type), 'tin') AS lacks, starts_with(lower(p_type), 'promo') AS begins, ends_with(lower(p_type), 'steel') AS ends,
  coalesce(regexp_replace(p_type, '\\s', '', 'g'), '') = '' AS blank FROM part""", "part")
def cf_text_rules(part: DataFrame) -> DataFrame:
    t = F.col("p_type")
    return part.select("p_partkey", R.text_rule(t, "containsText", "Brass").alias("has"), R.text_rule(t, "notContainsText", "TIN").alias("lacks"), R.text_rule(t, "beginsWith", "promo").alias("begins"), R.text_rule(t, "endsWith", "STEEL").alias("ends"), R.text_rule(t, "containsBlanks").alias("blank"))


@add("""SELECT l_linenumber, min(l_extendedprice)::DOUBLE AS p_min, max(l_extendedprice)::DOUBLE AS p_max, 100.0::DOUBLE AS p_num,
  round(min(l_extendedprice) + (max(l_extendedprice) - min(l_extendedprice)) * 0.25, 4)::DOUBLE AS p_percent, round(quantile_cont(l_extendedprice::DOUBLE, 0.3), 4) AS p_percentile FROM lineitem GROUP BY 1""", "lineitem")
def cf_scale_points(lineitem: DataFrame) -> DataFrame:
    p = lambda kind, at=0.0: R.scale_point(kind, "l_extendedprice", at)
    return lineitem.groupBy("l_linenumber").agg(p("min").alias("p_min"), p("max").alias("p_max"), p("num", 100).alias("p_num"), F.round(p("percent", 25), 4).alias("p_percent"), F.round(p("percentile", 30), 4).alias("p_percentile"))


def _mix(a: str, b: str, lo: str, hi: str) -> str:
    parts = []
    for i in range(3):
        x, y = int(a[2 * i : 2 * i + 2], 16), int(b[2 * i : 2 * i + 2], 16)
        parts.append(f"floor({x} + ({y - x}) * (q - {lo}) / nullif({hi} - {lo}, 0) + 0.5)::INT * {1 << (16 - 8 * i)}")
    return " + ".join(parts)


@add(f"""WITH s AS (SELECT l_returnflag, min(l_quantity)::DOUBLE AS a, quantile_cont(l_quantity::DOUBLE, 0.5) AS b, max(l_quantity)::DOUBLE AS c FROM lineitem GROUP BY 1),
  v AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS q, a, b, c FROM lineitem JOIN s USING (l_returnflag))
  SELECT l_orderkey, l_linenumber, (CASE WHEN q <= a THEN {0xF8696B} WHEN q <= b THEN {_mix('F8696B', 'FFEB84', 'a', 'b')} WHEN q <= c THEN {_mix('FFEB84', '63BE7B', 'b', 'c')} ELSE {0x63BE7B} END)::INT AS rgb FROM v""", "lineitem")
def cf_color_scale(lineitem: DataFrame) -> DataFrame:
    q = lineitem.withColumn("q", F.col("l_quantity").cast("double"))
    v = R.with_stats(q, ["l_returnflag"], {"a": R.scale_point("min", "q"), "b": R.scale_point("percentile", "q", 50), "c": R.scale_point("max", "q")})
    return v.select("l_orderkey", "l_linenumber", R.color_scale(F.col("q"), [F.col("a"), F.col("b"), F.col("c")], [0xF8696B, 0xFFEB84, 0x63BE7B]).alias("rgb"))


@add("""SELECT o_orderkey, round(0.1 + 0.8 * greatest(0, least(1, (o_totalprice - lo) / nullif(hi - lo, 0))), 6)::DOUBLE AS bar FROM orders JOIN
  (SELECT o_orderstatus, min(o_totalprice)::DOUBLE AS lo, max(o_totalprice)::DOUBLE AS hi FROM orders GROUP BY 1) USING (o_orderstatus)""", "orders")
def cf_data_bar(orders: DataFrame) -> DataFrame:
    v = R.with_stats(orders, ["o_orderstatus"], {"lo": R.scale_point("min", "o_totalprice"), "hi": R.scale_point("max", "o_totalprice")})
    return v.select("o_orderkey", F.round(R.data_bar(F.col("o_totalprice").cast("double"), F.col("lo"), F.col("hi")), 6).alias("bar"))


@add("""WITH s AS (SELECT c_mktsegment, min(c_acctbal)::DOUBLE AS lo, max(c_acctbal)::DOUBLE AS hi FROM customer GROUP BY 1)
  SELECT c_custkey, (CASE WHEN c_acctbal > lo + (hi - lo) * 0.67 THEN 2 WHEN c_acctbal >= lo + (hi - lo) * 0.33 THEN 1 ELSE 0 END)::INT AS icon,
    (2 - CASE WHEN c_acctbal > lo + (hi - lo) * 0.67 THEN 2 WHEN c_acctbal >= lo + (hi - lo) * 0.33 THEN 1 ELSE 0 END)::INT AS turned FROM customer JOIN s USING (c_mktsegment)""", "customer")
def cf_icon_set(customer: DataFrame) -> DataFrame:
    points = {f"t{i}": R.scale_point("percent", "c_acctbal", at) for i, at in enumerate((0, 33, 67))}
    v = R.with_stats(customer, ["c_mktsegment"], points)
    t, x, strict = [F.col(f"t{i}") for i in range(3)], F.col("c_acctbal"), [False, False, True]
    return v.select("c_custkey", R.icon(x, t, strict).alias("icon"), R.icon(x, t, strict, reverse=True).alias("turned"))


@add("""WITH h AS (
  SELECT l_orderkey, l_linenumber, 1 AS p, 'red' AS fill, NULL::VARCHAR AS ink, true AS bold FROM lineitem WHERE l_quantity > 40 UNION ALL
  SELECT l_orderkey, l_linenumber, 2, 'blue', 'white', false FROM lineitem WHERE l_discount > 0.05 UNION ALL
  SELECT l_orderkey, l_linenumber, 3, NULL, 'black', false FROM lineitem WHERE l_tax > 0.04)
  SELECT l_orderkey, l_linenumber, arg_min(fill, p) FILTER (fill IS NOT NULL) AS fill, arg_min(ink, p) FILTER (ink IS NOT NULL) AS ink, bool_or(bold) AS bold FROM h GROUP BY 1, 2""", "lineitem")
def cf_rule_order(lineitem: DataFrame) -> DataFrame:
    rules = [(1, "l_quantity > 40", "red", None, True), (2, "l_discount > 0.05", "blue", "white", False), (3, "l_tax > 0.04", None, "black", False)]
    hit = [F.when(F.expr(test), F.struct(F.lit(p).alias("p"), F.lit(fill).cast("string").alias("fill"), F.lit(ink).cast("string").alias("ink"), F.lit(bold).alias("bold"))) for p, test, fill, ink, bold in rules]
    hits = lineitem.select("l_orderkey", "l_linenumber", F.explode(F.array_compact(F.array(*hit))).alias("h")).select("l_orderkey", "l_linenumber", "h.*")
    return R.resolve_rules(hits, ["l_orderkey", "l_linenumber"], "p", ["fill", "ink"], ["bold"])


@add("""SELECT l_orderkey, l_linenumber, ((l_linenumber - 1) % 4 // 2)::INT AS band FROM lineitem""", "lineitem")
def table_stripes(lineitem: DataFrame) -> DataFrame:
    return lineitem.select("l_orderkey", "l_linenumber", R.stripe(F.col("l_linenumber") - 1, 2).alias("band"))


@add("""SELECT l_linenumber, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept,
  round(regr_slope(l_extendedprice, l_quantity) * 100 + regr_intercept(l_extendedprice, l_quantity), 3) AS at100 FROM lineitem GROUP BY 1""", "lineitem")
def trend_linear(lineitem: DataFrame) -> DataFrame:
    t = C.linear_trend(lineitem, ["l_linenumber"], "l_quantity", "l_extendedprice")
    return t.select("l_linenumber", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round(C.trend_value("linear", F.col("slope"), F.col("intercept"), F.lit(100)), 3).alias("at100"))


@add("""SELECT l_returnflag, round(regr_slope(l_extendedprice, ln(l_quantity)), 4) AS log_a, round(regr_intercept(l_extendedprice, ln(l_quantity)), 3) AS log_b,
  round(regr_slope(ln(l_extendedprice), l_quantity), 6) AS exp_a, round(exp(regr_intercept(ln(l_extendedprice), l_quantity)), 3) AS exp_b,
  round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS power_a, round(exp(regr_intercept(ln(l_extendedprice), ln(l_quantity))), 3) AS power_b FROM lineitem GROUP BY 1""", "lineitem")
def trend_log_exp_power(lineitem: DataFrame) -> DataFrame:
    t = C.curved_trends(lineitem.withColumn("q", F.col("l_quantity").cast("double")), ["l_returnflag"], "q", "l_extendedprice")
    return t.select("l_returnflag", *[F.round(c, n).alias(c) for c, n in (("log_a", 4), ("log_b", 3), ("exp_a", 6), ("exp_b", 3), ("power_a", 6), ("power_b", 3))])


@add(None, "lineitem")
def trend_poly(lineitem: DataFrame) -> DataFrame:
    t = C.polynomial_trend(lineitem, ["l_linenumber"], "l_quantity", "l_extendedprice", 3)
    return t.select("l_linenumber", *[F.round(f"c{k}", 2).alias(f"c{k}") for k in range(4)])


@add("""SELECT o_custkey, o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS average FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) >= 3""", "orders")
def moving_average(orders: DataFrame) -> DataFrame:
    return C.moving_average(orders, ["o_custkey"], ["o_orderkey"], "o_totalprice", 3).select("o_custkey", "o_orderkey", F.round("average", 4).alias("average"))


@add("""WITH s AS (SELECT l_linenumber, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS d, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT l_orderkey, l_linenumber, round(l_extendedprice - abs(l_extendedprice) * 0.05, 6) AS pct_low, round(l_extendedprice + abs(l_extendedprice) * 0.05, 6) AS pct_high,
  round(m - 2 * d, 3) AS sd_low, round(m + 2 * d, 3) AS sd_high, round(l_extendedprice + d / sqrt(n), 3) AS se_high FROM lineitem JOIN s USING (l_linenumber)""", "lineitem")
def error_bars(lineitem: DataFrame) -> DataFrame:
    out = lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    for kind, k, name in (("percentage", 5, "pct"), ("stdDev", 2, "sd"), ("stdErr", 1, "se")):
        out = C.error_bars(out, ["l_linenumber"], "l_extendedprice", kind, k).withColumnsRenamed({"low": f"{name}_low", "high": f"{name}_high"})
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6 if c[0] == "p" else 3).alias(c) for c in ("pct_low", "pct_high", "sd_low", "sd_high", "se_high")])


@add("""WITH v AS (SELECT l_linenumber, l_extendedprice - 30000 AS v FROM lineitem)
  SELECT l_linenumber, round(sum(CASE WHEN v >= 0 THEN v ELSE 0 END), 2) AS top, round(sum(CASE WHEN v < 0 THEN v ELSE 0 END), 2) AS bottom FROM v GROUP BY 1""", "lineitem")
def stacked_range(lineitem: DataFrame) -> DataFrame:
    s = C.stacked_range(lineitem.withColumn("v", F.col("l_extendedprice") - 30000), ["l_linenumber"], "v")
    return s.select("l_linenumber", F.round("top", 2).alias("top"), F.round("bottom", 2).alias("bottom"))


@add("""WITH v AS (SELECT l_linenumber, l_returnflag, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2)
  SELECT l_linenumber, l_returnflag, round(v / sum(abs(v)) OVER (PARTITION BY l_linenumber), 8) AS share FROM v""", "lineitem")
def percent_stack(lineitem: DataFrame) -> DataFrame:
    v = lineitem.groupBy("l_linenumber", "l_returnflag").agg(F.sum("l_extendedprice").alias("v"))
    return C.percent_stack(v, ["l_linenumber"], "v").select("l_linenumber", "l_returnflag", F.round("share", 8).alias("share"))


@add("""WITH v AS (SELECT o_orderpriority, min(o_totalprice)::DOUBLE AS lo, max(o_totalprice)::DOUBLE AS hi FROM orders GROUP BY 1 UNION ALL SELECT 'narrow', 95, 100 UNION ALL SELECT 'below', -100, -20)
  SELECT o_orderpriority, CASE WHEN lo > 0 AND NOT hi - lo < abs(hi) / 6 THEN 0 ELSE lo END::DOUBLE AS axis_lo, CASE WHEN hi < 0 AND NOT hi - lo < abs(lo) / 6 THEN 0 ELSE hi END::DOUBLE AS axis_hi FROM v""", "orders")
def axis_zero(orders: DataFrame) -> DataFrame:
    v = orders.groupBy("o_orderpriority").agg(F.min("o_totalprice").cast("double").alias("lo"), F.max("o_totalprice").cast("double").alias("hi"))
    v = v.unionByName(orders.sparkSession.createDataFrame([("narrow", 95.0, 100.0), ("below", -100.0, -20.0)], "o_orderpriority string, lo double, hi double"))
    lo, hi = C.axis_from_zero(F.col("lo"), F.col("hi"))
    return v.select("o_orderpriority", lo.alias("axis_lo"), hi.alias("axis_hi"))


@add("""WITH v AS (SELECT o_orderstatus, min(o_totalprice)::DOUBLE AS lo, max(o_totalprice)::DOUBLE AS hi FROM orders GROUP BY 1),
  t AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) * 1.05 ELSE 1 END AS span FROM v),
  u AS (SELECT *, [1.0, 2.0, 5.0][(k % 3 + 1)::INT]::DOUBLE * pow(10.0, floor(log10(span)) - 2 + k // 3) AS unit FROM t, generate_series(0, 17) g(k)),
  w AS (SELECT *, floor(lo / unit) * unit AS first, ceil((lo + span) / unit) * unit AS last FROM u),
  f AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY unit) AS r FROM w WHERE round((last - first) / unit) <= 1000 AND 400 / round((last - first) / unit) >= 40)
  SELECT o_orderstatus, round(unit, 6) AS unit, round(first, 6) AS first, round(last, 6) AS last FROM f WHERE r = 1""", "orders")
def nice_axis(orders: DataFrame) -> DataFrame:
    v = orders.groupBy("o_orderstatus").agg(F.min("o_totalprice").cast("double").alias("lo"), F.max("o_totalprice").cast("double").alias("hi"))
    return C.nice_axis(v, "lo", "hi", 400.0, 40.0).select("o_orderstatus", *[F.round(c, 6).alias(c) for c in ("unit", "first", "last")])


@add("""SELECT o_custkey, o_orderkey, place::INT AS place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders
  WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 256)) WHERE place <= 4096""", "orders")
def chart_series(orders: DataFrame) -> DataFrame:
    return C.limit_series(orders, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "place")
