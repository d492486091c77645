"""Rules over ranges of cells: what stands out within a range, and how it is shown.

A range is a partition given by columns. Ranks and counts are windows over it; statistics that are one row for each range
are aggregated first, before any rows move, and joined back, so a long range does not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_stats(df: DataFrame, by: list[str], stats: dict[str, Column]) -> DataFrame:
    """df with statistics of each range; the ranges' rows are aggregated where they lie, then looked up."""
    got = df.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()])
    return df.join(got, by)


def top_n(df: DataFrame, by: list[str], value: str, rank: int, percent: bool = False, bottom: bool = False) -> DataFrame:
    """Rows whose value is among the first `rank` (or percent) of the range; ties with the last of them all stay.

    The cut is found on distinct values and their counts, which are pre-aggregated.
    """
    numbers = df.where(F.col(value).isNotNull())
    counts = numbers.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    order = F.col(value).asc() if bottom else F.col(value).desc()
    whole = Window.partitionBy(*by)
    upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(whole)
    keep = F.greatest(F.lit(1), F.floor(total * rank / 100)) if percent else F.lit(rank)
    cut = counts.withColumn("before", F.sum("n").over(upto) - F.col("n")).withColumn("keep", F.least(keep, total))
    hit = cut.where(F.col("before") < F.col("keep")).select(*by, value)
    return numbers.join(hit, [*by, value])


def above_average(df: DataFrame, by: list[str], value: str, deviations: float = 0.0, below: bool = False, equal: bool = False) -> DataFrame:
    """Rows above (below) the mean plus (minus) k standard deviations; one value has deviation 0."""
    stats = with_stats(df.where(F.col(value).isNotNull()), by, {"mean": F.avg(value), "sd": F.coalesce(F.stddev_samp(value), F.lit(0.0))})
    bound = F.col("mean") + (-deviations if below else deviations) * F.col("sd")
    x = F.col(value)
    test = (x <= bound if equal else x < bound) if below else (x >= bound if equal else x > bound)
    return stats.withColumn("bound", bound).where(test)


def identity(value: Column, number: Column) -> Column:
    """What makes two cells equal: numbers by value, texts without case."""
    return F.when(number.isNotNull(), F.concat(F.lit("n"), number.cast("string"))).otherwise(F.concat(F.lit("t"), F.lower(value)))


def occurrences(df: DataFrame, by: list[str], key: Column) -> DataFrame:
    """df with `seen`, how often its key occurs in the range; empty keys are counted but not returned."""
    keyed = df.withColumn("key", key)
    return with_stats(keyed, [*by, "key"], {"seen": F.count(F.lit(1))}).where(F.col("key") != "t")


def cell_is(x: Column, op: str, a: Column, b: Column | None = None) -> Column:
    """A comparison of a cell with literals; bounds may be given in either order. Null where types do not match."""
    if op in ("between", "notBetween"):
        inside = x.between(F.least(a, b), F.greatest(a, b))
        return inside if op == "between" else ~inside
    return {"equal": x == a, "notEqual": x != a, "greaterThan": x > a, "lessThan": x < a, "greaterThanOrEqual": x >= a, "lessThanOrEqual": x <= a}[op]


def text_rule(x: Column, kind: str, part: str = "") -> Column:
    """Text rules without case; blank means nothing but white space."""
    low, p = F.lower(x), part.lower()
    if kind == "containsBlanks":
        return F.coalesce(F.regexp_replace(x, r"\s", ""), F.lit("")) == ""
    if kind == "notContainsBlanks":
        return ~text_rule(x, "containsBlanks")
    return {"containsText": low.contains(p), "notContainsText": ~low.contains(p), "beginsWith": low.startswith(p), "endsWith": low.endswith(p)}[kind]


def scale_point(kind: str, value: str, at: float = 0.0) -> Column:
    """The aggregate behind a point of a scale."""
    lo, hi = F.min(value).cast("double"), F.max(value).cast("double")
    return {"min": lo, "max": hi, "num": F.lit(float(at)), "percent": lo + (hi - lo) * (at / 100), "percentile": F.percentile(value, F.lit(at / 100))}[kind]


def channel(rgb: int, i: int) -> int:
    return rgb >> (16 - 8 * i) & 255


def color_scale(x: Column, stops: list[Column], colors: list[int]) -> Column:
    """The colour of a value between stops, mixed channel by channel, as 0xRRGGBB."""
    out = F.lit(colors[-1])
    for k in range(len(stops) - 2, -1, -1):
        lo, hi = stops[k], stops[k + 1]
        t = F.when(hi == lo, F.lit(1.0)).otherwise((x - lo) / F.nullif(hi - lo, F.lit(0.0)))
        mixed = F.lit(0)
        for i in range(3):
            a, b = channel(colors[k], i), channel(colors[k + 1], i)
            mixed = mixed + F.floor(F.lit(a) + F.lit(b - a) * t + F.lit(0.5)).cast("int") * (1 << (16 - 8 * i))
        out = F.when(x <= hi, mixed).otherwise(out)
    return F.when(x <= stops[0], F.lit(colors[0])).otherwise(out).cast("int")


def data_bar(x: Column, lo: Column, hi: Column, least: float = 0.1, most: float = 0.9) -> Column:
    t = F.when(hi == lo, F.lit(1.0)).otherwise((x - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return F.lit(least) + F.lit(most - least) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def icon(x: Column, thresholds: list[Column], strict: list[bool] | None = None, reverse: bool = False) -> Column:
    """The last threshold that a value passes, from 0."""
    out = F.lit(0)
    for i, t in enumerate(thresholds):
        passed = x > t if strict and strict[i] else x >= t
        out = F.when(passed, F.lit(i)).otherwise(out)
    return (F.lit(len(thresholds) - 1) - out if reverse else out).cast("int")


def resolve_rules(hits: DataFrame, key: list[str], priority: str, attributes: list[str], flags: list[str]) -> DataFrame:
    """For each cell the attribute of the least priority number that sets it; flags hold if any rule sets them."""
    return hits.groupBy(*key).agg(*[F.min_by(a, F.when(F.col(a).isNotNull(), F.col(priority))).alias(a) for a in attributes], *[F.bool_or(f).alias(f) for f in flags])


def stripe(position: Column, size: int = 1) -> Column:
    """0 or 1 by bands of `size` rows."""
    return F.floor(position % (2 * size) / size).cast("int")
