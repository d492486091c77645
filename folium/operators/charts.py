"""Statistics behind charts: trends, averages, bars of error, stacks and axes. A series is a partition given by columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def linear_trend(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """slope and intercept of least squares; null below two points."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def curved_trends(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """log: y = a ln x + b, exp: y = b e^(a x), power: y = b x^a; null where a logarithm would not exist."""
    positive = {v: F.min(v) > 0 for v in (x, y)}
    lx, ly = F.when(F.col(x) > 0, F.ln(x)), F.when(F.col(y) > 0, F.ln(y))
    got = df.withColumns({"lx__": lx, "ly__": ly}).groupBy(*by).agg(
        F.when(positive[x], F.regr_slope(y, "lx__")).alias("log_a"),
        F.when(positive[x], F.regr_intercept(y, "lx__")).alias("log_b"),
        F.when(positive[y], F.regr_slope("ly__", x)).alias("exp_a"),
        F.when(positive[y], F.exp(F.regr_intercept("ly__", x))).alias("exp_b"),
        F.when(positive[x] & positive[y], F.regr_slope("ly__", "lx__")).alias("power_a"),
        F.when(positive[x] & positive[y], F.exp(F.regr_intercept("ly__", "lx__"))).alias("power_b"),
    )
    return got


def trend_value(kind: str, a: Column, b: Column, x: Column) -> Column:
    """A trend at x; NaN where log or power do not exist."""
    nan = F.lit(float("nan"))
    if kind == "linear":
        return a * x + b
    if kind == "exp":
        return b * F.exp(a * x)
    return F.when(x > 0, a * F.ln(x) + b if kind == "log" else b * F.pow(x, a)).otherwise(nan)


def polynomial_trend(df: DataFrame, by: list[str], x: str, y: str, order: int) -> DataFrame:
    """coefficients c0..c_order of least squares, order 2 to 6; null below order + 1 points or if singular.

    Only sums of powers leave the data; one small system for each series is solved from them by elimination.
    """
    order = min(6, max(2, order))
    n = order + 1
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    sums = df.where(xs.isNotNull() & ys.isNotNull()).groupBy(*by).agg(
        *[F.sum(F.pow(xs, F.lit(k))).alias(f"s{k}") for k in range(2 * order + 1)], *[F.sum(ys * F.pow(xs, F.lit(k))).alias(f"t{k}") for k in range(n)]
    )
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in sums.schema.fields if f.name in by] + [f"c{k} double" for k in range(n)])

    def solve(frames):
        import numpy as np

        for f in frames:
            out = np.full((len(f), n), np.nan)
            for r in range(len(f)):
                m = np.array([[f[f"s{i + j}"].iloc[r] for j in range(n)] for i in range(n)], float)
                if m[0, 0] >= n and abs(np.linalg.det(m)) >= 1e-300:
                    out[r] = np.linalg.solve(m, np.array([f[f"t{k}"].iloc[r] for k in range(n)], float))
            got = f[by].copy()
            for k in range(n):
                got[f"c{k}"] = [None if v != v else v for v in out[:, k]]
            yield got

    return sums.mapInPandas(solve, schema)


def moving_average(df: DataFrame, by: list[str], order: list[str], value: str, period: int) -> DataFrame:
    """The mean of the last `period` finite values, from the one that completes the first period on."""
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    w = Window.partitionBy(*by).orderBy(*order)
    out = finite.withColumn("place", F.row_number().over(w)).withColumn("average", F.avg(value).over(w.rowsBetween(1 - period, 0)))
    return out.where(F.col("place") >= period).drop("place")


def error_bars(df: DataFrame, by: list[str], value: str, kind: str, k: float = 1.0, plus: bool = True, minus: bool = True) -> DataFrame:
    """low and high of every point: fixed, percentage, stdDev (around the mean) or stdErr."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("mean__"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd__"), F.count(value).alias("n__"))
    df = df.join(stats, by)
    v = F.col(value)
    size = {"fixed": F.lit(float(k)), "percentage": F.abs(v) * (k / 100), "stdDev": F.col("sd__") * k, "stdErr": F.col("sd__") / F.sqrt("n__")}[kind]
    centre = F.col("mean__") if kind == "stdDev" else v
    none = F.lit(0.0)
    return df.withColumn("low", centre - (size if minus else none)).withColumn("high", centre + (size if plus else none)).drop("mean__", "sd__", "n__")


def stacked_range(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Values above and below zero pile up separately."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.sum(F.when(v >= 0, v).otherwise(0)).alias("top"), F.sum(F.when(v < 0, v).otherwise(0)).alias("bottom"))


def percent_stack(df: DataFrame, by: list[str], value: str) -> DataFrame:
    total = df.groupBy(*by).agg(F.sum(F.abs(value)).alias("total__"))
    return df.join(total, by).withColumn("share", F.col(value) / F.nullif(F.col("total__"), F.lit(0))).drop("total__")


def axis_from_zero(lo: Column, hi: Column) -> tuple[Column, Column]:
    """An axis starts at zero unless the values span less than a sixth of their greatest."""
    near = (hi - lo) < F.abs(hi) / 6
    return F.when((lo > 0) & ~near, F.lit(0.0)).otherwise(lo), F.when((hi < 0) & ~((hi - lo) < F.abs(lo) / 6), F.lit(0.0)).otherwise(hi)


def nice_axis(ranges: DataFrame, lo: str, hi: str, length: float, gap: float) -> DataFrame:
    """unit, first and last of an axis of `length` whose grid lines are at least `gap` apart, with 5 % of head room.

    Units are 1, 2 or 5 times a power of ten, over six decades from two below that of the span; the least that fits wins.
    """
    span = F.when(F.col(hi) > F.col(lo), (F.col(hi) - F.col(lo)) * 1.05).otherwise(F.lit(1.0))
    decade = F.floor(F.log10("span__")) - 2
    tried = ranges.withColumn("span__", span).withColumn("try__", F.explode(F.sequence(F.lit(0), F.lit(17))))
    unit = F.element_at(F.array(F.lit(1.0), F.lit(2.0), F.lit(5.0)), (F.col("try__") % 3 + 1).cast("int")) * F.pow(F.lit(10.0), decade + F.floor(F.col("try__") / 3))
    tried = tried.withColumn("unit", unit)
    first, last = F.floor(F.col(lo) / F.col("unit")) * F.col("unit"), F.ceil((F.col(lo) + F.col("span__")) / F.col("unit")) * F.col("unit")
    tried = tried.withColumn("first", first).withColumn("last", last).withColumn("steps", F.round((F.col("last") - F.col("first")) / F.col("unit")))
    fits = tried.where((F.col("steps") <= 1000) & (F.lit(length) / F.col("steps") >= gap))
    return fits.groupBy(*ranges.columns).agg(F.min_by(F.struct("unit", "first", "last"), "unit").alias("axis")).select(*ranges.columns, "axis.*")


def limit_series(df: DataFrame, by: list[str], order: list[str], series: int = 256, points: int = 4096) -> DataFrame:
    """At most so many series, in their order, and points of each."""
    kept = df.select(*by).distinct().orderBy(*by).limit(series)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.join(kept, by, "left_semi").withColumn("place", place).where(F.col("place") <= points)
