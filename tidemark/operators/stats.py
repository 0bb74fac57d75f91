"""Statistics of a few numbers on the driver, and ordered aggregates in Spark."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_tail(z: float) -> float:
    """Two-sided p-value of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def newey_west(df: DataFrame, value: str, order: str, lags: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean, its HAC standard error (Bartlett weights, autocovariances over n) and t, per ``by``; NULL values are left out first.

    The lagged products of a series come from one ordered window, so no value goes to the driver.
    """
    rows = df.where(F.col(value).isNotNull())
    whole = Window.partitionBy(*by)
    rows = rows.withColumn("_d", F.col(value) - F.avg(value).over(whole))
    ordered = whole.orderBy(order)
    terms = {f"_g{j}": F.col("_d") * F.lag("_d", j).over(ordered) for j in range(1, lags + 1)}
    g = rows.withColumns(terms | {"_g0": F.col("_d") * F.col("_d")}).groupBy(*by)
    rows = F.count(F.lit(1))
    n = F.nullif(rows, F.lit(0))
    lrv = F.sum("_g0") / n
    for j in range(1, lags + 1):
        lrv = lrv + 2 * (1 - j / (lags + 1)) * F.coalesce(F.sum(f"_g{j}"), F.lit(0.0)) / n
    out = g.agg(F.avg(value).alias("mean"), F.sqrt(F.greatest(lrv, F.lit(0.0)) / n).alias("se"), rows.alias("n"))
    return out.withColumn("t", F.col("mean") / F.nullif(F.col("se"), F.lit(0.0)))


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str], tie: str) -> DataFrame:
    """``q``: p times count over rank, made monotone from the largest p downwards."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(p, tie))).withColumn("_m", F.count(p).over(w))
    raw = ranked.withColumn("_q", F.col(p) * F.col("_m") / F.col("_r"))
    down = w.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("q", F.least(F.min("_q").over(down), F.lit(1.0))).drop("_r", "_m", "_q")


def performance(ret: str) -> dict[str, Column]:
    """Aggregates of a daily return series: annual return and volatility, Sharpe ratio, win rate."""
    n = F.count(ret)
    return {
        "ann_return": F.pow(F.product(1 + F.col(ret)), 252 / n) - 1,
        "ann_vol": F.stddev_samp(ret) * 252.0**0.5,
        "sharpe": F.avg(ret) / F.nullif(F.stddev_samp(ret), F.lit(0.0)) * 252.0**0.5,
        "win_rate": F.avg((F.col(ret) > 0).cast("double")),
    }


def logistic(df: DataFrame, x: str, y: str, ridge: float, steps: int = 30, tolerance: float = 1e-10) -> tuple[float, float]:
    """(intercept, slope) of a ridge logistic regression on one variable; the intercept is not penalised.

    Newton's method: each step is one aggregate of five sums over all rows. Rows without both values take no
    part; without any rows, both are 0.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    a = b = 0.0
    for _ in range(steps):
        p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("_x"))))
        w = p * (1 - p)
        s = rows.agg(
            F.sum(p - F.col("_y")).alias("ga"), F.sum((p - F.col("_y")) * F.col("_x")).alias("gb"), F.sum(w).alias("aa"), F.sum(w * F.col("_x")).alias("ab"), F.sum(w * F.col("_x") * F.col("_x")).alias("bb")
        ).first()
        if s["ga"] is None:
            return 0.0, 0.0
        ga, gb, aa, ab, bb = s["ga"], s["gb"] + ridge * b, s["aa"], s["ab"], s["bb"] + ridge
        det = aa * bb - ab * ab
        if det <= 0:
            break
        da, db = (bb * ga - ab * gb) / det, (aa * gb - ab * ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < tolerance:
            break
    return a, b
