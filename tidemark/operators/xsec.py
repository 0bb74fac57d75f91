"""Operators across the members of each cross-section (a date, or a date and a factor).

Statistics of a cross-section are window aggregates without an order, so several of them share one shuffle
by the cross-section's key. Values are NULL-safe: NULL takes no part in statistics and stays NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def winsorize_mad(df: DataFrame, value: str, by: Sequence[str], out: str, n: float = 3.0, least: int = 1) -> DataFrame:
    """Clipped to median ± n · 1.4826 · MAD; unchanged where the MAD is 0 or the section has fewer than ``least`` values."""
    w = Window.partitionBy(*by)
    df = df.withColumn("_med", F.median(value).over(w)).withColumn("_mad", F.median(F.abs(F.col(value) - F.col("_med"))).over(w))
    reach = n * MAD_SCALE * F.col("_mad")
    clipped = F.greatest(F.least(F.col(value), F.col("_med") + reach), F.col("_med") - reach)
    applies = (F.col("_mad") > 0) & (F.count(value).over(w) >= least) & F.col(value).isNotNull()
    return df.withColumn(out, F.when(applies, clipped).otherwise(F.col(value))).drop("_med", "_mad")


def winsorize_sigma(df: DataFrame, value: str, by: Sequence[str], out: str, n: float = 3.0) -> DataFrame:
    """Clipped to mean ± n standard deviations."""
    w = Window.partitionBy(*by)
    mean, sd = F.avg(value).over(w), F.stddev_samp(value).over(w)
    clipped = F.greatest(F.least(F.col(value), mean + n * sd), mean - n * sd)
    return df.withColumn(out, F.when(sd.isNotNull() & F.col(value).isNotNull(), clipped).otherwise(F.col(value)))


def zscore(df: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumn(out, (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)))


def neutralize(df: DataFrame, value: str, by: Sequence[str], group: str, control: str | None, out: str, least: int = 30) -> DataFrame:
    """Residual of a regression on group dummies and, with ``control``, on it.

    By the Frisch-Waugh theorem, both sides are demeaned by group and one slope is left, so the regression
    is a few window sums. Sections with fewer than ``least`` complete rows give NULL.
    """
    complete = F.col(value).isNotNull() & F.col(group).isNotNull()
    if control:
        complete = complete & F.col(control).isNotNull()
    df = df.withColumn("_y", F.when(complete, F.col(value)))
    inner, whole = Window.partitionBy(*by, group), Window.partitionBy(*by)
    df = df.withColumn("_dy", F.col("_y") - F.avg("_y").over(inner))
    residual = F.col("_dy")
    if control:
        df = df.withColumn("_x", F.when(complete, F.col(control))).withColumn("_dx", F.col("_x") - F.avg("_x").over(inner))
        slope = F.sum(F.col("_dx") * F.col("_dy")).over(whole) / F.nullif(F.sum(F.col("_dx") * F.col("_dx")).over(whole), F.lit(0.0))
        residual = F.col("_dy") - F.coalesce(slope, F.lit(0.0)) * F.col("_dx")
    return df.withColumn(out, F.when(F.count("_y").over(whole) >= least, residual)).drop("_y", "_dy", "_x", "_dx")


def ranks(df: DataFrame, value: str, by: Sequence[str], direction: int = 1) -> DataFrame:
    """``rank`` (1 is best, ties share it) and ``percentile`` (0 to 100, ties at their mean), over rows with a value."""
    signed = F.col(value) * direction
    w = Window.partitionBy(*by)
    best = w.orderBy(signed.desc_nulls_last())
    worst = w.orderBy(signed.asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    n = F.count(value).over(w)
    has = F.col(value).isNotNull()
    return df.withColumn("rank", F.when(has, F.rank().over(best))).withColumn("percentile", F.when(has, 100 * (F.rank().over(worst) + (ties - 1) / 2) / n))


def average_rank(value: str, by: Sequence[str]) -> Column:
    """Rank with ties at their mean, NULL for NULL."""
    w = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return F.when(F.col(value).isNotNull(), F.rank().over(w) + (ties - 1) / 2)


def quintile(percentile: Column) -> Column:
    return F.when(percentile.isNull(), F.lit(None)).when(percentile <= 20, 1).when(percentile <= 40, 2).when(percentile <= 60, 3).when(percentile <= 80, 4).otherwise(5)


def quantile_groups(value: str, by: Sequence[str], tie: str, n: int = 5) -> Column:
    """Equal-count groups 1 to n by rank, edges at the quantiles of the ranks; NULL where a section has fewer than n values."""
    w = Window.partitionBy(*by)
    has = F.col(value).isNotNull()
    r = F.row_number().over(w.orderBy(F.col(value).asc_nulls_last(), tie))
    count = F.count(value).over(w)
    return F.when(has & (count >= n), F.greatest(F.lit(1), F.ceil((r - 1) * n / F.greatest(count - 1, F.lit(1)))).cast("int"))


def compose(df: DataFrame, weights: dict[str, float], factor: str, value: str, key: Sequence[str], out: str) -> DataFrame:
    """Weighted sum of factors per key where all of them have a value; weights are divided by the sum of their sizes."""
    scale = sum(abs(w) for w in weights.values())
    weight = F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, w / scale)])
    rows = df.where(F.col(factor).isin(*weights)).withColumn("_w", F.element_at(weight, F.col(factor)))
    return rows.groupBy(*key).agg(F.sum(F.col("_w") * F.col(value)).alias(out), F.count(value).alias("_n")).where(F.col("_n") == len(weights)).drop("_n")


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over rows with both values; NULL without spread (the built-in one raises there)."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
