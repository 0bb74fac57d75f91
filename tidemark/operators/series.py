"""Operators along the sessions of each security.

Input is a dense panel: a row per security and session of the shared calendar, from the security's first
session to its last, with NULL where there is no bar. Lags and frames count sessions of the calendar, so a
missing day takes a step like any other. Full-window operators are NULL unless every row of the frame has a
value. All windows of a call share one partitioning and order, so a chain of them sorts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, AXIS = "security_id", "session_no"


def by_security(key: str = KEY, axis: str = AXIS):
    return Window.partitionBy(key).orderBy(axis)


def dense(panel: DataFrame, key: str = KEY, axis: str = AXIS) -> DataFrame:
    """``panel`` (distinct on key and axis) with a row for every session between a key's first and last one.

    Sessions are numbered without gaps, so a row is followed by as many empty ones as lie before the key's
    next row. That takes the one shuffle by key that the windows over the panel need anyway.
    """
    rest = [c for c in panel.columns if c not in (key, axis)]
    here = F.col("_at") == F.col(axis)
    gap = F.sequence(F.col(axis), F.coalesce(F.lead(axis).over(by_security(key, axis)) - 1, F.col(axis)))
    return panel.withColumn("_gap", gap).withColumn("_at", F.explode("_gap")).select(key, F.col("_at").alias(axis), *[F.when(here, F.col(c)).alias(c) for c in rest])


def frame(n: int, key: str = KEY, axis: str = AXIS):
    """The last ``n`` sessions, the current one included."""
    return by_security(key, axis).rowsBetween(-(n - 1), 0)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; NULL where ``b`` is 0."""
    return a / F.nullif(b, F.lit(0.0))


def change(value: str | Column, k: int = 1, w=None) -> Column:
    """Relative change over ``k`` sessions, without filling."""
    value = F.col(value) if isinstance(value, str) else value
    return ratio(value, F.lag(value, k).over(w or by_security())) - 1


def momentum(value: str, lookback: int, skip: int) -> Column:
    """Relative change over ``lookback`` sessions that ended ``skip`` sessions ago."""
    w = by_security()
    return ratio(F.lag(value, skip).over(w), F.lag(value, skip + lookback).over(w)) - 1


def full(aggregate: Column, counted: Column | str, n: int, least: int | None = None) -> Column:
    """An aggregate over the last ``n`` sessions; NULL with fewer than ``least`` (by default ``n``) values."""
    return F.when(F.count(counted).over(frame(n)) >= (n if least is None else least), aggregate.over(frame(n)))


def volatility(ret: str, n: int, share: float = 0.8) -> Column:
    """Sample standard deviation of returns with at least ``share`` of the window's values."""
    return full(F.stddev_samp(ret), ret, n, int(share * n))


def compounded(ret: str, n: int) -> Column:
    """Product of the last ``n`` gross returns less 1; a total loss stays -1."""
    return full(F.product(1 + F.col(ret)), ret, n) - 1


def forward(ret: str, n: int) -> Column:
    """Product of the next ``n`` gross returns less 1; NULL if any is missing."""
    w = by_security().rowsBetween(1, n)
    return F.when(F.count(ret).over(w) == n, F.product(1 + F.col(ret)).over(w)) - 1


def true_range(high: str, low: str, close: str) -> Column:
    before = F.lag(close).over(by_security())
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))


def filled_forward(value: str, limit: int) -> Column:
    """The last value, at most ``limit`` sessions old."""
    return F.last(value, ignorenulls=True).over(by_security().rowsBetween(-limit, 0))


def rolling_median(value: str, n: int, least: int | None = None) -> Column:
    """Median of the last ``n`` sessions. Framed medians are no window function; the frame's values are sorted instead."""
    values = F.array_sort(F.collect_list(value).over(frame(n)))
    size = F.size(values)
    middle = (F.element_at(values, (F.floor((size + 1) / 2)).cast("int")) + F.element_at(values, (F.floor(size / 2) + 1).cast("int"))) / 2
    return F.when(size >= (n if least is None else least), middle)


def rolling_quantile(value: str, n: int, q: float, least: int) -> Column:
    """Linear-interpolated quantile of the last ``n`` sessions."""
    values = F.array_sort(F.collect_list(value).over(frame(n)))
    at = (F.size(values) - 1) * q
    low = F.element_at(values, (F.floor(at) + 1).cast("int"))
    high = F.element_at(values, (F.ceil(at) + 1).cast("int"))
    return F.when(F.size(values) >= least, low + (high - low) * (at - F.floor(at)))


def rolling_percentile(value: str, n: int) -> Column:
    """Share of the last ``n`` values that are not above the current one; NULL before there are ``n``."""
    values = F.collect_list(value).over(frame(n))
    return F.when(F.col(value).isNotNull() & (F.size(values) == n), F.size(F.filter(values, lambda x: x <= F.col(value))) / F.lit(float(n)))


def with_drawdown(df: DataFrame, ret: str, nav: str = "nav", out: str = "drawdown", key: str = KEY, axis: str = AXIS) -> DataFrame:
    """``df`` with ``nav`` (wealth from 1) and ``out``: wealth over its running maximum, the starting capital included, less 1. Missing returns change nothing."""
    upto = by_security(key, axis).rowsBetween(Window.unboundedPreceding, 0)
    grown = df.withColumn(nav, F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(upto))
    return grown.withColumn(out, F.col(nav) / F.greatest(F.max(nav).over(upto), F.lit(1.0)) - 1)


def local_maximum(value: str, radius: int) -> Column:
    """True where no value within ``radius`` sessions is greater; NULL without a value or a whole neighbourhood."""
    w = by_security().rowsBetween(-radius, radius)
    return F.when((F.count(F.lit(1)).over(w) == 2 * radius + 1) & F.col(value).isNotNull(), F.col(value) >= F.max(value).over(w))


def slope(value: str, n: int) -> Column:
    """Least-squares slope of the last ``n`` values against 0 to n - 1, in closed form over lags."""
    mean = (n - 1) / 2
    total = sum((i - mean) ** 2 for i in range(n))
    w = by_security()
    terms = [(F.lag(value, n - 1 - i).over(w) if i < n - 1 else F.col(value)) * ((i - mean) / total) for i in range(n)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def segments(df: DataFrame, breaks: Column, name: str, key: str = KEY, axis: str = AXIS) -> DataFrame:
    """Numbers the stretches between rows where ``breaks`` holds (gaps and islands)."""
    upto = by_security(key, axis).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_break", breaks.cast("int")).withColumn(name, F.sum("_break").over(upto)).drop("_break")


def first_touch(df: DataFrame, base: Sequence[str], up: Column, down: Column, high: str, low: str, horizon: int) -> DataFrame:
    """``df`` with ``touch_at`` (sessions ahead, NULL for none) and ``touch`` (up, down, both, none) within the next ``horizon`` sessions.

    The next sessions come as one framed list, so nothing is joined.
    """
    ahead = by_security().rowsBetween(1, horizon)
    listed = df.withColumn("_ahead", F.collect_list(F.struct(F.col(AXIS).alias("s"), F.col(high).alias("h"), F.col(low).alias("l"))).over(ahead)).withColumn("_up", up).withColumn("_down", down)
    hit = F.filter("_ahead", lambda x: (x["h"] >= F.col("_up")) | (x["l"] <= F.col("_down")))
    first = F.try_element_at(hit, F.lit(1))
    kind = (
        F.when(first.isNull(), "none")
        .when((first["h"] >= F.col("_up")) & (first["l"] <= F.col("_down")), "both")
        .when(first["h"] >= F.col("_up"), "up")
        .otherwise("down")
    )
    return listed.select(*base, (first["s"] - F.col(AXIS)).alias("touch_at"), kind.alias("touch"))
