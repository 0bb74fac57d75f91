"""Sequential rules over short ordered lists, as array expressions inside one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confirmed_state(df: DataFrame, raw: str, key: Sequence[str], order: str, n: int, out: str) -> DataFrame:
    """The last raw state that held for ``n`` rows in a row; NULL before there is one.

    A run of equal states confirms at its n-th row, so the sequential rule is two windows: the position in
    the run, and the last confirmed state so far.
    """
    w = Window.partitionBy(*key).orderBy(order)
    changed = F.coalesce(~F.col(raw).eqNullSafe(F.lag(raw).over(w)), F.lit(True)) | F.lag(raw).over(w).isNull()
    df = df.withColumn("_run", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy(*key, "_run").orderBy(order))
    df = df.withColumn("_sure", F.when((place >= n) & F.col(raw).isNotNull(), F.col(raw)))
    return df.withColumn(out, F.last("_sure", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_run", "_sure")


def with_cooldown(events: DataFrame, key: Sequence[str], axis: str, cooldown: int) -> DataFrame:
    """Of each key's events, those that lie more than ``cooldown`` after the last one kept.

    The rule is greedy and sequential; a key's event positions are one sorted array that is folded once. Only
    positions are in the array, at most one per position of the axis.
    """
    listed = events.select(*key, axis).distinct().groupBy(*key).agg(F.array_sort(F.collect_list(axis)).alias("_a"))

    def step(kept: Column, x: Column) -> Column:
        return F.when((F.size(kept) == 0) | (x - F.element_at(kept, -1) > cooldown), F.concat(kept, F.array(x))).otherwise(kept)

    empty = F.slice("_a", 1, 0)
    return listed.select(*key, F.explode(F.aggregate("_a", empty, step)).alias(axis))


def quadrant(x: Column, y: Column, dead_x: float, dead_y: float) -> Column:
    """One of four quadrants; NULL inside the dead bands or without values."""
    return (
        F.when((x > dead_x) & (y > dead_y), "LEADING")
        .when((x > dead_x) & (y < -dead_y), "FADING")
        .when((x < -dead_x) & (y > dead_y), "RISING")
        .when((x < -dead_x) & (y < -dead_y), "LAGGING")
    )


def cups(df: DataFrame, key: str, axis: str, high: str, low: str, widths: tuple[int, int], depth: tuple[float, float], rim: float) -> DataFrame:
    """Pairs of local highs with a trough between them: (key, left, right, depth, score), the best left rim for each right one.

    For each local high, the local highs of the last ``widths[1]`` sessions come as one framed list, and the
    lowest low in between from the same frame; no pair of rows is joined.
    """
    w = Window.partitionBy(key).orderBy(axis)
    peak = (F.col(high) >= F.max(high).over(w.rowsBetween(-2, 2))) & (F.count(high).over(w.rowsBetween(-2, 2)) == 5)
    rows = df.withColumn("_peak", peak).withColumn("_l", F.collect_list(F.struct(F.col(axis).alias("s"), F.col(high).alias("h"), F.col(low).alias("l"), F.col("_peak").alias("p"))).over(w.rowsBetween(-widths[1], -1)))
    left = rows.where("_peak").withColumn("_c", F.filter("_l", lambda x: x["p"] & (F.col(axis) - x["s"] >= widths[0]) & (F.abs(x["h"] / F.col(high) - 1) <= rim)))

    def measured(x: Column) -> Column:
        trough = F.array_min(F.transform(F.filter("_l", lambda y: y["s"] > x["s"]), lambda y: y["l"]))
        d = 1 - trough / F.least(x["h"], F.col(high))
        return F.struct((100 * (1 - F.abs(x["h"] / F.col(high) - 1) / rim) + 0.0).alias("score"), x["s"].alias("left"), d.alias("depth"))

    best = left.withColumn("_b", F.array_max(F.filter(F.transform("_c", measured), lambda m: (m["depth"] >= depth[0]) & (m["depth"] <= depth[1]))))
    return best.where(F.col("_b").isNotNull()).select(key, F.col("_b.left").alias("left"), F.col(axis).alias("right"), F.col("_b.depth").alias("depth"), F.col("_b.score").alias("score"))
