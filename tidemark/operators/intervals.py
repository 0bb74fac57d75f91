"""Continuous periods and gaps of day intervals, merged in two levels for huge entities.

The intervals of a huge entity are clipped into time shards, so that it is merged by many tasks; each shard
is merged by itself; only periods that touch a shard's boundary are stitched across shards. An entity with
few intervals is one shard, so that open-ended intervals aren't copied. Before the first merge, rows are
reduced to the furthest end per entity, shard and start, so a shard of an entity never holds more rows than
it has days, however many rows the entity has.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scale import broadcast_if_bounded, hot_keys

_EPOCH = date(1970, 1, 1)
FIRST_DAY = (date(1, 1, 1) - _EPOCH).days
LAST_DAY = (date(9999, 12, 31) - _EPOCH).days


class Shards:
    """Shards of ``days`` days from ``start`` to ``end``; one more on either side takes what lies outside."""

    def __init__(self, days: int = 3653, start: date = date(1900, 1, 1), end: date = date(2100, 1, 1)):
        self.days, self.low = days, (start - _EPOCH).days
        self.count = -(-((end - _EPOCH).days - self.low) // days)

    def of(self, day: Column) -> Column:
        inside = F.floor((day - self.low) / self.days).cast("int") + 1
        return F.greatest(F.lit(0), F.least(F.lit(self.count + 1), inside))

    def first(self, shard: Column) -> Column:
        return F.when(shard == 0, F.lit(FIRST_DAY)).otherwise(F.lit(self.low) + (shard - 1) * self.days)

    def last(self, shard: Column) -> Column:
        return F.when(shard == self.count + 1, F.lit(LAST_DAY)).otherwise(F.lit(self.low) + shard * self.days - 1)


def _coalesced(df: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping, nested and adjoining (_from, _to) of each ``by`` as one row."""
    w = Window.partitionBy(*by).orderBy("_from", "_to")
    reached = F.max("_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reached.isNull() | (F.col("_from") > reached + 1), 1).otherwise(0)
    islands = df.withColumn("_starts", starts).withColumn("_island", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "_island").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to")).drop("_island")


def merged_periods(intervals: DataFrame, entity: str, start: str, end: str, shards: Shards | None = None, rows_per_task: int = 20_000) -> DataFrame:
    """(_entity, _from, _to) in days since 1970: the continuous periods of each entity.

    ``start`` and ``end`` are dates, both inclusive; NULL is unbounded and becomes the first or last day of
    the calendar. Intervals that end before they start, and rows without an entity, are ignored. Entities
    with more than ``rows_per_task`` intervals are merged by shards.
    """
    shards = shards or Shards()
    days = intervals.select(
        F.col(entity).alias("_entity"),
        F.coalesce(F.unix_date(start), F.lit(FIRST_DAY)).alias("_from"),
        F.coalesce(F.unix_date(end), F.lit(LAST_DAY)).alias("_to"),
    ).where(F.col("_entity").isNotNull() & (F.col("_from") <= F.col("_to")))
    huge = hot_keys(days.select("_entity"), "_entity", rows_per_task).select("_entity", F.lit(True).alias("_huge"))
    own = F.when(F.col("_huge"), F.sequence(shards.of(F.col("_from")), shards.of(F.col("_to")))).otherwise(F.array(F.lit(-1)))
    alone = F.col("_shard") < 0
    clipped = (
        days.join(broadcast_if_bounded(huge), "_entity", "left")
        .withColumn("_shard", F.explode(own))
        .select(
            "_entity",
            "_shard",
            F.when(alone, F.col("_from")).otherwise(F.greatest("_from", shards.first(F.col("_shard")))).alias("_from"),
            F.when(alone, F.col("_to")).otherwise(F.least("_to", shards.last(F.col("_shard")))).alias("_to"),
        )
        .groupBy("_entity", "_shard", "_from")
        .agg(F.max("_to").alias("_to"))
    )
    local = _coalesced(clipped, ["_entity", "_shard"])
    low = (F.col("_shard") > 0) & (F.col("_from") == shards.first(F.col("_shard")))
    high = ~alone & (F.col("_shard") <= shards.count) & (F.col("_to") == shards.last(F.col("_shard")))
    whole = local.where(~(low | high)).select("_entity", "_from", "_to")
    return whole.unionByName(_coalesced(local.where(low | high).select("_entity", "_from", "_to"), ["_entity"]))


def periods_and_gaps(periods: DataFrame) -> DataFrame:
    """(_entity, kind, _from, _to): each period, and each stretch between two successive periods as a ``gap``.

    Periods of an entity don't touch, so an entity has at most half as many as the calendar has days.
    """
    following = F.lead("_from").over(Window.partitionBy("_entity").orderBy("_from"))
    rows = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("_from"), F.col("_to")),
        F.struct(F.lit("gap").alias("kind"), (F.col("_to") + 1).alias("_from"), (F.col("_next") - 1).alias("_to")),
    )
    return (
        periods.withColumn("_next", following)
        .select("_entity", F.explode(rows).alias("_row"))
        .select("_entity", "_row.*")
        .where(F.col("_to").isNotNull())
    )
