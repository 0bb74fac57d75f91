"""Attributes as they were known at event time.

Every attribute has a change history of its own: keys, the day from which a value is known, the value. No
history is widened into versions of all attributes, so attributes may change at different times and for
different keys. The histories and the events' requests go through one long table; each attribute is matched
by itself to the last value known at the request's day, and the matches are pivoted back to one row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class History:
    """Changes of one attribute: ``df`` has the columns ``keys``, ``known`` and ``value``.

    With ``greatest``, the attribute is the greatest value known so far instead of the last one.
    Of several values known from the same day on, the greatest counts. Rows with a NULL key, day or value
    are no change and are left out.
    """

    df: DataFrame
    keys: Sequence[str]
    known: str
    value: str
    greatest: bool = False


def last_known(requests: DataFrame, time: str, histories: Mapping[str, History]) -> DataFrame:
    """``requests`` (distinct rows; its columns hold every history's keys and ``time``) with a column per attribute.

    A value known from the request's own day on counts; NULL where nothing is known. Both sides are reduced
    to distinct keys and days before they meet, so a key has no more rows in a task than there are days.
    """
    if not histories:
        return requests
    ids = [c for c in requests.columns]
    types = {name: h.df.schema[h.value].dataType for name, h in histories.items()}
    values = lambda own, value: F.struct(*[(value if n == own else F.lit(None).cast(t)).alias(n) for n, t in types.items()])
    long = None
    for name, h in histories.items():
        keys = lambda: F.array(*[F.col(k).cast("string") for k in h.keys]).cast("array<string>")  # noqa: B023, E731
        changes = h.df.select(*dict.fromkeys([*h.keys, h.known, h.value])).dropna()
        changes = changes.groupBy(*[F.col(k) for k in h.keys], F.col(h.known)).agg(F.max(h.value).alias("_v"))
        changes = changes.select(
            F.lit(name).alias("_attribute"), keys().alias("_keys"), F.col(h.known).alias("_time"), F.lit(0).alias("_asks"),
            values(name, F.col("_v")).alias("_value"), F.lit(None).cast(requests.select(F.struct(*ids).alias("r")).schema["r"].dataType).alias("_request"),
        )
        asked = requests.select(
            F.lit(name).alias("_attribute"), keys().alias("_keys"), F.col(time).alias("_time"), F.lit(1).alias("_asks"),
            F.lit(None).cast(changes.schema["_value"].dataType).alias("_value"), F.struct(*ids).alias("_request"),
        )
        part = changes.unionByName(asked)
        long = part if long is None else long.unionByName(part)
    seen = Window.partitionBy("_attribute", "_keys").orderBy("_time", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    matched = long.select(
        "_request",
        *[
            (F.max(f"_value.{n}") if h.greatest else F.last(f"_value.{n}", ignorenulls=True)).over(seen).alias(f"_known_{n}")
            for n, h in histories.items()
        ],
    ).where(F.col("_request").isNotNull())
    pivoted = matched.groupBy("_request").agg(*[F.max(f"_known_{n}").alias(n) for n in histories])
    return pivoted.select("_request.*", *histories)
