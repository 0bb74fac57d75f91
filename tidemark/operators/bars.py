"""The accepted row of each key among several deliveries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accepted(deliveries: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` (NULL first) per ``key``: key columns and ``values``.

    Ties in ``order`` are settled by the values, so the result does not depend on the order of rows. A key
    with a NULL part is no key and is left out. It is an aggregate with a partial step per task, so a key
    delivered many times shuffles one row per task.
    """
    payload = [c for c in values if c not in order]
    kept = deliveries.select(*dict.fromkeys([*key, *order, *values]))
    for k in key:
        kept = kept.where(F.col(k).isNotNull())
    best = kept.groupBy(*key).agg(F.max(F.struct(*order, *payload)).alias("_best"))
    return best.select(*key, *[F.col(f"_best.{v}").alias(v) for v in values])
