"""What changed between full snapshots of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scale import broadcast_if_bounded

_SPACE = " \t\r\n "


def canonical(column: Column, kind: str) -> Column:
    """Text trimmed and in upper case, empty as NULL; other types as text."""
    if kind == "string":
        return F.nullif(F.upper(F.btrim(column, F.lit(_SPACE))), F.lit(""))
    return column.cast("string")


def row_digest(df: DataFrame, columns: Sequence[str]) -> Column:
    """128-bit hash of the canonical values. Each value goes in with its length, NULL as a length of its own, so that neighbours can't run together."""
    kinds = dict(df.dtypes)
    parts = []
    for name in columns:
        value = canonical(df[name], kinds[name])
        parts.append(F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.md5(F.concat_ws("|", *parts))) if parts else F.lit(None).cast("binary")


def delivered_rows(
    rows: DataFrame,
    *,
    generation: str,
    key: str,
    compare: Sequence[str],
    latest: str | None = None,
    active: tuple[str, str] | None = None,
) -> DataFrame:
    """One row per generation and key: (_generation, _key, _digest, _active).

    Rows without a generation or key are no records and are left out. Where a generation delivers a key
    more than once, the row with the greatest ``latest`` (NULL first, then the greatest digest) counts.
    ``_active`` tells whether any delivered row of the key has ``active[1]`` in column ``active[0]``.
    The aggregate combines per task before its one shuffle.
    """
    kinds = dict(rows.dtypes)
    is_active = F.coalesce(canonical(rows[active[0]], kinds[active[0]]) == active[1].upper(), F.lit(False)) if active else F.lit(True)
    return (
        rows.select(
            rows[generation].alias("_generation"),
            rows[key].alias("_key"),
            (rows[latest] if latest else F.lit(None).cast("timestamp")).alias("_latest"),
            row_digest(rows, compare).alias("_digest"),
            is_active.alias("_active"),
        )
        .where(F.col("_generation").isNotNull() & F.col("_key").isNotNull())
        .groupBy("_generation", "_key")
        .agg(F.max(F.struct("_latest", "_digest")).alias("_row"), F.max("_active").alias("_active"))
        .select("_generation", "_key", F.col("_row._digest").alias("_digest"), "_active")
    )


def complete_generations(
    generations: DataFrame,
    delivered: DataFrame,
    *,
    generation: str,
    series: str,
    order: Sequence[str],
    status: tuple[str, str],
    row_count: str,
    active_count: str,
) -> DataFrame:
    """The usable generations with the usable one before each: (_series, _generation, _before).

    Usable means: the status fits, and the delivered keys and active keys number what the generation
    announces; NULL figures fit nothing. Generations of a series follow each other by ``order``, then by
    id. A repeated generation row counts once (the last by ``order``). ``_before`` of the first is NULL.
    """
    last = Window.partitionBy(generation).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    kinds = dict(generations.dtypes)
    announced = (
        generations.withColumn("_nth", F.row_number().over(last))
        .where("_nth = 1")
        .where(canonical(F.col(status[0]), kinds[status[0]]) == status[1].upper())
        .select(
            F.col(generation).alias("_generation"),
            F.col(series).alias("_series"),
            F.struct(*order, generation).alias("_order"),
            F.col(row_count).alias("_announced"),
            F.col(active_count).alias("_announced_active"),
        )
    )
    counts = delivered.groupBy("_generation").agg(F.count(F.lit(1)).alias("_rows"), F.count_if("_active").alias("_actives"))
    usable = announced.join(counts, "_generation", "left").where(
        (F.coalesce("_rows", F.lit(0)) == F.col("_announced")) & (F.coalesce("_actives", F.lit(0)) == F.col("_announced_active"))
    )
    return usable.select(
        "_series", "_generation", F.lag("_generation").over(Window.partitionBy("_series").orderBy("_order")).alias("_before")
    )


def snapshot_changes(delivered: DataFrame, usable: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """(_generation, _key, change_kind) for every key added, removed or changed since the usable generation before.

    A full outer join on generation and key compares row digests; a missing side is an addition or a
    removal. The current side keeps the partitioning of ``delivered``, so only the side of the earlier
    generation is shuffled again. ``usable`` is metadata of one row per delivery and is broadcast only
    while ``counted`` has few rows.
    """
    pairs = usable.where(F.col("_before").isNotNull()).select("_generation", "_before")
    pairs = broadcast_if_bounded(pairs, counted)
    now = delivered.join(pairs.select("_generation"), "_generation").select("_generation", "_key", F.col("_digest").alias("_now"))
    then = (
        delivered.withColumnRenamed("_generation", "_before")
        .join(pairs, "_before")
        .select("_generation", "_key", F.col("_digest").alias("_then"))
    )
    kind = (
        F.when(F.col("_then").isNull(), "added").when(F.col("_now").isNull(), "removed").when(F.col("_now") != F.col("_then"), "changed")
    )
    return (
        now.join(then, ["_generation", "_key"], "full_outer")
        .select("_generation", "_key", kind.alias("change_kind"))
        .where(F.col("change_kind").isNotNull())
    )
