"""Bars of an event stream, and the state kept between micro-batches.

The same functions build the batch and the streaming plan where both engines allow it. A stream's late rows
are taken in until the watermark passes; a batch over the same rows is the reconciliation for later ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark.scale import scratch_dir


#: columns that order rows by their delivery: files are taken by their time, rows by their place
DELIVERED = ("_file_time", "_row_at")


def stream_table(spark: SparkSession, directory: str, name: str, files_per_batch: int = 8, delivered: bool = False) -> DataFrame:
    """A table of parquet files as a stream with the schema of what is there; with ``delivered``, also the columns ``DELIVERED``."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    df = reader.parquet(f"{directory}/{name}.parquet*")
    if delivered:
        df = df.select("*", F.col("_metadata.file_modification_time").alias(DELIVERED[0]), F.col("_metadata.row_index").alias(DELIVERED[1]))
    # a watermark needs an instant; times without a zone are those of the session's zone
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def tumbling_bars(events: DataFrame, key: str, time: str, tie: str, value: str, length: str) -> DataFrame:
    """(key, bucket, open, high, low, close, volume) of left-closed buckets; first and last by time, then ``tie``."""
    order = F.struct(time, tie)
    grouped = events.groupBy(key, F.window(time, length).alias("_w")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, order).alias("close"), F.sum(F.lit(1)).alias("volume")
    )
    return grouped.select(key, F.col("_w.start").alias("bucket"), "open", "high", "low", "close", "volume")


def run_to_end(stream: DataFrame, key: list[str] | None, mode: str, name: str) -> DataFrame:
    """Runs a stream over all that is there and returns its result.

    With ``key``, each micro-batch's updates are written under its number, so a batch that is run again
    writes over itself, and the last update of each key is the result. Without, rows are appended.
    """
    spark = stream.sparkSession
    root = scratch_dir(spark, name)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(store).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    stored = spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{root}/out")
    if not key:
        return stored.drop("batch")
    rest = [c for c in stream.columns if c not in key]
    last = stored.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_l"))
    return last.select(*key, *[F.col(f"_l.{c}").alias(c) for c in rest])


def running_state(events: DataFrame, key: str, time: str, value: str, watermark: str) -> DataFrame:
    """(key, n, total, best): count, sum and greatest value per key, kept as state and updated by each micro-batch."""

    def update(keys: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        n, total, best = state.get if state.exists else (0, 0.0, float("-inf"))
        for f in frames:
            v = f[value].dropna()
            n, total, best = n + len(f), total + float(v.sum()), max(best, float(v.max()) if len(v) else best)
        state.update((n, total, best))
        yield pd.DataFrame({key: [keys[0]], "n": [n], "total": [total], "best": [best]})

    kind = dict(events.dtypes)[key]
    out, kept = f"{key} {kind}, n long, total double, best double", "n long, total double, best double"
    rows = events.withWatermark(time, watermark).select(key, time, value)
    return rows.groupBy(key).applyInPandasWithState(update, out, kept, "update", GroupStateTimeout.NoTimeout)


def session_fold(events: DataFrame, key: list[str], row: str, time: str, value: str, volume: str, opening: int, noon: int, delivered: Sequence[str] = DELIVERED) -> DataFrame:
    """(key, n, high, low, last, volume, vwap, range_high, range_low, noon_volume) per session, updated by each micro-batch.

    ``key`` names a session, whose rows are bounded by what one instrument sends in it. The state is a built-in
    aggregate that holds these rows in all their deliveries: what came last by ``delivered`` counts, a
    row that comes late is put in its place, and the session is folded anew, so the result never depends on how
    rows are spread over batches. Rows without a value take no part. ``opening`` and ``noon`` are hours: the end
    of the opening range, and up to where the volume profile counts. Fold and state stay in the JVM: a call of
    Python per session takes 10 ms and more, and there are as many sessions as there are keys and days.
    """
    parts = {"i": row, **{f"d{k}": c for k, c in enumerate(delivered)}, "t": time, "x": value, "v": volume}
    part = F.struct(*[F.col(c).alias(k) for k, c in parts.items()])
    # by row and delivery; the last delivery of each row is the one that no other of the same row follows
    held = events.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*key).agg(F.sort_array(F.collect_list(part)).alias("_all"))
    latest = F.filter("_all", lambda r, at: F.coalesce(F.get("_all", at + 1)["i"] != r["i"], F.lit(True)))
    held = held.select(*key, F.sort_array(F.transform(latest, lambda r: F.struct(r["t"], r["i"], r["x"].cast("double").alias("x"), r["v"].cast("long").alias("v")))).alias("_rows"))

    def values(upto: int = 24) -> Column:
        rows = F.col("_rows") if upto == 24 else F.filter("_rows", lambda r: F.hour(r["t"]) < upto)
        return F.transform(rows, lambda r: r["x"])

    def total(term, kind: str) -> Column:
        return F.aggregate("_rows", F.lit(0).cast(kind), lambda done, r: done + F.coalesce(term(r), F.lit(0).cast(kind)))

    volumes = total(lambda r: r["v"], "long")
    return held.select(
        *key, F.size("_rows").cast("long").alias("n"), F.array_max(values()).alias("high"), F.array_min(values()).alias("low"), F.element_at("_rows", -1)["x"].alias("last"),
        volumes.alias("volume"), (total(lambda r: r["x"] * r["v"], "double") / F.nullif(volumes, F.lit(0))).alias("vwap"),
        F.array_max(values(opening)).alias("range_high"), F.array_min(values(opening)).alias("range_low"), total(lambda r: F.when(F.hour(r["t"]) < noon, r["v"]), "long").alias("noon_volume"),
    )
