"""Parquet tables of one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of ``directory``; with ``columns``, only these, so that the scan reads no others."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.select(*columns) if columns else df
