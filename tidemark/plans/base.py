"""The bar panel that the queries share, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import series
from tidemark.operators.bars import accepted
from tidemark.scale import broadcast_if_bounded, nan_to_null
from tidemark.sources.tables import load

PRICES = ("open", "high", "low", "close", "adj_close", "volume", "unadjusted_close")
DELIVERY = ("source_asof", "ingestion_run_id")


def r6(value: Column) -> Column:
    """Rounded for comparison with SQL; no negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def sessions(spark: SparkSession, at: str) -> DataFrame:
    return load(spark, at, "trading_sessions", "session_date", "session_no").dropna().dropDuplicates(["session_date"])


def bars(spark: SparkSession, at: str, *columns: str) -> DataFrame:
    """Accepted bars on sessions: security_id, session_no, date, and ``columns`` (all prices by default) without NaN or infinities."""
    columns = columns or PRICES
    rows = load(spark, at, "coverage_bars", "security_id", "date", *columns, *DELIVERY)
    best = accepted(rows, ("security_id", "date"), DELIVERY, columns)
    calendar = sessions(spark, at)
    clean = [nan_to_null(F.col(c)).alias(c) if c in PRICES else F.col(c) for c in columns]
    joined = best.join(broadcast_if_bounded(calendar, load(spark, at, "trading_sessions")), F.col("date") == F.col("session_date"))
    return joined.select("security_id", F.col("session_no").cast("int").alias("session_no"), "date", *clean)


def panel(spark: SparkSession, at: str, *columns: str) -> DataFrame:
    """``bars`` on the dense session axis."""
    return series.dense(bars(spark, at, *columns))


_LIST = ", ".join(f"CASE WHEN isfinite(v.{c}) THEN v.{c} END AS {c}" for c in PRICES)

#: common table expressions: bars (accepted, on sessions) and panel (dense)
BARS_SQL = f"""
acc AS (SELECT security_id, date, arg_max({{{', '.join(f"'{c}': {c}" for c in PRICES)}, 'ticker': ticker}}, row(coalesce(source_asof, DATE '0001-01-01'), ingestion_run_id)) AS v
  FROM coverage_bars WHERE security_id IS NOT NULL AND date IS NOT NULL GROUP BY ALL),
bars AS (SELECT security_id, CAST(session_no AS INT) AS session_no, date, v.ticker AS ticker, {_LIST}
  FROM acc JOIN trading_sessions ON session_date = date)"""

PANEL_SQL = f"""{BARS_SQL},
spine AS (SELECT security_id, CAST(unnest(generate_series(min(session_no), max(session_no))) AS INT) AS session_no FROM bars GROUP BY 1),
panel AS (SELECT spine.security_id, spine.session_no, bars.* EXCLUDE (security_id, session_no) FROM spine LEFT JOIN bars USING (security_id, session_no))"""


def sql(body: str, dense: bool = True) -> str:
    return f"WITH {PANEL_SQL if dense else BARS_SQL}{body}"
