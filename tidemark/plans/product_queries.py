"""Compositions, simulations, documents and scalar functions (survey rows C.., D.., E.., F.., L.., K..), with their SQL."""

from __future__ import annotations


from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.functions import factors as _factors  # noqa: F401
from tidemark.operators import portfolio, series, xsec
from tidemark.plans.base import PANEL_SQL, bars, panel, r6
from tidemark.scale import scratch_dir
from tidemark.sources.tables import load
from tidemark.sources.versions import VersionedTable, as_json, from_json_rows, upsert

QUERIES, ORACLES = {}, {}
LAG = "OVER (PARTITION BY security_id ORDER BY session_no)"
RET = f"{PANEL_SQL}, ret AS (SELECT *, adj_close / nullif(lag(adj_close) {LAG}, 0) - 1 AS ret FROM panel)"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


FACTORS = f"""{RET}, wide AS (SELECT security_id, session_no, lag(adj_close, 0) {LAG} / nullif(lag(adj_close, 21) {LAG}, 0) - 1 AS m, CASE WHEN count(ret) OVER w >= 16 THEN stddev_samp(ret) OVER w END AS v FROM ret WINDOW w AS (PARTITION BY security_id ORDER BY session_no ROWS 19 PRECEDING)),
long AS (SELECT security_id, session_no, 'MOM_1M' AS factor_id, m AS raw, 1 AS dir FROM wide UNION ALL SELECT security_id, session_no, 'VOL_20D', v, -1 FROM wide),
last AS (SELECT * FROM long WHERE raw IS NOT NULL), med AS (SELECT *, median(raw) OVER g AS med FROM last WINDOW g AS (PARTITION BY factor_id, session_no)),
mad AS (SELECT *, median(abs(raw - med)) OVER (PARTITION BY factor_id, session_no) AS mad FROM med),
win AS (SELECT *, CASE WHEN mad > 0 THEN greatest(least(raw, med + 3 * 1.4826 * mad), med - 3 * 1.4826 * mad) ELSE raw END AS x FROM mad),
z AS (SELECT *, (x - avg(x) OVER g) / nullif(stddev_samp(x) OVER g, 0) AS z FROM win WINDOW g AS (PARTITION BY factor_id, session_no))"""


@query(f"""WITH {FACTORS} SELECT security_id, session_no, factor_id, round(raw, 6) + 0.0 AS raw, round(z, 6) + 0.0 AS clean, rank() OVER (PARTITION BY factor_id, session_no ORDER BY round(z * dir, 9) DESC) AS rank FROM z WHERE z IS NOT NULL""")
def c01_registered_factors(spark, at, month_ends=False):
    """From bars to ranked factors: registered factors over one panel, clipped, standardised and ranked by their sign; of every session, or of each month's last one."""
    from tidemark.plans.base import sessions

    df = panel(spark, at, "adj_close", "volume").withColumn("ret", series.change("adj_close"))
    long = fn.factor_values(df, ["MOM_1M", "VOL_20D"]).where("value IS NOT NULL")
    if month_ends:
        # a row per month of the calendar
        output = sessions(spark, at).groupBy(F.trunc("session_date", "month")).agg(F.max("session_no").alias("session_no")).select("session_no")
        long = long.join(F.broadcast(output), "session_no", "left_semi")
    by = ["factor_id", "session_no"]
    z = xsec.zscore(xsec.winsorize_mad(long, "value", by, "_w"), "_w", by, "z").where(F.col("z").isNotNull())
    best = Window.partitionBy(*by).orderBy(F.round(F.col("z") * F.col("direction"), 9).desc())
    return z.select("security_id", "session_no", "factor_id", r6(F.col("value")).alias("raw"), r6(F.col("z")).alias("clean"), F.rank().over(best).alias("rank"))


@query(f"""WITH {PANEL_SQL}, o AS (SELECT security_id, session_no, close AS price, volume, round(volume * 0.03) AS q FROM panel WHERE close > 0 AND volume > 0)
SELECT security_id, session_no, round(2 + 0.1 * pow(least(q / volume, 0.025), 2) * 10000, 6) + 0.0 AS slippage, round(least(greatest(q * 0.005, 1), q * price * 0.01), 6) + 0.0 AS fee, least(q, floor(volume * 0.025)) AS filled, floor(10000 / (price + 0.005)) AS affordable FROM o""")
def l08_l12_execution_costs(spark, at):
    """Slippage, fee, fill and affordable quantity of an order for three hundredths of the volume."""
    o = bars(spark, at, "close", "volume").where("close > 0 AND volume > 0").withColumn("q", F.round(F.col("volume") * 0.03))
    q, v, p = F.col("q"), F.col("volume"), F.col("close")
    return o.select("security_id", "session_no", r6(portfolio.slippage_bps(q, v)).alias("slippage"), r6(portfolio.commission(q, p)).alias("fee"), portfolio.fillable(q, v).cast("double").alias("filled"), portfolio.affordable(F.lit(10_000.0), p).cast("double").alias("affordable"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY ticker, event_date, kind ORDER BY observed_at, doc_id) AS n FROM documents WHERE ticker IS NOT NULL AND event_date IS NOT NULL) SELECT doc_id, ticker, kind FROM k WHERE n = 1""")
def e08_st17_first_per_key(spark, at):
    """One document per ticker, day and kind: the first to be seen."""
    d = load(spark, at, "documents", "doc_id", "ticker", "kind", "event_date", "observed_at").dropna(subset=["ticker", "event_date"])
    n = F.row_number().over(Window.partitionBy("ticker", "event_date", "kind").orderBy(F.col("observed_at").asc_nulls_last(), "doc_id"))
    return d.withColumn("n", n).where("n = 1").select("doc_id", "ticker", "kind")


@query("""WITH d AS (SELECT DISTINCT ticker, CAST(observed_at AS DATE) AS day FROM documents WHERE ticker IS NOT NULL), s AS (SELECT session_date AS day FROM trading_sessions), t AS (SELECT DISTINCT ticker FROM d)
SELECT ticker, count(*) AS expected, count(d.day) AS seen FROM t CROSS JOIN s LEFT JOIN d USING (ticker, day) GROUP BY 1""")
def e16_expected_slots(spark, at):
    """Of all sessions as expected days, those on which something was seen: counted without forming the missing ones."""
    from tidemark.plans.base import sessions

    days = sessions(spark, at).select(F.col("session_date").alias("day"), F.lit(1).alias("_e"))
    d = load(spark, at, "documents", "ticker", "observed_at").where("ticker IS NOT NULL").select("ticker", F.to_date("observed_at").alias("day")).distinct()
    n = days.count()
    return d.join(F.broadcast(days), "day", "left").groupBy("ticker").agg(F.lit(n).cast("bigint").alias("expected"), F.count("_e").alias("seen"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) - CAST(CAST(l_quantity AS DECIMAL(18,2)) * 1000 AS DECIMAL(18,2)) AS DOUBLE) AS difference, CASE WHEN l_quantity = 0 THEN 'NO_BASE' WHEN l_extendedprice > l_quantity * 1000 THEN 'ABOVE' ELSE 'BELOW' END AS side FROM lineitem""")
def e20_decimal_comparison(spark, at):
    """Exact difference of two amounts."""
    d = lambda c: c.cast("decimal(18,2)")
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return load(spark, at, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").select("l_orderkey", "l_linenumber", (d(p) - d(d(q) * 1000)).cast("double").alias("difference"), F.when(q == 0, "NO_BASE").when(p > q * 1000, "ABOVE").otherwise("BELOW").alias("side"))


@query("""SELECT DISTINCT ticker, CASE WHEN regexp_matches(regexp_replace(upper(trim(ticker)), '[./]', '-', 'g'), '^[A-Z0-9-]{1,15}$') THEN regexp_replace(upper(trim(ticker)), '[./]', '-', 'g') END AS canonical,
  regexp_replace(regexp_replace(lower(ticker), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, regexp_replace(lower(ticker), '[^a-z0-9]+', '_', 'g') AS alias FROM coverage_bars WHERE ticker IS NOT NULL""")
def f01_f03_f04_names(spark, at):
    """Canonical forms of names."""
    t = F.col("ticker")
    return load(spark, at, "coverage_bars", "ticker").where(t.isNotNull()).distinct().select("ticker", fn.canonical_ticker(t).alias("canonical"), fn.slug(t).alias("slug"), fn.alias(t).alias("alias"))


@query("SELECT doc_id, sha256(coalesce(document_id, chr(0)) || chr(31) || coalesce(kind, chr(0))) AS digest FROM documents")
def f05_digest(spark, at):
    """Stable ids of rows."""
    return load(spark, at, "documents", "doc_id", "document_id", "kind").select("doc_id", fn.digest(F.col("document_id"), F.col("kind")).alias("digest"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.missing') IS NULL AS absent FROM events")
def f06_f07_json(spark, at):
    """Fields of JSON texts by a fixed schema."""
    e = load(spark, at, "events", "event_id", "props").withColumn("p", F.from_json("props", "k BIGINT, missing STRING"))
    return e.select("event_id", F.col("p.k").alias("k"), F.col("p.missing").isNull().alias("absent"))


@query(f"WITH {RET}, k AS (SELECT security_id, session_no, adj_close / nullif(lag(adj_close, 5) {LAG}, 0) - 1 AS a, adj_close / nullif(lag(adj_close, 20) {LAG}, 0) - 1 AS b FROM panel) SELECT security_id, session_no, round(CASE WHEN a > -1 AND b > -1 AND b <> 0 THEN ln(1 + a) / ln(1 + b) END, 3) + 0.0 AS share, CASE WHEN b >= 0.1 THEN 'STRONG' WHEN b >= 0 THEN 'UP' WHEN b IS NOT NULL THEN 'DOWN' END AS label FROM k WHERE b IS NULL OR abs(b) > 0.001")
def f17_f18_shares(spark, at):
    """Share of the last five sessions in the change of twenty, and a banded label."""
    k = panel(spark, at, "adj_close").withColumns({"a": series.change("adj_close", 5), "b": series.change("adj_close", 20)}).where("b IS NULL OR abs(b) > 0.001")
    return k.select("security_id", "session_no", (F.round(fn.log_share(F.col("a"), F.col("b")), 3) + F.lit(0.0)).alias("share"), fn.band_label(F.col("b"), [(0.1, "STRONG"), (0.0, "UP")], "DOWN").alias("label"))


@query("SELECT strftime(date, '%Y-%m-%d') AS day, count(*) AS rows FROM eligibility_audit WHERE date BETWEEN DATE '2025-01-15' AND DATE '2025-04-30' GROUP BY 1")
def k01_s02_versioned_table(spark, at):
    """A table written as a version partitioned by month, gated, published and read back by a range of days."""
    audit = load(spark, at, "eligibility_audit", "date", "security_id", "eligible")
    table = VersionedTable(spark, scratch_dir(spark, "audit"), month_of="date")
    table.write(audit, "v1", {"keys": F.count_if(F.col("security_id").isNull()) == 0})
    table.publish("v1")
    return table.read(start="2025-01-15", end="2025-04-30").groupBy(F.date_format("date", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM (SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders) GROUP BY 1")
def k14_upsert(spark, at):
    """Changed rows merged into a table by key."""
    o = load(spark, at, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    changes = o.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("X"))
    merged = upsert(o, changes, ["o_orderkey"], [])
    return merged.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT security_id, factor_id, CAST(date AS VARCHAR) AS day, pit_member FROM factor_values")
def k13_s26_json_rows(spark, at):
    """Rows through JSON texts and back."""
    f = load(spark, at, "factor_values").select("security_id", "factor_id", F.col("date").cast("string").alias("day"), "pit_member")
    return from_json_rows(as_json(f), "security_id STRING, factor_id STRING, day STRING, pit_member BOOLEAN")
