"""Streaming queries and their batch twins, and sequential rules (survey rows ST.., W31 to W40), with their SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import series, states
from tidemark.plans.base import BARS_SQL, PANEL_SQL, bars, panel, r6
from tidemark.sources.tables import load
from tidemark.streaming import bars as stream

QUERIES, ORACLES = {}, {}
LAG = "OVER (PARTITION BY security_id ORDER BY session_no)"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def text(c: str = "bucket"):
    return F.date_format(c, "yyyy-MM-dd HH:mm").alias("bucket")


B = """b AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS t, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY ALL)"""
BARS = f"WITH {B} SELECT user_id, strftime(t, '%Y-%m-%d %H:%M') AS bucket, open, high, low, close, volume FROM b"


def _events(spark: SparkSession, at: str):
    return load(spark, at, "events", "event_id", "ts", "user_id", "event_type", "value")


def _bars(spark: SparkSession, at: str):
    return stream.tumbling_bars(_events(spark, at), "user_id", "ts", "event_id", "value", "6 hours")


@query(BARS)
def st01_tumbling_bars(spark, at):
    """Bars of six hours, in batch."""
    return _bars(spark, at).select("user_id", text(), "open", "high", "low", "close", "volume")


@query(BARS)
def st01_tumbling_bars_stream(spark, at):
    """The same bars from a stream with a watermark: updates of each micro-batch, the last one per bar."""
    events = stream.stream_table(spark, at, "events").withWatermark("ts", "2 days")
    out = stream.run_to_end(stream.tumbling_bars(events, "user_id", "ts", "event_id", "value", "6 hours"), ["user_id", "bucket"], "update", "bars")
    return out.select("user_id", text(), "open", "high", "low", "close", "volume")


@query("SELECT event_id, user_id, event_type FROM (SELECT DISTINCT event_id, user_id, event_type FROM events)")
def st17_distinct_stream(spark, at):
    """Events of a stream once each, within the watermark."""
    events = stream.stream_table(spark, at, "events").select("event_id", "user_id", "event_type", "ts").withWatermark("ts", "2 days")
    return stream.run_to_end(events.dropDuplicatesWithinWatermark(["event_id"]), None, "append", "distinct").select("event_id", "user_id", "event_type")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) + 0.0 AS total, round(max(value), 6) + 0.0 AS best FROM events GROUP BY 1")
def st06_running_state_stream(spark, at):
    """Count, sum and greatest value per user, kept as state."""
    out = stream.run_to_end(stream.running_state(stream.stream_table(spark, at, "events"), "user_id", "ts", "value", "2 days"), ["user_id"], "update", "state")
    return out.select("user_id", "n", (F.round("total", 4) + F.lit(0.0)).alias("total"), r6(F.col("best")).alias("best"))


@query(f"WITH {B} SELECT user_id, strftime(t, '%Y-%m-%d %H:%M') AS bucket, " + ", ".join(f"round(CASE WHEN count(*) OVER w{n} = {n} THEN avg(close) OVER w{n} END, 6) + 0.0 AS ma{n}" for n in (10, 20)) + " FROM b WINDOW " + ", ".join(f"w{n} AS (PARTITION BY user_id ORDER BY t ROWS {n - 1} PRECEDING)" for n in (10, 20)))
def st02_bar_averages(spark, at):
    """Moving averages over bars, across days."""
    w = Window.partitionBy("user_id").orderBy("bucket")
    mean = lambda n: r6(F.when(F.count(F.lit(1)).over(w.rowsBetween(-(n - 1), 0)) == n, F.avg("close").over(w.rowsBetween(-(n - 1), 0))))
    return _bars(spark, at).select("user_id", text(), mean(10).alias("ma10"), mean(20).alias("ma20"))


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS d, ts, value, ts < date_trunc('day', ts) + INTERVAL 8 HOUR AS early FROM events), o AS (SELECT user_id, d, max(value) FILTER (early) AS hi, min(value) FILTER (early) AS lo, max(value) FILTER (NOT early) AS later FROM e GROUP BY ALL)
SELECT user_id, strftime(d, '%Y-%m-%d') AS day, hi, lo, coalesce(later >= hi, false) AS triggered FROM o WHERE hi IS NOT NULL""")
def st03_opening_ranges(spark, at):
    """Range of each day's first eight hours and whether it is passed later."""
    e = _events(spark, at).withColumn("early", F.hour("ts") < 8)
    o = e.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.max(F.when(F.col("early"), F.col("value"))).alias("hi"), F.min(F.when(F.col("early"), F.col("value"))).alias("lo"), F.max(F.when(~F.col("early"), F.col("value"))).alias("later"))
    return o.where("hi IS NOT NULL").select("user_id", F.date_format("d", "yyyy-MM-dd").alias("day"), "hi", "lo", F.coalesce(F.col("later") >= F.col("hi"), F.lit(False)).alias("triggered"))


@query(f"""WITH {B}, v AS (SELECT *, hour(t) AS h, CAST(t AS DATE) AS d, sum(close * volume) OVER w / sum(volume) OVER w AS vwap, sum(volume) OVER w AS cum FROM b WINDOW w AS (PARTITION BY user_id, CAST(t AS DATE) ORDER BY t)),
u AS (SELECT *, avg(cum) OVER (PARTITION BY user_id, h ORDER BY d ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS usual FROM v)
SELECT user_id, strftime(t, '%Y-%m-%d %H:%M') AS bucket, round(vwap, 6) + 0.0 AS vwap, round(cum / usual, 6) + 0.0 AS relative FROM u""")
def st07_st14_day_metrics(spark, at):
    """Volume-weighted price of the day so far, and its volume against the same time of earlier days."""
    d, h = F.to_date("bucket"), F.hour("bucket")
    w = Window.partitionBy("user_id", d).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    v = _bars(spark, at).withColumns({"vwap": F.sum(F.col("close") * F.col("volume")).over(w) / F.sum("volume").over(w), "cum": F.sum("volume").over(w)})
    past = Window.partitionBy("user_id", h).orderBy(d).rowsBetween(-5, -1)
    return v.withColumn("usual", F.avg("cum").over(past)).select("user_id", text(), r6(F.col("vwap")).alias("vwap"), r6(F.col("cum") / F.col("usual")).alias("relative"))


@query(f"WITH {B}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC) AS k FROM b WHERE t + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events)) SELECT user_id, strftime(t, '%Y-%m-%d %H:%M') AS bucket, close FROM k WHERE k <= 12")
def st05_st08_complete_bars(spark, at):
    """The last twelve complete bars of each user (a bounded report)."""
    b = _bars(spark, at)
    end = _events(spark, at).agg(F.max("ts").alias("_end"))
    done = b.join(F.broadcast(end)).where(F.col("bucket") + F.expr("INTERVAL 6 HOURS") <= F.col("_end"))
    return done.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("bucket").desc()))).where("k <= 12").select("user_id", text(), "close")


@query(f"WITH {B}, g AS (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS n FROM b) SELECT user_id, strftime(unnest(generate_series(t + INTERVAL 6 HOUR, n - INTERVAL 6 HOUR, INTERVAL 6 HOUR)), '%Y-%m-%d %H:%M') AS bucket FROM g WHERE n > t + INTERVAL 6 HOUR")
def st09_j24_missing_bars(spark, at):
    """Every bar that is missing between two others."""
    step = F.expr("INTERVAL 6 HOURS")
    g = _bars(spark, at).select("user_id", "bucket", F.lead("bucket").over(Window.partitionBy("user_id").orderBy("bucket")).alias("n")).where(F.col("n") > F.col("bucket") + step)
    return g.select("user_id", F.explode(F.sequence(F.col("bucket") + step, F.col("n") - step, step)).alias("bucket")).select("user_id", text())


@query("SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS bucket, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def st04_st10_latest_per_slot(spark, at):
    """The latest value of each user and hour."""
    e = _events(spark, at)
    return e.groupBy("user_id", F.date_trunc("hour", "ts").alias("b")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value")).select("user_id", text("b"), "value")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users, round(quantile_cont(value, 0.95), 6) + 0.0 AS p95, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END), 6) + 0.0 AS share FROM events GROUP BY 1")
def st22_a43_g18_day_rollup(spark, at):
    """Counts, the 95th percentile and a share per day."""
    e = _events(spark, at)
    return e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), r6(F.percentile("value", 0.95)).alias("p95"), r6(F.avg((F.col("event_type") == "purchase").cast("double"))).alias("share"))


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase'), x AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events), n AS (SELECT d, row_number() OVER (ORDER BY d) AS no FROM x), j AS (SELECT user_id, no, no - row_number() OVER (PARTITION BY user_id ORDER BY no) AS g FROM d JOIN n USING (d))
SELECT user_id, max(c) AS streak FROM (SELECT user_id, g, count(*) AS c FROM j GROUP BY ALL) GROUP BY 1""")
def g19_streaks(spark, at):
    """The longest run of successive days with a purchase."""
    e = _events(spark, at).withColumn("d", F.to_date("ts"))
    days = e.select("d").distinct().withColumn("no", F.row_number().over(Window.partitionBy().orderBy("d")))
    j = e.where("event_type = 'purchase'").select("user_id", "d").distinct().join(F.broadcast(days), "d")
    j = j.withColumn("g", F.col("no") - F.row_number().over(Window.partitionBy("user_id").orderBy("no")))
    return j.groupBy("user_id", "g").agg(F.count(F.lit(1)).alias("c")).groupBy("user_id").agg(F.max("c").alias("streak"))


@query("""WITH b AS (SELECT event_id, user_id, ts, value, 0 AS p FROM events UNION ALL SELECT event_id, user_id, ts + INTERVAL 1 DAY, value * 2, 1 FROM events WHERE event_type = 'purchase')
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, arg_max(value, (p, ts, event_id)) AS value FROM b GROUP BY ALL""")
def st24_overlay(spark, at):
    """Provisional rows laid over the stored ones of the same day."""
    e = _events(spark, at)
    over = e.where("event_type = 'purchase'").select("event_id", "user_id", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), (F.col("value") * 2).alias("value"), F.lit(1).alias("p"))
    both = e.select("event_id", "user_id", "ts", "value", F.lit(0).alias("p")).unionByName(over)
    return both.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.max_by("value", F.struct("p", "ts", "event_id")).alias("value"))


STATE = f"""{PANEL_SQL}, k AS (SELECT security_id, session_no, adj_close / nullif(lag(adj_close, 20) {LAG}, 0) - 1 AS x, adj_close / nullif(lag(adj_close, 5) {LAG}, 0) - 1 AS y FROM panel),
q AS (SELECT *, CASE WHEN x > 0.005 AND y > 0.002 THEN 'LEADING' WHEN x > 0.005 AND y < -0.002 THEN 'FADING' WHEN x < -0.005 AND y > 0.002 THEN 'RISING' WHEN x < -0.005 AND y < -0.002 THEN 'LAGGING' END AS raw FROM k),
c AS (SELECT *, CASE WHEN raw IS NOT NULL AND raw = lag(raw) {LAG} THEN raw END AS sure FROM q)"""


@query(f"WITH {STATE} SELECT security_id, session_no, raw, last_value(sure IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY session_no ROWS UNBOUNDED PRECEDING) AS state FROM c")
def w31_states(spark, at):
    """Quadrants with dead bands, confirmed by two sessions in a row."""
    k = panel(spark, at, "adj_close").withColumns({"x": series.change("adj_close", 20), "y": series.change("adj_close", 5)})
    q = k.withColumn("raw", states.quadrant(F.col("x"), F.col("y"), 0.005, 0.002))
    return states.confirmed_state(q, "raw", ["security_id"], "session_no", 2, "state").select("security_id", "session_no", "raw", "state")


@query(f"""WITH RECURSIVE {BARS_SQL}, e AS (SELECT security_id, session_no FROM (SELECT *, lag(close) {LAG} AS p FROM bars) WHERE close > p * 1.03),
k AS (SELECT security_id, min(session_no) AS session_no FROM e GROUP BY 1 UNION ALL SELECT k.security_id, (SELECT min(e.session_no) FROM e WHERE e.security_id = k.security_id AND e.session_no > k.session_no + 10) FROM k WHERE k.session_no IS NOT NULL)
SELECT security_id, session_no FROM k WHERE session_no IS NOT NULL""")
def w38_st18_cooldown(spark, at):
    """Jumps, each at least eleven sessions after the last one kept."""
    b = bars(spark, at, "close").withColumn("p", F.lag("close").over(series.by_security()))
    return states.with_cooldown(b.where(F.col("close") > F.col("p") * 1.03), ["security_id"], "session_no", 10)


@query(f"""WITH {BARS_SQL}, p AS (SELECT *, high >= max(high) OVER w AND count(high) OVER w = 5 AS peak FROM bars WHERE high > 0 AND low > 0 WINDOW w AS (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
n AS (SELECT *, row_number() {LAG} AS i FROM p), j AS (SELECT r.security_id, l.session_no AS lft, r.session_no AS rgt, 1 - (SELECT min(t.low) FROM n t WHERE t.security_id = r.security_id AND t.i > l.i AND t.i < r.i) / least(l.high, r.high) AS depth, 100 * (1 - abs(l.high / r.high - 1) / 0.03) AS score
  FROM n r JOIN n l ON l.security_id = r.security_id AND l.i BETWEEN r.i - 40 AND r.i - 1 AND r.session_no - l.session_no >= 10 AND abs(l.high / r.high - 1) <= 0.03 WHERE r.peak AND l.peak),
k AS (SELECT *, row_number() OVER (PARTITION BY security_id, rgt ORDER BY score DESC, lft DESC) AS k FROM j WHERE depth BETWEEN 0.05 AND 0.5)
SELECT security_id, lft AS "left", rgt AS "right", round(depth, 6) + 0.0 AS depth, round(score, 4) + 0.0 AS score FROM k WHERE k = 1""")
def w40_o05_cups(spark, at):
    """Troughs between two highs of about the same height."""
    b = bars(spark, at, "high", "low").where("high > 0 AND low > 0")
    c = states.cups(b, "security_id", "session_no", "high", "low", (10, 40), (0.05, 0.5), 0.03)
    return c.select("security_id", "left", "right", r6(F.col("depth")).alias("depth"), (F.round("score", 4) + F.lit(0.0)).alias("score"))


@query(f"WITH {BARS_SQL}, t AS (SELECT security_id, list(close) OVER (PARTITION BY security_id ORDER BY session_no ROWS 9 PRECEDING) AS l, session_no FROM bars WHERE close IS NOT NULL) SELECT security_id, session_no, len(l) AS points, round(list_sum(l), 6) + 0.0 AS total FROM t")
def w35_trail(spark, at):
    """The last ten points as a list."""
    t = bars(spark, at, "close").where("close IS NOT NULL").withColumn("l", F.collect_list("close").over(series.frame(10)))
    return t.select("security_id", "session_no", F.size("l").alias("points"), r6(F.aggregate("l", F.lit(0.0), lambda a, x: a + x)).alias("total"))
