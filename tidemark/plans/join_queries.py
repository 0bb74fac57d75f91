"""Queries that join, look up as of a time, or compare sets (survey rows J.., U.., P.., S..), with their SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import History, last_known
from tidemark.plans.base import BARS_SQL, PANEL_SQL, bars, panel, r6, sessions
from tidemark.plans.problems import known_membership, session_of_days
from tidemark.scale import broadcast_if_bounded, finite
from tidemark.sources.tables import load

QUERIES, ORACLES = {}, {}
FIRST, LAST = "0001-01-01", "9999-12-31"


def date(text: str):
    return F.lit(text).cast("date")



def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def history(spark: SparkSession, at: str):
    """Symbol intervals once each, open sides as the calendar's ends."""
    df = load(spark, at, "symbol_history", "security_id", "ticker", "exchange", "effective_from", "effective_to", "source_asof")
    return df.select("security_id", F.upper(F.trim("ticker")).alias("ticker"), "exchange", F.coalesce("effective_from", date(FIRST)).alias("f"), F.coalesce("effective_to", date(LAST)).alias("t"), "source_asof").distinct()


H = """h AS (SELECT DISTINCT security_id, upper(trim(ticker)) AS ticker, exchange, coalesce(effective_from, DATE '0001-01-01') AS f, coalesce(effective_to, DATE '9999-12-31') AS t, source_asof FROM symbol_history)"""


@query(f"""WITH {H}, e AS (SELECT doc_id, upper(trim(ticker)) AS ticker, event_date AS d FROM documents WHERE ticker IS NOT NULL AND event_date IS NOT NULL)
SELECT e.doc_id, count(DISTINCT h.security_id) AS securities, min(h.security_id) AS security_id, CASE count(DISTINCT h.security_id) WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS state
FROM e LEFT JOIN h ON h.ticker = e.ticker AND e.d BETWEEN h.f AND h.t GROUP BY 1""")
def j01_j09_interval_join(spark, at):
    """The security behind a ticker on a day: an equi join with a range, and how certain it is."""
    e = load(spark, at, "documents", "doc_id", "ticker", "event_date").dropna().select("doc_id", F.upper(F.trim("ticker")).alias("ticker"), F.col("event_date").alias("d"))
    h = history(spark, at)
    hit = e.join(h, (e["ticker"] == h["ticker"]) & F.col("d").between(F.col("f"), F.col("t")), "left").groupBy("doc_id").agg(F.countDistinct("security_id").alias("securities"), F.min("security_id").alias("security_id"))
    return hit.select("doc_id", "securities", "security_id", F.when(F.col("securities") == 0, "UNKNOWN").when(F.col("securities") == 1, "RESOLVED").otherwise("AMBIGUOUS").alias("state"))


@query(f"""WITH {H}, e AS (SELECT DISTINCT date AS d, security_id, ticker FROM eligibility_audit),
a AS (SELECT e.d, e.security_id, any_value(e.ticker) AS own, arg_max(h.ticker, (h.f, h.t, h.source_asof, h.ticker)) AS past, arg_max(h.exchange, (h.f, h.t, h.source_asof, h.ticker, h.exchange)) AS exchange FROM e LEFT JOIN h ON h.security_id = e.security_id AND e.d BETWEEN h.f AND h.t GROUP BY ALL)
SELECT strftime(d, '%Y-%m-%d') AS day, security_id, coalesce(past, upper(trim(own)), 'NONE') AS ticker, coalesce(exchange, 'UNKNOWN') AS exchange FROM a""")
def j02_j03_ticker_as_of(spark, at):
    """Ticker and exchange by precedence: the active interval with the latest start, else the row's own."""
    e = load(spark, at, "eligibility_audit", "date", "security_id", "ticker").distinct()
    h = history(spark, at).select(F.col("security_id").alias("hs"), F.struct("f", "t", "source_asof", "ticker", "exchange").alias("h"), "f", "t")
    best = e.join(h, (F.col("security_id") == F.col("hs")) & F.col("date").between(F.col("f"), F.col("t")), "left").groupBy("date", "security_id").agg(F.max("h").alias("h"), F.max("ticker").alias("own"))
    return best.select(F.date_format("date", "yyyy-MM-dd").alias("day"), "security_id", F.coalesce("h.ticker", F.upper(F.trim("own")), F.lit("NONE")).alias("ticker"), F.coalesce("h.exchange", F.lit("UNKNOWN")).alias("exchange"))


MEMBERS = """
m AS (SELECT *, coalesce(upper(trim(snapshot_type)), '') AS kind FROM pit_membership WHERE knowledge_date IS NOT NULL AND date IS NOT NULL),
c AS (SELECT * FROM m WHERE kind IN ('MONTH_END', 'FORCED_EXIT_CARRY_FORWARD', '')),
k AS (SELECT date, min(knowledge_date) AS known FROM c GROUP BY 1),
s AS (SELECT session_date AS d, session_no, max(date) AS snap FROM trading_sessions JOIN k ON known <= session_date GROUP BY ALL),
w AS (SELECT d, session_no, snap, c.security_id, max_by(coalesce(c.active, false), (c.knowledge_date, coalesce(c.active, false))) AS active FROM s JOIN c ON c.date = s.snap AND c.knowledge_date <= s.d WHERE c.security_id IS NOT NULL GROUP BY ALL),
a AS (SELECT d, session_no, snap, security_id FROM w WHERE active AND NOT EXISTS (SELECT 1 FROM m x WHERE x.kind = 'FORCED_EXIT' AND x.security_id = w.security_id AND x.date > w.snap AND x.date <= w.d AND x.knowledge_date <= w.d))"""


def members(spark: SparkSession, at: str):
    """(d, session_no, snap, security_id): members on every session as they were known on it.

    A security is asked for on the sessions from the first day on which any row of it is known; its sessions
    are a sequence, so no rows of the two tables are paired.
    """
    m = load(spark, at, "pit_membership")
    days = sessions(spark, at).select(F.col("session_date").alias("date"), F.col("session_no").cast("int").alias("session_no"))
    # a row per session
    ends = days.agg(F.min("session_no").alias("_low"), F.max("session_no").alias("_high"), F.min("date").alias("_first"))
    known = m.dropna(subset=["security_id", "knowledge_date"]).groupBy("security_id").agg(F.min("knowledge_date").alias("_known"))
    every = known.join(F.broadcast(ends)).select("security_id", "_known", F.explode(F.sequence("_low", "_high")).alias("session_no"))
    asked = every.join(broadcast_if_bounded(days, load(spark, at, "trading_sessions")), "session_no").where("date >= _known").select("security_id", "date")
    now = known_membership(m, asked).where("member")
    return now.join(broadcast_if_bounded(days, load(spark, at, "trading_sessions")), "date").select(F.col("date").alias("d"), "session_no", F.col("snapshot").alias("snap"), "security_id")


@query(f"WITH {MEMBERS} SELECT strftime(d, '%Y-%m-%d') AS day, security_id FROM a")
def j04_j05_j06_membership(spark, at):
    """Members on every session: the latest complete snapshot known by then, less the removals since that were known."""
    return members(spark, at).select(F.date_format("d", "yyyy-MM-dd").alias("day"), "security_id")


@query(f"WITH {BARS_SQL}, {MEMBERS} SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS expected, count(b.security_id) AS observed, round(count(b.security_id) / count(*), 6) + 0.0 AS coverage FROM a LEFT JOIN bars b ON b.security_id = a.security_id AND b.session_no = a.session_no GROUP BY 1")
def j07_proj08_coverage(spark, at):
    """Members with a bar on the session, of all members."""
    b = bars(spark, at, "close").select("security_id", "session_no", F.lit(1).alias("_b"))
    n, k = F.count(F.lit(1)), F.count("_b")
    return members(spark, at).join(b, ["security_id", "session_no"], "left").groupBy(F.date_format("d", "yyyy-MM-dd").alias("day")).agg(n.alias("expected"), k.alias("observed"), r6(k / n).alias("coverage"))


@query(f"""WITH {H}, r AS (SELECT session_date AS d, h.*, rank() OVER (PARTITION BY session_date, security_id ORDER BY source_asof DESC) AS k FROM trading_sessions JOIN h ON session_date BETWEEN f AND t AND source_asof < session_date)
SELECT strftime(d, '%Y-%m-%d') AS day, security_id, min(ticker) AS ticker, count(DISTINCT ticker) AS tickers, CASE WHEN count(DISTINCT ticker) > 1 THEN 'CONFLICT' ELSE 'KNOWN' END AS state FROM r WHERE k = 1 GROUP BY ALL""")
def j08_j15_bitemporal(spark, at):
    """The value valid on each session among those known strictly before it, latest knowledge first; several values of the same knowledge are a conflict.

    Days become session numbers by two lookups in the calendar, and an interval its sequence of sessions.
    """
    every = sessions(spark, at)
    days = broadcast_if_bounded(session_of_days(every).select("day", F.col("session_no").cast("int").alias("_no")), load(spark, at, "trading_sessions"))
    # one row
    ends = F.broadcast(every.agg(F.min("session_date").alias("_first"), F.max("session_date").alias("_last"), F.min("session_no").cast("int").alias("_low")))
    h = history(spark, at).where("security_id IS NOT NULL AND source_asof IS NOT NULL").join(ends)
    # the last session before the interval or at the day of knowledge, and the last one in it
    h = h.withColumn("_before", F.greatest(F.date_sub("f", 1), "source_asof")).withColumn("_to", F.least("t", "_last")).where("_to >= _first AND _before < _to")
    from_, to = days.select(F.col("day").alias("_before"), F.col("_no").alias("_a")), days.select(F.col("day").alias("_to"), F.col("_no").alias("_b"))
    h = h.join(F.broadcast(from_), "_before", "left").join(F.broadcast(to), "_to").withColumn("_a", F.coalesce("_a", F.col("_low") - 1)).where("_a < _b")
    hit = h.select("security_id", "ticker", "source_asof", F.explode(F.sequence(F.col("_a") + 1, F.col("_b"))).alias("session_no"))
    told = hit.groupBy("security_id", "session_no", "source_asof").agg(F.min("ticker").alias("ticker"), F.countDistinct("ticker").alias("tickers"))
    best = told.groupBy("security_id", "session_no").agg(F.max(F.struct("source_asof", "ticker", "tickers")).alias("b"))
    calendar = broadcast_if_bounded(every.select(F.col("session_no").cast("int").alias("session_no"), "session_date"), load(spark, at, "trading_sessions"))
    state = F.when(F.col("b.tickers") > 1, "CONFLICT").otherwise("KNOWN")
    return best.join(calendar, "session_no").select(F.date_format("session_date", "yyyy-MM-dd").alias("day"), "security_id", F.col("b.ticker").alias("ticker"), F.col("b.tickers").alias("tickers"), state.alias("state"))


@query(f"""WITH {H}, i AS (SELECT DISTINCT security_id, ticker, f, t FROM h WHERE f <= t AND security_id IS NOT NULL AND ticker IS NOT NULL),
o AS (SELECT *, max(t) OVER (PARTITION BY security_id, ticker ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own, lag(ticker) OVER w AS last_name FROM i WINDOW w AS (PARTITION BY security_id ORDER BY f, t, ticker)),
b AS (SELECT a.security_id, count(*) AS branches FROM i a WHERE EXISTS (SELECT 1 FROM i c WHERE c.security_id = a.security_id AND c.ticker <> a.ticker AND (c.f, c.ticker) < (a.f, a.ticker) AND c.t >= a.f) GROUP BY 1),
s AS (SELECT *, sum(CASE WHEN last_name = ticker THEN 0 ELSE 1 END) OVER (PARTITION BY security_id ORDER BY f, t, ticker) AS k FROM o),
g AS (SELECT security_id, k, ticker, min(f) AS f, max(t) AS t FROM s GROUP BY ALL)
SELECT g.security_id, count(*) AS names, string_agg(ticker || ' ' || strftime(f, '%Y-%m-%d') || '/' || strftime(t, '%Y-%m-%d'), '>' ORDER BY k) AS chain, count(*) > count(DISTINCT ticker) AS returns, coalesce(max(branches), 0) AS branches FROM g LEFT JOIN b ON b.security_id = g.security_id GROUP BY 1""")
def j10_j11_lineage(spark, at):
    """The chain of a security's tickers with their intervals; names that return later, and intervals that begin inside one of another name.

    The walk from rename to rename is an order: successive intervals of one name are one link. A chain may
    be of any length.
    """
    i = history(spark, at).where("f <= t AND security_id IS NOT NULL AND ticker IS NOT NULL").select("security_id", "ticker", "f", "t").distinct()
    w = Window.partitionBy("security_id").orderBy("f", "t", "ticker")
    s = i.withColumn("k", F.sum(F.when(F.lag("ticker").over(w) == F.col("ticker"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = s.groupBy("security_id", "k", "ticker").agg(F.min("f").alias("f"), F.max("t").alias("t"))
    link = F.concat("ticker", F.lit(" "), F.date_format("f", "yyyy-MM-dd"), F.lit("/"), F.date_format("t", "yyyy-MM-dd"))
    chains = g.groupBy("security_id").agg(
        F.count(F.lit(1)).alias("names"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", link.alias("link")))), lambda x: x["link"]), ">").alias("chain"), (F.count(F.lit(1)) > F.countDistinct("ticker")).alias("returns")
    )
    branches = begin_inside(i, "security_id", "ticker").groupBy("security_id").agg(F.count(F.lit(1)).alias("branches"))
    return chains.join(branches, "security_id", "left").select("security_id", "names", "chain", "returns", F.coalesce("branches", F.lit(0)).alias("branches"))


def begin_inside(intervals, group: str, member: str):
    """Rows (group, member, f, t) of distinct intervals that begin inside an earlier one of another member of the group.

    Earlier is a smaller (f, member). Starts and ends are one ordered list of events: at a start, more
    intervals of the group are open than of the member itself. Linear, whatever the size of a group.
    """
    at = lambda c, kind, step: F.struct(F.unix_date(c).cast("long").alias("p"), F.lit(kind).alias("kind"), F.lit(step).alias("step"))
    ends = F.struct((F.unix_date("t").cast("long") + 1).alias("p"), F.lit(0).alias("kind"), F.lit(-1).alias("step"))
    events = intervals.select(group, member, "f", "t", F.explode(F.array(at("f", 1, 1), ends)).alias("e")).select(group, member, "f", "t", "e.*")
    order = ["p", "kind", member, "t", "f"]
    before = (Window.unboundedPreceding, -1)
    both = events.withColumn("_all", F.sum("step").over(Window.partitionBy(group).orderBy(*order).rowsBetween(*before)))
    both = both.withColumn("_own", F.sum("step").over(Window.partitionBy(group, member).orderBy(*order).rowsBetween(*before)))
    return both.where("kind = 1 AND coalesce(_all, 0) > coalesce(_own, 0)").select(group, member, "f", "t")


@query(f"""WITH {H}, g AS (SELECT DISTINCT ticker, security_id, f, t FROM h WHERE ticker IS NOT NULL AND security_id IS NOT NULL), w AS (SELECT *, f > t AS inverted FROM g)
SELECT DISTINCT ticker, security_id, strftime(f, '%Y-%m-%d') AS from_day, CASE WHEN inverted THEN 'INVERTED' ELSE 'OVERLAP' END AS problem FROM w
WHERE inverted OR EXISTS (SELECT 1 FROM g o WHERE o.ticker = w.ticker AND o.security_id <> w.security_id AND o.f <= o.t AND o.f <= w.f AND o.t >= w.f AND (o.f < w.f OR o.security_id < w.security_id))""")
def j12_interval_conflicts(spark, at):
    """Intervals of a ticker that begin inside one of another security, or end before they start."""
    g = history(spark, at).select("ticker", "security_id", "f", "t").where("ticker IS NOT NULL AND security_id IS NOT NULL").distinct()
    overlap = begin_inside(g.where("f <= t"), "ticker", "security_id").withColumn("problem", F.lit("OVERLAP"))
    wrong = g.where("f > t").withColumn("problem", F.lit("INVERTED")).select("ticker", "security_id", "f", "t", "problem")
    return overlap.unionByName(wrong).select("ticker", "security_id", F.date_format("f", "yyyy-MM-dd").alias("from_day"), "problem").distinct()


DELIVERIES = """
d AS (SELECT security_id, date, arg_min(close, (coalesce(source_asof, DATE '0001-01-01'), ingestion_run_id, close)) AS a, arg_max(close, (coalesce(source_asof, DATE '0001-01-01'), ingestion_run_id, close)) AS b, count(DISTINCT ingestion_run_id) AS n
  FROM coverage_bars WHERE isfinite(close) AND close > 0 GROUP BY ALL)"""


def deliveries(spark: SparkSession, at: str):
    """First and last delivered close of each bar."""
    df = load(spark, at, "coverage_bars", "security_id", "date", "close", "source_asof", "ingestion_run_id").where(finite(F.col("close")) & (F.col("close") > 0))
    order = F.struct("source_asof", "ingestion_run_id", "close")
    return df.groupBy("security_id", "date").agg(F.min(order).alias("x"), F.max(order).alias("y"), F.countDistinct("ingestion_run_id").alias("n")).select("security_id", "date", F.col("x.close").alias("a"), F.col("y.close").alias("b"), "n")


@query(f"WITH {DELIVERIES} SELECT security_id, count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1 AND a = b) AS unchanged, count(*) FILTER (n > 1 AND a <> b) AS revised, round(max(abs(b / a - 1)), 6) + 0.0 AS largest FROM d GROUP BY 1")
def j16_j17_revisions(spark, at):
    """Bars delivered again: unchanged or revised, per security."""
    d, again = deliveries(spark, at), F.col("n") > 1
    return d.groupBy("security_id").agg(F.count_if(~again).alias("single"), F.count_if(again & (F.col("a") == F.col("b"))).alias("unchanged"), F.count_if(again & (F.col("a") != F.col("b"))).alias("revised"), r6(F.max(F.abs(F.col("b") / F.col("a") - 1))).alias("largest"))


@query(f"WITH {DELIVERIES}, s AS (SELECT security_id, median(b / a) AS scale FROM d WHERE n > 1 GROUP BY 1) SELECT security_id, strftime(date, '%Y-%m-%d') AS day, round(a * coalesce(scale, 1), 6) + 0.0 AS rebased FROM d LEFT JOIN s USING (security_id)")
def j18_rebase(spark, at):
    """First closes on the scale of the last ones: the median ratio over the overlap of each security, joined back."""
    d = deliveries(spark, at)
    s = d.where("n > 1").groupBy("security_id").agg(F.median(F.col("b") / F.col("a")).alias("scale"))
    return d.join(s, "security_id", "left").select("security_id", F.date_format("date", "yyyy-MM-dd").alias("day"), r6(F.col("a") * F.coalesce("scale", F.lit(1.0))).alias("rebased"))


@query(f"""WITH {BARS_SQL}, e AS (SELECT DISTINCT security_id, date AS d FROM pit_membership WHERE upper(trim(snapshot_type)) = 'FORCED_EXIT')
SELECT e.security_id, strftime(d, '%Y-%m-%d') AS day, round(arg_max(close, date), 6) + 0.0 AS last_close, strftime(max(date), '%Y-%m-%d') AS last_day FROM e LEFT JOIN bars b ON b.security_id = e.security_id AND b.date <= d AND b.date > d - 30 AND close > 0 GROUP BY ALL""")
def j19_settlement(spark, at):
    """The last positive close in the 30 days up to a removal: a range join reduced to its last row."""
    e = load(spark, at, "pit_membership", "security_id", "date", "snapshot_type").where(F.upper(F.trim("snapshot_type")) == "FORCED_EXIT").select(F.col("security_id").alias("es"), F.col("date").alias("d")).distinct()
    b = bars(spark, at, "close").where("close > 0")
    hit = e.join(b, (F.col("es") == F.col("security_id")) & (F.col("date") <= F.col("d")) & (F.col("date") > F.date_sub("d", 30)), "left")
    out = hit.groupBy(F.col("es").alias("security_id"), "d").agg(F.max(F.struct("date", "close")).alias("m"))
    return out.select("security_id", F.date_format("d", "yyyy-MM-dd").alias("day"), r6(F.col("m.close")).alias("last_close"), F.date_format("m.date", "yyyy-MM-dd").alias("last_day"))


@query("""
WITH e AS (SELECT DISTINCT security_id, date AS d FROM pit_membership WHERE upper(trim(snapshot_type)) = 'FORCED_EXIT'), a AS (SELECT DISTINCT security_id, date AS q FROM bar_quarantine),
r AS (SELECT a.security_id, q, d, rank() OVER (PARTITION BY a.security_id, q ORDER BY abs(q - d)) AS k FROM a JOIN e ON e.security_id = a.security_id AND d BETWEEN q - 60 AND q + 10)
SELECT security_id, strftime(q, '%Y-%m-%d') AS day, strftime(min(d), '%Y-%m-%d') AS nearest, count(*) > 1 AS tied FROM r WHERE k = 1 GROUP BY security_id, q""")
def j20_nearest_event(spark, at):
    """The removal nearest to a quarantined row, from 60 days before to 10 after; ties are marked."""
    e = load(spark, at, "pit_membership", "security_id", "date", "snapshot_type").where(F.upper(F.trim("snapshot_type")) == "FORCED_EXIT").select(F.col("security_id").alias("es"), F.col("date").alias("d")).distinct()
    a = load(spark, at, "bar_quarantine").select("security_id", F.col("date").alias("q")).distinct()
    hit = a.join(e, (F.col("security_id") == F.col("es")) & F.col("d").between(F.date_sub("q", 60), F.date_add("q", 10)))
    k = F.rank().over(Window.partitionBy("security_id", "q").orderBy(F.abs(F.datediff("q", "d"))))
    return hit.withColumn("k", k).where("k = 1").groupBy("security_id", "q").agg(F.min("d").alias("m"), (F.count(F.lit(1)) > 1).alias("tied")).select("security_id", F.date_format("q", "yyyy-MM-dd").alias("day"), F.date_format("m", "yyyy-MM-dd").alias("nearest"), "tied")


@query(f"WITH {BARS_SQL} SELECT a.security_id, a.session_no, round(b.close, 6) + 0.0 AS baseline, round(a.open / b.close - 1, 6) + 0.0 AS gap FROM bars a JOIN bars b ON b.security_id = a.security_id AND b.session_no = a.session_no - 1 WHERE b.close > 0 AND a.open IS NOT NULL")
def j22_baselines(spark, at):
    """The previous session's close of each bar and the gap to its open."""
    b = bars(spark, at, "open", "close")
    before = b.where("close > 0").select("security_id", (F.col("session_no") + 1).alias("session_no"), F.col("close").alias("_c"))
    return b.where(F.col("open").isNotNull()).join(before, ["security_id", "session_no"]).select("security_id", "session_no", r6(F.col("_c")).alias("baseline"), r6(F.col("open") / F.col("_c") - 1).alias("gap"))


@query("""
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (hour(ts) < 12) AS n, round(sum(value) FILTER (hour(ts) < 12), 4) AS v FROM events GROUP BY ALL)
SELECT a.user_id, strftime(a.day, '%Y-%m-%d') AS day, a.n AS events, count(b.day) AS past_days, round(avg(b.n), 6) + 0.0 AS usual FROM d a LEFT JOIN d b ON b.user_id = a.user_id AND b.day BETWEEN a.day - 5 AND a.day - 1 GROUP BY a.user_id, a.day, a.n""")
def j23_same_clock(spark, at):
    """Events of a day up to noon against those up to noon of the five days before."""
    e = load(spark, at, "events", "user_id", "ts")
    d = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.hour("ts") < 12).alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.unix_date("day")).rangeBetween(-5, -1)
    return d.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("n").alias("events"), F.count("n").over(w).alias("past_days"), r6(F.avg("n").over(w)).alias("usual"))


@query("""
WITH e AS (SELECT event_id, user_id, ts, event_type, value FROM events), o AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
  min(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM e)
SELECT event_id, date_diff('second', b, ts) AS since, date_diff('second', ts, a) AS until FROM o""")
def j24_both_directions(spark, at):
    """Seconds since the last and until the next purchase of the same user, from one ordered pass."""
    e = load(spark, at, "events", "event_id", "user_id", "ts", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    bought = F.when(F.col("event_type") == "purchase", F.col("ts"))
    before = F.last(bought, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(bought, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    seconds = lambda x: F.unix_seconds(F.date_trunc("second", x))
    return e.select("event_id", (seconds(F.col("ts")) - seconds(before)).alias("since"), (seconds(after) - seconds(F.col("ts"))).alias("until"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY observed_at DESC, doc_id DESC) AS k, count(*) OVER (PARTITION BY document_id) AS revisions FROM documents WHERE observed_at <= TIMESTAMP '2026-01-01')
SELECT doc_id, document_id, revisions FROM r WHERE k = 1""")
def s27_e04_e10_latest_revision(spark, at):
    """The revision of each document that was the latest to be seen by a time."""
    d = load(spark, at, "documents", "doc_id", "document_id", "observed_at").where(F.col("observed_at") <= F.lit("2026-01-01").cast("timestamp"))
    w = Window.partitionBy("document_id")
    k = F.row_number().over(w.orderBy(F.col("observed_at").desc_nulls_last(), F.col("doc_id").desc()))
    return d.select("doc_id", "document_id", F.count(F.lit(1)).over(w).alias("revisions"), k.alias("k")).where("k = 1").drop("k")


@query("""
WITH a AS (SELECT 'bars' AS side, security_id FROM coverage_bars UNION SELECT 'quarantine', security_id FROM bar_quarantine UNION SELECT 'history', security_id FROM symbol_history UNION SELECT 'audit', security_id FROM eligibility_audit)
SELECT security_id, array_to_string(list_sort(list(side)), ';') AS sides FROM a GROUP BY 1""")
def u15_s11_coverage_sets(spark, at):
    """In which tables each security occurs: set differences of all of them at once."""
    tables = {"bars": "coverage_bars", "quarantine": "bar_quarantine", "history": "symbol_history", "audit": "eligibility_audit"}
    parts = [load(spark, at, t, "security_id").select(F.lit(s).alias("side"), "security_id").distinct() for s, t in tables.items()]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.groupBy("security_id").agg(F.array_join(F.array_sort(F.collect_set("side")), ";").alias("sides"))


@query("""
WITH p AS (SELECT security_id, date, close, ingestion_run_id, 1 AS pr FROM coverage_bars WHERE source = 'PRIMARY_FEED' UNION ALL SELECT security_id, date, close, ingestion_run_id, 2 FROM coverage_bars WHERE source = 'SECONDARY_FEED'),
k AS (SELECT security_id, date, arg_max(pr, (pr, ingestion_run_id)) AS source_no, count(*) AS rows FROM p GROUP BY ALL)
SELECT source_no, count(*) AS bars, CAST(sum(rows) AS BIGINT) AS rows FROM k GROUP BY 1""")
def u01_s25_merge_keep_last(spark, at):
    """A parent table and a fetched one merged, the later source kept per key."""
    src = F.when(F.col("source") == "PRIMARY_FEED", 1).when(F.col("source") == "SECONDARY_FEED", 2)
    p = load(spark, at, "coverage_bars", "security_id", "date", "source", "ingestion_run_id").withColumn("pr", src).where(F.col("pr").isNotNull())
    k = p.groupBy("security_id", "date").agg(F.max(F.struct("pr", "ingestion_run_id")).alias("m"), F.count(F.lit(1)).alias("rows"))
    return k.groupBy(F.col("m.pr").alias("source_no")).agg(F.count(F.lit(1)).alias("bars"), F.sum("rows").alias("rows"))


@query("""
WITH h AS (SELECT DISTINCT security_id, date, close FROM coverage_bars WHERE date_trunc('month', date) = DATE '2025-03-01' AND security_id IN (SELECT security_id FROM bar_quarantine)),
o AS (SELECT security_id, date FROM coverage_bars WHERE security_id NOT IN (SELECT security_id FROM h) OR date_trunc('month', date) <> DATE '2025-03-01')
SELECT strftime(date, '%Y-%m') AS month, count(*) AS rows FROM (SELECT security_id, date FROM o UNION ALL SELECT security_id, date FROM h) GROUP BY 1""")
def u02_month_replacement(spark, at):
    """One month of repaired securities replaced: the rest by an anti join, then the replacement."""
    b = load(spark, at, "coverage_bars", "security_id", "date", "close")
    repaired = load(spark, at, "bar_quarantine", "security_id").distinct()
    march = F.trunc("date", "month") == F.lit("2025-03-01").cast("date")
    new = b.where(march).join(repaired, "security_id", "left_semi").distinct()
    touched = new.select("security_id").distinct().withColumn("_m", F.lit("2025-03-01").cast("date"))
    old = b.withColumn("_m", F.trunc("date", "month")).join(touched, ["security_id", "_m"], "left_anti").drop("_m")
    return old.unionByName(new).groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {MEMBERS} SELECT CAST(session_no AS BIGINT) AS session_no, count(*) AS members, CAST(coalesce(sum(CASE WHEN b THEN 0 ELSE 1 END), 0) AS BIGINT) AS joined FROM (SELECT session_no, security_id, lag(session_no) OVER (PARTITION BY security_id ORDER BY session_no) = session_no - 1 AS b0, coalesce(lag(session_no) OVER (PARTITION BY security_id ORDER BY session_no) = session_no - 1, false) AS b FROM a) GROUP BY 1")
def u12_membership_flow(spark, at):
    """Members and newcomers of every session, from the replayed timeline."""
    a = members(spark, at).withColumn("_b", F.lag("session_no").over(Window.partitionBy("security_id").orderBy("session_no")))
    came = ~F.coalesce(F.col("_b") == F.col("session_no") - 1, F.lit(False))
    return a.groupBy(F.col("session_no").cast("bigint").alias("session_no")).agg(F.count(F.lit(1)).alias("members"), F.count_if(came).alias("joined"))


@query("""
WITH m AS (SELECT security_id, max(delisting_date) AS d FROM security_master_snapshots WHERE delisting_date IS NOT NULL GROUP BY 1)
SELECT security_id, strftime(d, '%Y-%m-%d') AS delisted, strftime(min(session_date), '%Y-%m-%d') AS exit_day FROM m JOIN trading_sessions ON session_date > d WHERE d >= DATE '2024-07-01' GROUP BY ALL""")
def u13_f10_forced_exits(spark, at):
    """The first session after each delisting, from a calendar of next sessions."""
    m = load(spark, at, "security_master_snapshots", "security_id", "delisting_date").dropna().groupBy("security_id").agg(F.max("delisting_date").alias("d")).where(F.col("d") >= F.lit("2024-07-01").cast("date"))
    cal = sessions(spark, at)
    before = cal.withColumn("_b", F.lag("session_date").over(Window.partitionBy().orderBy("session_date")))
    spans = before.select("session_date", F.explode(F.sequence(F.coalesce("_b", F.date_sub("session_date", 31)), F.date_sub("session_date", 1))).alias("d"))
    return m.join(broadcast_if_bounded(spans, cal), "d").select("security_id", F.date_format("d", "yyyy-MM-dd").alias("delisted"), F.date_format("session_date", "yyyy-MM-dd").alias("exit_day"))


@query("""
SELECT count(*) AS rows, count(*) FILTER (security_id IS NULL OR date IS NULL) AS null_keys, count(*) - count(DISTINCT (security_id, date, ingestion_run_id)) AS repeated,
  count(*) FILTER (close IS NULL OR open IS NULL OR high IS NULL OR low IS NULL OR volume IS NULL) AS nulls,
  count(*) FILTER (NOT (isfinite(coalesce(close, 1)) AND isfinite(coalesce(open, 1)))) AS not_finite, count(*) FILTER (close <= 0 OR open <= 0 OR volume < 0) AS not_positive,
  count(*) FILTER (high < greatest(open, close, low) - 1e-8 OR low > least(open, close, high) + 1e-8) AS bounds, count(*) FILTER (source_asof < date) AS early,
  count(*) FILTER (date NOT IN (SELECT session_date FROM trading_sessions)) AS off_calendar FROM coverage_bars""")
def proj05_proj06_gates(spark, at):
    """All row checks of a bar table in one aggregate."""
    b = load(spark, at, "coverage_bars", "security_id", "date", "ingestion_run_id", "open", "high", "low", "close", "volume", "source_asof")
    cal = broadcast_if_bounded(sessions(spark, at).select(F.col("session_date").alias("date"), F.lit(True).alias("_on")))
    b = b.join(cal, "date", "left")
    some = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    return b.agg(
        F.count(F.lit(1)).alias("rows"),
        some(F.col("security_id").isNull() | F.col("date").isNull()).alias("null_keys"),
        (F.count(F.lit(1)) - F.countDistinct(F.struct("security_id", "date", "ingestion_run_id"))).alias("repeated"),
        some(c.isNull() | o.isNull() | h.isNull() | l.isNull() | v.isNull()).alias("nulls"),
        some(F.coalesce(bad(c), F.lit(False)) | F.coalesce(bad(o), F.lit(False))).alias("not_finite"),
        some((c <= 0) | (o <= 0) | (v < 0)).alias("not_positive"),
        some((h < F.greatest(o, c, l) - 1e-8) | (l > F.least(o, c, h) + 1e-8)).alias("bounds"),
        some(F.col("source_asof") < F.col("date")).alias("early"),
        some(F.col("_on").isNull()).alias("off_calendar"),
    )


@query("""
WITH r AS (SELECT security_id, date, ingestion_run_id, array_to_string(list_filter([
  CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL THEN 'NULL_REQUIRED_VALUE' END,
  CASE WHEN NOT (isfinite(coalesce(open, 1)) AND isfinite(coalesce(high, 1)) AND isfinite(coalesce(low, 1)) AND isfinite(coalesce(close, 1))) THEN 'NONFINITE_VALUE' END,
  CASE WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 THEN 'NONPOSITIVE_PRICE' END, CASE WHEN volume < 0 THEN 'NEGATIVE_VOLUME' END], lambda x: x IS NOT NULL), ';') AS reasons FROM coverage_bars)
SELECT DISTINCT security_id, strftime(date, '%Y-%m-%d') AS day, ingestion_run_id, reasons FROM r WHERE reasons <> ''""")
def proj03_proj23_quarantine(spark, at):
    """Rows that break a rule, with all their reasons in order."""
    b = load(spark, at, "coverage_bars", "security_id", "date", "ingestion_run_id", "open", "high", "low", "close", "volume")
    prices = [F.col(x) for x in ("open", "high", "low", "close")]
    any_of = lambda cs: F.coalesce(F.greatest(F.lit(0), *[F.coalesce(c, F.lit(False)).cast("int") for c in cs]) == 1, F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(any_of([c.isNull() for c in [*prices, F.col("volume")]]), "NULL_REQUIRED_VALUE"),
        F.when(any_of([F.isnan(c) | (F.abs(c) == float("inf")) for c in prices]), "NONFINITE_VALUE"),
        F.when(any_of([c <= 0 for c in prices]), "NONPOSITIVE_PRICE"),
        F.when(any_of([F.col("volume") < 0]), "NEGATIVE_VOLUME"),
    ))
    df = b.select("security_id", F.date_format("date", "yyyy-MM-dd").alias("day"), "ingestion_run_id", F.array_join(reasons, ";").alias("reasons"))
    return df.where("reasons <> ''").distinct()


@query("SELECT ingestion_run_id, count(*) AS rows, count(*) FILTER (date NOT IN (SELECT session_date FROM trading_sessions)) AS off FROM bar_quarantine GROUP BY 1")
def proj04_proj07_calendar(spark, at):
    """Rows of each run that fall on no session."""
    q = load(spark, at, "bar_quarantine", "ingestion_run_id", "date")
    cal = broadcast_if_bounded(sessions(spark, at).select(F.col("session_date").alias("date"), F.lit(True).alias("_on")))
    return q.join(cal, "date", "left").groupBy("ingestion_run_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_on").isNull()).alias("off"))


@query(f"WITH {PANEL_SQL} SELECT security_id, session_no, coalesce(close >= 1 AND volume > 0 AND count(close * volume) OVER w >= 12 AND avg(close * volume) OVER w >= 1000000, false) AS tradable FROM panel WINDOW w AS (PARTITION BY security_id ORDER BY session_no ROWS 19 PRECEDING)")
def proj13_tradable(spark, at):
    """Whether a security is traded enough: price floor, volume, mean dollar volume of 20 sessions with 60 % of the values."""
    w = Window.partitionBy("security_id").orderBy("session_no").rowsBetween(-19, 0)
    usd = F.col("close") * F.col("volume")
    ok = (F.col("close") >= 1) & (F.col("volume") > 0) & (F.count(usd).over(w) >= 12) & (F.avg(usd).over(w) >= 1_000_000)
    return panel(spark, at, "close", "volume").select("security_id", "session_no", F.coalesce(ok, F.lit(False)).alias("tradable"))


@query(f"""WITH {H}, s AS (SELECT * FROM h WHERE f <= t)
SELECT DISTINCT security_id, ticker, strftime(greatest(f, DATE '2024-07-01'), '%Y-%m-%d') AS from_day, strftime(least(t, DATE '2026-06-30'), '%Y-%m-%d') AS to_day FROM s WHERE f <= DATE '2026-06-30' AND t >= DATE '2024-07-01'""")
def proj10_clip(spark, at):
    """Intervals clipped to a window."""
    lo, hi = F.lit("2024-07-01").cast("date"), F.lit("2026-06-30").cast("date")
    s = history(spark, at).where((F.col("f") <= F.col("t")) & (F.col("f") <= hi) & (F.col("t") >= lo))
    return s.select("security_id", "ticker", F.date_format(F.greatest("f", lo), "yyyy-MM-dd").alias("from_day"), F.date_format(F.least("t", hi), "yyyy-MM-dd").alias("to_day")).distinct()


@query("SELECT event_id, CASE WHEN hour(ts) * 60 + minute(ts) >= 570 AND hour(ts) * 60 + minute(ts) < 960 THEN 'REGULAR' WHEN hour(ts) < 9 OR hour(ts) * 60 + minute(ts) < 570 THEN 'EARLY' ELSE 'LATE' END AS phase FROM events")
def proj12_session_phase(spark, at):
    """Events by time of day, half-open from 09:30 to 16:00."""
    m = F.hour("ts") * 60 + F.minute("ts")
    return load(spark, at, "events", "event_id", "ts").select("event_id", F.when((m >= 570) & (m < 960), "REGULAR").when(m < 570, "EARLY").otherwise("LATE").alias("phase"))


@query("""
WITH m AS (SELECT DISTINCT security_id, current_ticker, name FROM security_master_snapshots WHERE name IS NOT NULL AND current_ticker IS NOT NULL),
s AS (SELECT *, CASE WHEN upper(current_ticker) = 'QBMK' THEN 100 WHEN starts_with(upper(current_ticker), 'QB') THEN 60 WHEN contains(upper(name), 'BANK') THEN 30 ELSE 0 END AS score FROM m)
SELECT security_id, current_ticker, name, score FROM s WHERE score > 0""")
def proj17_search(spark, at):
    """Matches of a search with their priority."""
    t, n = F.upper("current_ticker"), F.upper("name")
    score = F.when(t == "QBMK", 100).when(t.startswith("QB"), 60).when(n.contains("BANK"), 30).otherwise(0)
    return load(spark, at, "security_master_snapshots", "security_id", "current_ticker", "name").dropna().distinct().withColumn("score", score).where("score > 0")


@query("""
WITH a AS (SELECT DISTINCT security_id, factor_id, CAST(date AS DATE) AS d FROM factor_values), e AS (SELECT security_id, date, eligible FROM (SELECT DISTINCT security_id, date, eligible FROM eligibility_audit))
SELECT a.security_id, a.factor_id, strftime(a.d, '%Y-%m-%d') AS day, bool_or(e.eligible) AS eligible, strftime(max(e.date), '%Y-%m-%d') AS audited FROM a LEFT JOIN e ON e.security_id = a.security_id AND e.date = (SELECT max(date) FROM e f WHERE f.security_id = a.security_id AND f.date <= a.d) GROUP BY ALL""")
def j13_last_audit(spark, at):
    """The audit of a security that was the last on each factor row's day, by the general last-known operator."""
    a = load(spark, at, "factor_values", "security_id", "factor_id", "date").distinct()
    e = load(spark, at, "eligibility_audit", "security_id", "date", "eligible").distinct()
    whole = e.withColumn("_v", F.struct("date", "eligible"))
    known = last_known(a.select("security_id", "date").distinct(), "date", {"audit": History(whole, ("security_id",), "date", "_v")})
    return a.join(known, ["security_id", "date"], "left").select("security_id", "factor_id", F.date_format("date", "yyyy-MM-dd").alias("day"), F.col("audit.eligible").alias("eligible"), F.date_format("audit.date", "yyyy-MM-dd").alias("audited"))
