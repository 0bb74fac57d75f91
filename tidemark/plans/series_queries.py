"""Queries along the sessions of each security (survey rows W..), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.plans.base import bars, panel, r6, sessions, sql

QUERIES, ORACLES = {}, {}
ID = ("security_id", "session_no")
W = "OVER (PARTITION BY security_id ORDER BY session_no{})"


def over(rows: str = "") -> str:
    return W.format(" ROWS BETWEEN " + rows if rows else "")


def last(n: int) -> str:
    return over(f"{n - 1} PRECEDING AND CURRENT ROW")


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*ID, *[r6(F.col(n)).alias(n) for n in names])


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


RET = f", ret AS (SELECT *, adj_close / nullif(lag(adj_close) {over()}, 0) - 1 AS ret FROM panel)"


def returns(spark: SparkSession, at: str, *more: str) -> DataFrame:
    df = panel(spark, at, *dict.fromkeys(["adj_close", *more]))
    return df.withColumn("ret", S.change("adj_close"))


MOMENTA = {"mom_1m": (21, 0), "mom_3m": (63, 21), "mom_6m": (126, 21), "mom_12m": (252, 21)}


@query(sql(" SELECT security_id, session_no, " + ", ".join(
    r((f"lag(adj_close, {k}) {over()}" if k else "adj_close") + f" / nullif(lag(adj_close, {k + n}) {over()}, 0) - 1", m) for m, (n, k) in MOMENTA.items()) + " FROM panel"))
def w01_momentum(spark, at):
    """Change over a lookback that ended some sessions ago."""
    return rounded(panel(spark, at, "adj_close").withColumns({m: S.momentum("adj_close", n, k) for m, (n, k) in MOMENTA.items()}), *MOMENTA)


@query(sql(RET + " SELECT security_id, session_no, " + ", ".join(r(f"CASE WHEN count(ret) {last(n)} >= {int(0.8 * n)} THEN stddev_samp(ret) {last(n)} END", f"vol_{n}d") for n in (20, 60)) + " FROM ret"))
def w02_volatility(spark, at):
    """Standard deviation of returns over 20 and 60 sessions with at least 80 % of the values."""
    return rounded(returns(spark, at).withColumns({f"vol_{n}d": S.volatility("ret", n) for n in (20, 60)}), "vol_20d", "vol_60d")


@query(sql(RET + f" SELECT security_id, session_no, {r(f'CASE WHEN count(ret) {last(5)} = 5 THEN product(1 + ret) {last(5)} - 1 END', 'reversal')} FROM ret"))
def w03_reversal(spark, at):
    """Compounded return of the last five sessions."""
    return rounded(returns(spark, at).withColumn("reversal", S.compounded("ret", 5)), "reversal")


@query(sql(f" SELECT security_id, session_no, {r(f'volume / nullif(CASE WHEN count(volume) {last(20)} = 20 THEN avg(volume) {last(20)} END, 0)', 'turnover')} FROM panel"))
def w04_turnover(spark, at):
    """Volume against its mean of 20 sessions."""
    return rounded(panel(spark, at, "volume").withColumn("turnover", S.ratio(F.col("volume"), S.full(F.avg("volume"), "volume", 20))), "turnover")


@query(sql(f", t AS (SELECT *, open * adj_close / nullif(close, 0) AS tr_open, adj_close / nullif(close, 0) AS factor FROM panel) SELECT security_id, session_no, {r(f'adj_close / nullif(lag(adj_close) {over()}, 0) - 1', 'close_return')}, {r('tr_open', 'tr_open')}, {r('factor', 'factor')}, {r(f'lead(tr_open) {over()} / nullif(tr_open, 0) - 1', 'open_forward')} FROM t"))
def w05_returns(spark, at):
    """Close-to-close returns, adjusted opens and open-to-open forward returns."""
    df = panel(spark, at, "open", "close", "adj_close").withColumn("factor", S.ratio(F.col("adj_close"), F.col("close")))
    df = df.withColumn("tr_open", S.ratio(F.col("open") * F.col("adj_close"), F.col("close"))).withColumn("close_return", S.change("adj_close"))
    return rounded(df.withColumn("open_forward", S.ratio(F.lead("tr_open").over(S.by_security()), F.col("tr_open")) - 1), "close_return", "tr_open", "factor", "open_forward")


@query(sql(RET + " SELECT security_id, session_no, " + ", ".join(r(f"CASE WHEN count(ret) {over(f'1 FOLLOWING AND {n} FOLLOWING')} = {n} THEN product(1 + ret) {over(f'1 FOLLOWING AND {n} FOLLOWING')} - 1 END", f"fwd_{n}") for n in (1, 5, 20)) + " FROM ret"))
def w06_forward_returns(spark, at):
    """Product of the next 1, 5 and 20 gross returns; NULL if any is missing."""
    return rounded(returns(spark, at).withColumns({f"fwd_{n}": S.forward("ret", n) for n in (1, 5, 20)}), "fwd_1", "fwd_5", "fwd_20")


@query(sql(f" SELECT security_id, session_no, {r(f'lead(open, 2) {over()} / nullif(lead(open, 1) {over()}, 0) - 1', 'held_return')} FROM panel"))
def w07_open_to_open(spark, at):
    """Return from the next open to the one after it."""
    w = S.by_security()
    return rounded(panel(spark, at, "open").withColumn("held_return", S.ratio(F.lead("open", 2).over(w), F.lead("open", 1).over(w)) - 1), "held_return")


@query(sql("""
SELECT a.security_id, a.session_no, round(CASE WHEN a.adj_close > 0 AND b.adj_close > 0 THEN a.adj_close / b.adj_close - 1 END, 6) + 0.0 AS eod_return,
  array_to_string(list_filter([CASE WHEN b.security_id IS NULL THEN 'NO_PREVIOUS_SESSION' END, CASE WHEN a.adj_close IS NULL THEN 'PRICE_MISSING' END,
  CASE WHEN a.adj_close <= 0 OR b.adj_close <= 0 THEN 'PRICE_NOT_POSITIVE' END], lambda x: x IS NOT NULL), ';') AS reasons
FROM bars a LEFT JOIN bars b ON b.security_id = a.security_id AND b.session_no = a.session_no - 1""", dense=False))  # fmt: skip
def w08_w09_eod_audit(spark, at):
    """Return against the shared previous session, by a join on it, with the reasons for its absence."""
    now = bars(spark, at, "adj_close")
    before = now.select("security_id", (F.col("session_no") + 1).alias("session_no"), F.col("adj_close").alias("_before"), F.lit(True).alias("_there"))
    a, b = F.col("adj_close"), F.col("_before")
    reasons = F.array_compact(F.array(F.when(F.col("_there").isNull(), "NO_PREVIOUS_SESSION"), F.when(a.isNull(), "PRICE_MISSING"), F.when((a <= 0) | (b <= 0), "PRICE_NOT_POSITIVE")))
    return now.join(before, list(ID), "left").select(*ID, r6(F.when((a > 0) & (b > 0), a / b - 1)).alias("eod_return"), F.array_join(reasons, ";").alias("reasons"))


TR = f"greatest(high - low, abs(high - lag(close) {over()}), abs(low - lag(close) {over()}))"


@query(sql(f", t AS (SELECT *, {TR} AS tr FROM panel) SELECT security_id, session_no, {r('tr', 'true_range')}, {r(f'CASE WHEN count(tr) {last(14)} = 14 THEN avg(tr) {last(14)} END', 'atr_14')} FROM t"))
def w10_true_range(spark, at):
    """True range and its mean of 14 sessions."""
    df = panel(spark, at, "high", "low", "close").withColumn("true_range", S.true_range("high", "low", "close"))
    return rounded(df.withColumn("atr_14", S.full(F.avg("true_range"), "true_range", 14)), "true_range", "atr_14")


@query(sql(f"""
, a AS (SELECT *, list(high) {over('80 PRECEDING AND 1 PRECEDING')} AS hs, list(low) {over('80 PRECEDING AND 1 PRECEDING')} AS ls FROM bars WHERE high > 0 AND low > 0)
SELECT security_id, session_no, round(list_max(list_transform(range(1, len(hs) + 1), lambda i: hs[i] / list_min(ls[1:i]) - 1)), 6) + 0.0 AS runup FROM a""", dense=False))
def w11_runup(spark, at):
    """Greatest rise of a high over the lowest low up to it, within the 80 bars before the current one."""
    rows = bars(spark, at, "high", "low").where("high > 0 AND low > 0")
    ahead = S.by_security().rowsBetween(-80, -1)
    listed = rows.withColumn("_l", F.collect_list(F.struct("high", "low")).over(ahead))
    step = lambda acc, x: F.struct(F.least(acc["low"], x["low"]).alias("low"), F.greatest(acc["best"], x["high"] / F.least(acc["low"], x["low"]) - 1).alias("best"))
    start = F.struct(F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("best"))
    return rounded(listed.withColumn("runup", F.aggregate("_l", start, step, lambda acc: acc["best"])), "runup")


MA = (10, 20, 50)


@query(sql(f"""
, f AS (SELECT *, {", ".join(f"CASE WHEN count(close) {last(n)} = {n} THEN avg(close) {last(n)} END AS ma{n}" for n in MA)},
  close / nullif(lag(close, 20) {over()}, 0) - 1 AS ret20,
  CASE WHEN count(high / nullif(low, 0)) {last(20)} = 20 THEN avg(high / nullif(low, 0) - 1) {last(20)} END AS adr20,
  max(high) {over('20 PRECEDING AND 1 PRECEDING')} AS pivot_high,
  max(high) {last(3)} / nullif(min(low) {last(3)}, 0) - 1 AS tight3,
  {" + ".join(f"({(4 - j) - 2}.0) / 10 * lag(low, {j}) {over()}" if j else "2.0 / 10 * low" for j in range(4, -1, -1))} AS low_slope,
  avg(volume) {last(5)} / nullif(avg(volume) {last(20)}, 0) AS dry_up FROM panel)
SELECT security_id, session_no, {", ".join(r(c, c) for c in ("ma10", "ma20", "ma50", "ret20", "adr20", "pivot_high", "tight3", "low_slope", "dry_up"))},
  CASE WHEN close > pivot_high AND ma10 > ma20 THEN 'ABOVE_PIVOT' WHEN ma10 > ma20 AND ma20 > ma50 THEN 'ALIGNED' WHEN ma50 IS NULL THEN 'SHORT' ELSE 'OTHER' END AS shape
FROM f"""))
def w12_setup_features(spark, at):
    """Moving averages, ranges, pivot, tightness, slope of lows and volume dry-up of one window pass."""
    w = S.by_security()
    df = panel(spark, at, "high", "low", "close", "volume").withColumn("_range", S.ratio(F.col("high"), F.col("low")))
    df = df.withColumns({f"ma{n}": S.full(F.avg("close"), "close", n) for n in MA}).withColumns(
        {
            "ret20": S.change("close", 20),
            "adr20": S.full(F.avg(F.col("_range") - 1), "_range", 20),
            "pivot_high": F.max("high").over(w.rowsBetween(-20, -1)),
            "tight3": S.ratio(F.max("high").over(S.frame(3)), F.min("low").over(S.frame(3))) - 1,
            "low_slope": S.slope("low", 5),
            "dry_up": S.ratio(F.avg("volume").over(S.frame(5)), F.avg("volume").over(S.frame(20))),
        }
    )
    shape = F.when((F.col("close") > F.col("pivot_high")) & (F.col("ma10") > F.col("ma20")), "ABOVE_PIVOT").when((F.col("ma10") > F.col("ma20")) & (F.col("ma20") > F.col("ma50")), "ALIGNED").when(F.col("ma50").isNull(), "SHORT").otherwise("OTHER")
    names = ["ma10", "ma20", "ma50", "ret20", "adr20", "pivot_high", "tight3", "low_slope", "dry_up"]
    return df.select(*ID, *[r6(F.col(c)).alias(c) for c in names], shape.alias("shape"))


@query(sql(f", l AS (SELECT *, list(close) FILTER (WHERE close IS NOT NULL) {last(60)} AS c FROM bars) SELECT security_id, session_no, {r('CASE WHEN close IS NOT NULL AND len(c) = 60 THEN len(list_filter(c, lambda x: x <= close)) / 60.0 END', 'percentile_60')} FROM l", dense=False))
def w15_rolling_percentile(spark, at):
    """Share of the last 60 closes not above the current one."""
    return rounded(bars(spark, at, "close").withColumn("percentile_60", S.rolling_percentile("close", 60)), "percentile_60")


@query(sql(RET + f", l AS (SELECT *, list_sort(list(ret) FILTER (WHERE ret IS NOT NULL) {last(60)}) AS c FROM ret) SELECT security_id, session_no, {r('CASE WHEN len(c) >= 40 THEN quantile_cont_list END', 'q20')} FROM (SELECT *, c[CAST(floor((len(c) - 1) * 0.2) AS INT) + 1] + (c[CAST(ceil((len(c) - 1) * 0.2) AS INT) + 1] - c[CAST(floor((len(c) - 1) * 0.2) AS INT) + 1]) * ((len(c) - 1) * 0.2 - floor((len(c) - 1) * 0.2)) AS quantile_cont_list FROM l)"))
def w25_rolling_quantile(spark, at):
    """Interpolated fifth of the last 60 returns, from 40 values on."""
    return rounded(returns(spark, at).withColumn("q20", S.rolling_quantile("ret", 60, 0.2, 40)), "q20")


@query(sql(f" SELECT security_id, session_no, {r(f'last_value(close IGNORE NULLS) {over('5 PRECEDING AND CURRENT ROW')}', 'filled')} FROM panel"))
def w19_bounded_fill(spark, at):
    """The last close, at most five sessions old."""
    return rounded(panel(spark, at, "close").withColumn("filled", S.filled_forward("close", 5)), "filled")


@query(sql(f" SELECT security_id, session_no, " + ", ".join(r(f"CASE WHEN count(adj_close) {last(k + 1)} = {k + 1} THEN 100 * (adj_close / nullif(lag(adj_close, {k}) {over()}, 0) - 1) END", f"strict_{k}") for k in (5, 20)) + " FROM panel"))
def w21_strict_returns(spark, at):
    """Change in percent over 5 and 20 sessions, NULL with any gap in between."""
    df = panel(spark, at, "adj_close")
    return rounded(df.withColumns({f"strict_{k}": F.when(F.count("adj_close").over(S.frame(k + 1)) == k + 1, 100 * S.change("adj_close", k)) for k in (5, 20)}), "strict_5", "strict_20")


@query(sql(RET + f"""
, b AS (SELECT right(security_id, 1) AS basket, session_no, avg(ret) AS ret, count(ret) AS members FROM ret GROUP BY ALL),
s AS (SELECT *, sum(CASE WHEN ret IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY basket ORDER BY session_no) AS segment FROM b)
SELECT basket, session_no, members, round(CASE WHEN ret IS NOT NULL THEN 100 * product(1 + coalesce(ret, 0)) OVER (PARTITION BY basket, segment ORDER BY session_no) END, 4) + 0.0 AS level FROM s"""))
def w22_basket_index(spark, at):
    """Equal-weight baskets compounded daily from 100; a session without any return starts a new segment."""
    daily = returns(spark, at).groupBy(F.right("security_id", F.lit(1)).alias("basket"), "session_no").agg(F.avg("ret").alias("ret"), F.count("ret").alias("members"))
    parts = S.segments(daily, F.col("ret").isNull(), "segment", key="basket")
    upto = Window.partitionBy("basket", "segment").orderBy("session_no").rowsBetween(Window.unboundedPreceding, 0)
    level = F.when(F.col("ret").isNotNull(), 100 * F.product(1 + F.coalesce(F.col("ret"), F.lit(0.0))).over(upto))
    return parts.select("basket", "session_no", "members", (F.round(level, 4) + F.lit(0.0)).alias("level"))


@query(sql(RET + f", n AS (SELECT *, product(1 + coalesce(ret, 0)) {over('UNBOUNDED PRECEDING AND CURRENT ROW')} AS nav FROM ret) SELECT security_id, session_no, {r('nav', 'nav')}, {r(f'nav / greatest(max(nav) {over('UNBOUNDED PRECEDING AND CURRENT ROW')}, 1) - 1', 'drawdown')} FROM n"))
def w23_drawdown(spark, at):
    """Wealth and its drawdown from the running maximum, the starting capital of 1 included."""
    return rounded(S.with_drawdown(returns(spark, at), "ret"), "nav", "drawdown")


@query(sql(f", f AS (SELECT *, (volume - lag(volume) {over()}) * close AS flow FROM panel) SELECT security_id, session_no, {r('flow', 'flow')}, " + ", ".join(r(f"CASE WHEN count(flow) {last(n)} = {n} THEN sum(flow) {last(n)} END", f"flow_{n}") for n in (5, 20)) + " FROM f"))
def w24_net_flows(spark, at):
    """Change of a quantity times price, and its sums over full windows."""
    df = panel(spark, at, "volume", "close").withColumn("flow", (F.col("volume") - F.lag("volume").over(S.by_security())) * F.col("close"))
    return rounded(df.withColumns({f"flow_{n}": S.full(F.sum("flow"), "flow", n) for n in (5, 20)}), "flow", "flow_5", "flow_20")


@query(sql("""
, t AS (SELECT a.security_id, a.session_no, min(b.session_no - a.session_no) AS touch_at FROM bars a JOIN bars b ON b.security_id = a.security_id
  AND b.session_no BETWEEN a.session_no + 1 AND a.session_no + 10 AND (b.high >= a.close * 1.03 OR b.low <= a.close * 0.97) WHERE a.close > 0 GROUP BY ALL)
SELECT a.security_id, a.session_no, CAST(touch_at AS INT) AS touch_at, CASE WHEN touch_at IS NULL THEN 'none' WHEN b.high >= a.close * 1.03 AND b.low <= a.close * 0.97 THEN 'both' WHEN b.high >= a.close * 1.03 THEN 'up' ELSE 'down' END AS touch
FROM bars a LEFT JOIN t USING (security_id, session_no) LEFT JOIN bars b ON b.security_id = a.security_id AND b.session_no = a.session_no + touch_at WHERE a.close > 0""", dense=False))
def w26_first_touch(spark, at):
    """Which barrier is touched first within ten sessions."""
    df = panel(spark, at, "high", "low", "close")
    out = S.first_touch(df, [*ID, "close"], F.col("close") * 1.03, F.col("close") * 0.97, "high", "low", 10)
    return out.where("close > 0").select(*ID, F.col("touch_at").cast("int").alias("touch_at"), "touch")


@query(sql(RET + f"""
, w AS (SELECT a.session_no AS day, b.security_id, b.session_no, (b.ret - a.m) / nullif(a.s, 0) AS z FROM
  (SELECT security_id, session_no, avg(ret) {last(20)} AS m, stddev_samp(ret) {last(20)} AS s, count(ret) {last(20)} AS n FROM ret) a
  JOIN ret b ON b.security_id = a.security_id AND b.session_no BETWEEN a.session_no - 19 AND a.session_no WHERE a.n = 20 AND a.s > 0),
t AS (SELECT day, session_no, sum(z) AS s, sum(z * z) AS q, count(*) AS n FROM w GROUP BY ALL)
SELECT day AS session_no, max(n) AS members, round(sum(s * s - q) / (19.0 * max(n) * (max(n) - 1)), 6) + 0.0 AS correlation FROM t GROUP BY day HAVING max(n) > 1"""))
def w27_average_correlation(spark, at):
    """Average pairwise correlation over 20 sessions from sums of z-scores: no pair is formed."""
    w = S.frame(20)
    df = returns(spark, at).withColumns({"_m": F.avg("ret").over(w), "_s": F.stddev_samp("ret").over(w), "_n": F.count("ret").over(w), "_r": F.collect_list(F.struct("session_no", "ret")).over(w)})
    z = df.where("_n = 20 AND _s > 0").select(F.col("session_no").alias("_at"), F.explode("_r").alias("_x"), "_m", "_s")
    days = z.select("_at", F.col("_x.session_no").alias("_d"), ((F.col("_x.ret") - F.col("_m")) / F.col("_s")).alias("_z"))
    sums = days.groupBy("_at", "_d").agg(F.sum("_z").alias("_s"), F.sum(F.col("_z") * F.col("_z")).alias("_q"), F.count("_z").alias("_n"))
    n = F.max("_n")
    out = sums.groupBy(F.col("_at").alias("session_no")).agg(n.alias("members"), F.sum(F.col("_s") * F.col("_s") - F.col("_q")).alias("_t")).where("members > 1")
    return out.select("session_no", "members", r6(F.col("_t") / (19.0 * F.col("members") * (F.col("members") - 1))).alias("correlation"))


@query("""
WITH s AS (SELECT session_no, session_date AS d FROM trading_sessions),
m AS (SELECT 'month_end' AS mode, max(d) AS d FROM s GROUP BY date_trunc('month', d)),
w AS (SELECT 'week_end' AS mode, max(d) AS d FROM s GROUP BY date_trunc('week', d + 2)),
n AS (SELECT 'every_20' AS mode, d FROM s WHERE (session_no - 1) % 20 = 0)
SELECT mode, strftime(d, '%Y-%m-%d') AS day FROM (FROM m UNION ALL FROM w UNION ALL FROM n)""")
def w37_rebalance_dates(spark, at):
    """Last session of each month and of each week ending on Friday, and every 20th session."""
    s = sessions(spark, at).select(F.col("session_date").alias("d"), "session_no")
    month = s.groupBy(F.trunc("d", "month").alias("g")).agg(F.max("d").alias("d")).select(F.lit("month_end").alias("mode"), "d")
    week = s.groupBy(F.date_trunc("week", F.date_add("d", 2)).alias("g")).agg(F.max("d").alias("d")).select(F.lit("week_end").alias("mode"), "d")
    every = s.where((F.col("session_no") - 1) % 20 == 0).select(F.lit("every_20").alias("mode"), "d")
    return month.unionByName(week).unionByName(every).select("mode", F.date_format("d", "yyyy-MM-dd").alias("day"))


@query(sql(f" SELECT security_id, session_no, CASE WHEN count(*) {over('2 PRECEDING AND 2 FOLLOWING')} = 5 AND high IS NOT NULL THEN high >= max(high) {over('2 PRECEDING AND 2 FOLLOWING')} END AS peak FROM panel"))
def w41_local_highs(spark, at):
    """Highs that none of the two sessions on either side exceeds."""
    return panel(spark, at, "high").select(*ID, S.local_maximum("high", 2).alias("peak"))


@query(sql(f" SELECT security_id, session_no, count(close) {over('UNBOUNDED PRECEDING AND CURRENT ROW')} >= 60 AS ready FROM panel"))
def w42_warm_up(spark, at):
    """Whether a security has had 60 closes."""
    return panel(spark, at, "close").select(*ID, (F.count("close").over(S.by_security().rowsBetween(Window.unboundedPreceding, 0)) >= 60).alias("ready"))


@query("""
SELECT strftime(a.session_date, '%Y-%m-%d') AS day, list_transform(list_sort(list(b.session_no)), lambda x: CAST(x AS BIGINT))::VARCHAR AS before
FROM trading_sessions a JOIN trading_sessions b ON b.session_no BETWEEN a.session_no - 5 AND a.session_no - 1 GROUP BY 1""")
def w44_previous_sessions(spark, at):
    """The five sessions before each session, from one frame over the calendar."""
    w = Window.partitionBy().orderBy("session_no").rowsBetween(-5, -1)
    s = sessions(spark, at).withColumn("_l", F.collect_list(F.col("session_no").cast("string")).over(w))
    return s.where(F.size("_l") > 0).select(F.date_format("session_date", "yyyy-MM-dd").alias("day"), F.concat(F.lit("["), F.array_join("_l", ", "), F.lit("]")).alias("before"))


@query(sql(f"""
, l AS (SELECT *, lag(close) {over()} AS pc, lag(adj_close) {over()} AS pa FROM panel)
SELECT security_id, session_no, round(pc * adj_close / pa - close, 6) + 0.0 AS dividend FROM l WHERE pc > 0 AND pa > 0 AND pc * adj_close / pa - close > 0.0005"""))
def w43_implied_dividends(spark, at):
    """Cash per share that the adjusted series implies."""
    w = S.by_security()
    df = panel(spark, at, "close", "adj_close").withColumns({"_pc": F.lag("close").over(w), "_pa": F.lag("adj_close").over(w)}).where("_pc > 0 AND _pa > 0")
    value = F.col("_pc") * F.col("adj_close") / F.col("_pa") - F.col("close")
    return df.withColumn("_d", value).where("_d > 0.0005").select(*ID, r6(F.col("_d")).alias("dividend"))
