"""Queries that aggregate (survey rows A.., G.., O..), with their SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import series, stats, xsec
from tidemark.plans.base import BARS_SQL, PANEL_SQL, bars, panel, r6
from tidemark.sources.tables import load

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


LAG = "OVER (PARTITION BY security_id ORDER BY session_no)"
RET = f"{PANEL_SQL}, ret AS (SELECT security_id, session_no, date, close, volume, adj_close / nullif(lag(adj_close) {LAG}, 0) - 1 AS ret, right(security_id, 1) AS grp FROM panel)"


def returns(spark: SparkSession, at: str):
    df = panel(spark, at, "adj_close", "close", "volume").withColumn("ret", series.change("adj_close"))
    return df.withColumn("grp", F.right("security_id", F.lit(1)))


@query(f"""WITH {RET}, v AS (SELECT * FROM ret WHERE ret IS NOT NULL),
m AS (SELECT *, median(ret) OVER g AS med, count(*) OVER g AS n FROM v WINDOW g AS (PARTITION BY grp, session_no)), d AS (SELECT *, median(abs(ret - med)) OVER (PARTITION BY grp, session_no) AS mad FROM m),
w AS (SELECT *, CASE WHEN mad > 0 AND n >= 5 THEN greatest(least(ret, med + 3 * 1.4826 * mad), med - 3 * 1.4826 * mad) ELSE ret END AS x FROM d)
SELECT grp, session_no, count(*) AS n, {r('avg(ret)', 'raw_mean')}, {r('avg(x)', 'robust_mean')}, {r('any_value(med)', 'med')}, {r('stddev_samp(ret)', 'sd')}, {r('(count(*) FILTER (ret > 0) - count(*) FILTER (ret < 0)) / count(*)', 'net')},
  arg_max(security_id, (ret, security_id)) AS best, arg_min(security_id, (ret, security_id)) AS worst, {r('sum(ret * ret) / nullif(sum(abs(ret)) * sum(abs(ret)), 0)', 'concentration')} FROM w GROUP BY ALL""")
def a01_a02_a03_groups(spark, at):
    """Raw, robust and median return, breadth, drivers and concentration of every group and session in one pass."""
    v = returns(spark, at).where(F.col("ret").isNotNull())
    w = xsec.winsorize_mad(v, "ret", ["grp", "session_no"], "x", 3.0, 5)
    size = F.sum(F.abs("ret"))
    n = F.count(F.lit(1))
    return w.groupBy("grp", "session_no").agg(
        n.alias("n"), r6(F.avg("ret")).alias("raw_mean"), r6(F.avg("x")).alias("robust_mean"), r6(F.median("ret")).alias("med"), r6(F.stddev_samp("ret")).alias("sd"),
        r6((F.count_if(F.col("ret") > 0) - F.count_if(F.col("ret") < 0)) / n).alias("net"), F.max(F.struct("ret", "security_id"))["security_id"].alias("best"), F.min(F.struct("ret", "security_id"))["security_id"].alias("worst"),
        r6(F.sum(F.col("ret") * F.col("ret")) / F.nullif(size * size, F.lit(0.0))).alias("concentration"),
    )


@query(f"""WITH {RET}, q AS (SELECT grp, session_no, count(*) AS e, count(ret) AS n, count(ret) / count(*) AS cc FROM ret GROUP BY ALL),
s AS (SELECT *, 100 * (0.35 * cc + 0.25 * cc + 0.2 * cc + 0.2 * least(1, n / 10)) AS score FROM q)
SELECT grp, session_no, {r('score', 'score')}, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' ELSE 'D' END AS grade,
  array_to_string(list_filter([CASE WHEN n < 5 THEN 'FEW_MEMBERS' END, CASE WHEN cc < 0.8 THEN 'LOW_COVERAGE' END], lambda x: x IS NOT NULL), ';') AS reasons FROM s""")
def a04_a05_quality(spark, at):
    """Quality score and grade of every group and session, with the reasons against ranking it."""
    q = returns(spark, at).groupBy("grp", "session_no").agg(F.count(F.lit(1)).alias("e"), F.count("ret").alias("n")).withColumn("cc", F.col("n") / F.col("e"))
    s = q.withColumn("score", 100 * (0.8 * F.col("cc") + 0.2 * F.least(F.lit(1.0), F.col("n") / 10)))
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C").otherwise("D")
    reasons = F.array_compact(F.array(F.when(F.col("n") < 5, "FEW_MEMBERS"), F.when(F.col("cc") < 0.8, "LOW_COVERAGE")))
    return s.select("grp", "session_no", r6(F.col("score")).alias("score"), grade.alias("grade"), F.array_join(reasons, ";").alias("reasons"))


@query(f"""WITH {RET}, c AS (SELECT *, close * volume AS cap, substr(security_id, 5, 1) AS sector FROM ret WHERE close > 0 AND volume > 0)
SELECT session_no, sector, grp, count(*) AS n, {r('sum(cap * ret) FILTER (ret IS NOT NULL) / nullif(sum(cap) FILTER (ret IS NOT NULL), 0)', 'weighted')} FROM c GROUP BY GROUPING SETS ((session_no, sector, grp), (session_no, sector), (session_no))""")
def a06_a07_rollup(spark, at):
    """Size-weighted returns of groups, sectors and the whole by one roll-up; missing returns give their weight to the others."""
    c = returns(spark, at).where("close > 0 AND volume > 0").withColumn("cap", F.when(F.col("ret").isNotNull(), F.col("close") * F.col("volume"))).withColumn("sector", F.substring("security_id", 5, 1))
    rolled = c.groupingSets([["session_no", "sector", "grp"], ["session_no", "sector"], ["session_no"]], "session_no", "sector", "grp")
    return rolled.agg(F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("cap") * F.col("ret")) / F.nullif(F.sum("cap"), F.lit(0.0))).alias("weighted"))


@query(f"""WITH {RET}, m AS (SELECT *, close > avg(close) OVER (PARTITION BY security_id ORDER BY session_no ROWS 19 PRECEDING) AS above, volume AS weight FROM ret WHERE session_no IS NOT NULL)
SELECT grp, session_no, {r('100 * avg(CAST(above AS INT))', 'equal_pct')}, {r('100 * sum(weight) FILTER (above) / nullif(sum(weight) FILTER (above IS NOT NULL), 0)', 'weighted_pct')} FROM m GROUP BY ALL""")
def a08_holdings_breadth(spark, at):
    """Share of a group above its moving averages, by number and by weight."""
    m = returns(spark, at).withColumn("above", F.col("close") > F.avg("close").over(series.frame(20)))
    known = F.when(F.col("above").isNotNull(), F.col("volume"))
    return m.groupBy("grp", "session_no").agg(r6(100 * F.avg(F.col("above").cast("int"))).alias("equal_pct"), r6(100 * F.sum(F.when(F.col("above"), F.col("volume"))) / F.nullif(F.sum(known), F.lit(0.0))).alias("weighted_pct"))


IC = f"""{RET}, f AS (SELECT *, close / nullif(lag(close, 20) {LAG}, 0) - 1 AS mom, CASE WHEN count(ret) OVER w = 5 THEN product(1 + ret) OVER w - 1 END AS fwd FROM ret WINDOW w AS (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
b AS (SELECT *, count(mom) OVER s AS nf, count(CASE WHEN mom IS NOT NULL THEN fwd END) OVER s AS n FROM f WINDOW s AS (PARTITION BY session_no)), c AS (SELECT * FROM b WHERE mom IS NOT NULL AND fwd IS NOT NULL),
k AS (SELECT session_no, n, nf, rank() OVER (PARTITION BY session_no ORDER BY mom) + (count(*) OVER (PARTITION BY session_no, mom) - 1) / 2.0 AS x, rank() OVER (PARTITION BY session_no ORDER BY fwd) + (count(*) OVER (PARTITION BY session_no, fwd) - 1) / 2.0 AS y FROM c),
ic AS (SELECT session_no, any_value(n) AS n, CASE WHEN any_value(n) >= 10 AND any_value(n) >= 0.8 * any_value(nf) THEN corr(x, y) END AS ic FROM k GROUP BY 1)"""


def _ic(spark: SparkSession, at: str):
    """Rank correlation of a 20-session change with the next five sessions, NULL where too many outcomes are missing."""
    f = returns(spark, at).withColumns({"mom": series.change("close", 20), "fwd": series.forward("ret", 5)})
    w = Window.partitionBy("session_no")
    f = f.withColumns({"nf": F.count("mom").over(w), "n": F.count(F.when(F.col("mom").isNotNull(), F.col("fwd"))).over(w)}).where("mom IS NOT NULL AND fwd IS NOT NULL")
    k = f.select("session_no", "n", "nf", xsec.average_rank("mom", ["session_no"]).alias("x"), xsec.average_rank("fwd", ["session_no"]).alias("y"))
    g = k.groupBy("session_no").agg(F.max("n").alias("n"), F.max("nf").alias("nf"), xsec.correlation(F.col("x"), F.col("y")).alias("ic"))
    return g.select("session_no", "n", F.when((F.col("n") >= 10) & (F.col("n") >= 0.8 * F.col("nf")), F.col("ic")).alias("ic"))


@query(f"WITH {IC} SELECT session_no, n, {r('ic', 'ic')} FROM ic")
def a09_a10_information_coefficient(spark, at):
    """Rank correlation of a factor with forward returns per session; a session with too many missing outcomes has none."""
    return _ic(spark, at).select("session_no", "n", r6(F.col("ic")).alias("ic"))


@query(f"""WITH {IC}, d AS (SELECT session_no, ic, ic - avg(ic) OVER () AS d FROM ic WHERE ic IS NOT NULL), g AS (SELECT *, {", ".join(f"d * lag(d, {j}) OVER (ORDER BY session_no) AS g{j}" for j in range(1, 5))} FROM d),
s AS (SELECT count(*) AS n, avg(ic) AS mean, stddev_samp(ic) AS sd, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) AS hit, (sum(d * d) + {" + ".join(f"2 * {1 - j / 5} * coalesce(sum(g{j}), 0)" for j in range(1, 5))}) / count(*) AS lrv FROM g)
SELECT n, {r('mean', 'mean')}, {r('mean / sd', 'ir')}, {r('hit', 'hit')}, {r('sqrt(greatest(lrv, 0) / nullif(n, 0))', 'se')}, {r('mean / sqrt(lrv / nullif(n, 0))', 't')} FROM s""")
def a11_a12_ic_summary(spark, at):
    """Mean, information ratio and hit rate of the coefficients, with a HAC standard error of four lags."""
    ic = _ic(spark, at).where(F.col("ic").isNotNull())
    hac = stats.newey_west(ic, "ic", "session_no", 4)
    plain = ic.agg(F.stddev_samp("ic").alias("sd"), F.avg((F.col("ic") > 0).cast("double")).alias("hit"))
    # one row each
    return hac.join(F.broadcast(plain)).select("n", r6(F.col("mean")).alias("mean"), r6(F.col("mean") / F.col("sd")).alias("ir"), r6(F.col("hit")).alias("hit"), r6(F.col("se")).alias("se"), r6(F.col("t")).alias("t"))


@query(f"""WITH {IC}, v AS (SELECT * FROM ic WHERE ic IS NOT NULL), w AS (SELECT session_no, ntile(3) OVER (ORDER BY session_no) AS part, ic, CASE WHEN count(*) OVER z >= 20 THEN avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) OVER z END AS hit63 FROM v WINDOW z AS (ORDER BY session_no ROWS 62 PRECEDING))
SELECT part, count(*) AS n, {r('avg(ic)', 'mean')}, {r('min(hit63)', 'worst_hit')} FROM w GROUP BY 1""")
def a15_stability(spark, at):
    """Mean of each third of the time, and the worst rolling hit rate in it."""
    order = Window.partitionBy().orderBy("session_no")
    z = order.rowsBetween(-62, 0)
    v = _ic(spark, at).where(F.col("ic").isNotNull())
    v = v.select(F.ntile(3).over(order).alias("part"), "ic", F.when(F.count("ic").over(z) >= 20, F.avg((F.col("ic") > 0).cast("double")).over(z)).alias("h"))
    return v.groupBy("part").agg(F.count("ic").alias("n"), r6(F.avg("ic")).alias("mean"), r6(F.min("h")).alias("worst_hit"))


@query("""WITH fv AS (SELECT DISTINCT date, security_id, factor_id, CASE WHEN isfinite(raw_value) THEN raw_value END AS raw, CASE WHEN isfinite(clean_value) THEN clean_value END AS clean FROM factor_values)
SELECT factor_id, strftime(date, '%Y-%m') AS month, count(*) AS n, round(count(clean) / count(*), 6) + 0.0 AS coverage, count(*) - count(raw) AS missing FROM fv GROUP BY ALL""")
def a18_g17_data_quality(spark, at):
    """Coverage of each factor and month."""
    f = load(spark, at, "factor_values", "date", "security_id", "factor_id", "raw_value", "clean_value")
    ok = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    f = f.select("date", "security_id", "factor_id", ok("raw_value").alias("raw"), ok("clean_value").alias("clean")).distinct()
    n = F.count(F.lit(1))
    return f.groupBy("factor_id", F.date_format("date", "yyyy-MM").alias("month")).agg(n.alias("n"), r6(F.count("clean") / n).alias("coverage"), (n - F.count("raw")).alias("missing"))


TOP = f"""{RET}, f AS (SELECT security_id, session_no, close / nullif(lag(close, 20) {LAG}, 0) - 1 AS mom FROM ret), k AS (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY mom DESC, security_id) AS r, count(*) OVER (PARTITION BY session_no) AS n FROM f WHERE mom IS NOT NULL AND session_no % 20 = 0),
t AS (SELECT session_no, security_id FROM k WHERE r <= floor(n / 5))"""


def _top(spark: SparkSession, at: str):
    f = panel(spark, at, "close").withColumn("mom", series.change("close", 20)).where("mom IS NOT NULL AND session_no % 20 = 0")
    w = Window.partitionBy("session_no")
    return f.withColumns({"r": F.row_number().over(w.orderBy(F.col("mom").desc(), "security_id")), "n": F.count(F.lit(1)).over(w)}).where("r <= floor(n / 5)").select("session_no", "security_id")


@query(f"""WITH {TOP}, j AS (SELECT t.session_no, count(*) AS n, count(p.security_id) AS kept FROM t LEFT JOIN t p ON p.security_id = t.security_id AND p.session_no = t.session_no - 20 GROUP BY 1)
SELECT session_no, n, {r('1 - kept / n', 'turnover')} FROM j""")
def a20_turnover(spark, at):
    """Share of the top fifth that was not in it at the rebalance before."""
    t = _top(spark, at)
    before = t.select((F.col("session_no") + 20).alias("session_no"), "security_id", F.lit(1).alias("_k"))
    n = F.count(F.lit(1))
    return t.join(before, ["session_no", "security_id"], "left").groupBy("session_no").agg(n.alias("n"), r6(1 - F.count("_k") / n).alias("turnover"))


PERF = "round(pow(product(1 + ret), 252.0 / count(ret)) - 1, 5) + 0.0 AS ann_return, round(stddev_samp(ret) * sqrt(252.0), 6) + 0.0 AS ann_vol, round(avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252.0), 5) + 0.0 AS sharpe, round(avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END), 6) + 0.0 AS win_rate"


@query(f"WITH {RET} SELECT security_id, count(ret) AS n, {PERF} FROM ret WHERE ret IS NOT NULL AND ret > -1 GROUP BY 1 HAVING count(ret) >= 60")
def a21_performance(spark, at):
    """Annual return and volatility, Sharpe ratio and win rate of each security with 60 returns."""
    v = returns(spark, at).where("ret IS NOT NULL AND ret > -1")
    p = {k: (F.round(c, 6 if k in ("ann_vol", "win_rate") else 5) + F.lit(0.0)).alias(k) for k, c in stats.performance("ret").items()}
    return v.groupBy("security_id").agg(F.count("ret").alias("n"), *p.values()).where("n >= 60")


@query(f"""WITH {RET}, b AS (SELECT session_no, avg(ret) AS b FROM ret GROUP BY 1), j AS (SELECT security_id, ret, b, ret - b AS a FROM ret JOIN b USING (session_no) WHERE ret IS NOT NULL AND b IS NOT NULL)
SELECT security_id, count(*) AS n, round(avg(a) * 252, 5) + 0.0 AS active, {r('stddev_samp(a) * sqrt(252.0)', 'tracking')}, round(covar_samp(ret, b) / nullif(var_samp(b), 0), 5) + 0.0 AS beta FROM j GROUP BY 1 HAVING count(*) >= 60""")
def a22_relative_performance(spark, at):
    """Active return, tracking error and beta against the equal-weight mean."""
    ret = returns(spark, at)
    b = ret.groupBy("session_no").agg(F.avg("ret").alias("b"))
    j = ret.join(b, "session_no").where("ret IS NOT NULL AND b IS NOT NULL").withColumn("a", F.col("ret") - F.col("b"))
    out = j.groupBy("security_id").agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("a") * 252, 5) + 0.0).alias("active"), r6(F.stddev_samp("a") * 252.0**0.5).alias("tracking"), (F.round(F.covar_samp("ret", "b") / F.nullif(F.var_samp("b"), F.lit(0.0)), 5) + 0.0).alias("beta"))
    return out.where("n >= 60")


EVENTS = f"""{PANEL_SQL}, e AS (SELECT *, close > max(high) OVER (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS hit, lead(open, 1) {LAG} AS buy, lead(open, 6) {LAG} AS sell,
  min(low) OVER (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS worst FROM panel), o AS (SELECT security_id, session_no, strftime(date, '%Y') AS year, sell / buy - 1 AS gross, worst / buy - 1 AS mae FROM e WHERE hit AND buy > 0 AND sell > 0)"""


@query(f"WITH {EVENTS} SELECT year, count(*) AS n, {r('avg(gross)', 'mean')}, {r('median(gross)', 'med')}, {r('avg(CASE WHEN gross > 0 THEN 1.0 ELSE 0 END)', 'win')}, {r('avg(mae)', 'mae')} FROM o GROUP BY 1")
def a23_event_summary(spark, at):
    """Outcomes of events from the next open to the open five sessions later, by year."""
    w = series.by_security()
    e = panel(spark, at, "open", "high", "low", "close").withColumns({"hit": F.col("close") > F.max("high").over(w.rowsBetween(-20, -1)), "buy": F.lead("open", 1).over(w), "sell": F.lead("open", 6).over(w), "worst": F.min("low").over(w.rowsBetween(1, 5))})
    o = e.where("hit AND buy > 0 AND sell > 0").select(F.date_format("date", "yyyy").alias("year"), (F.col("sell") / F.col("buy") - 1).alias("gross"), (F.col("worst") / F.col("buy") - 1).alias("mae"))
    return o.groupBy("year").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("gross")).alias("mean"), r6(F.median("gross")).alias("med"), r6(F.avg((F.col("gross") > 0).cast("double"))).alias("win"), r6(F.avg("mae")).alias("mae"))


@query(f"""WITH {BARS_SQL}, m AS (SELECT date_trunc('month', session_date) AS m, max(session_no) AS no FROM trading_sessions GROUP BY 1)
SELECT strftime(m, '%Y-%m') AS month, security_id, count(*) AS valid, round(avg(close * volume), 1) + 0.0 AS adv20 FROM m JOIN bars ON session_no BETWEEN no - 19 AND no AND close > 0 AND volume >= 0 GROUP BY ALL""")
def a25_month_end_volume(spark, at):
    """Mean dollar volume of the last 20 sessions of every month end, all months at once."""
    from tidemark.plans.base import sessions

    m = sessions(spark, at).groupBy(F.trunc("session_date", "month").alias("m")).agg(F.max("session_no").alias("no"))
    spans = m.select("m", F.explode(F.sequence(F.col("no") - 19, F.col("no"))).alias("n")).select("m", F.col("n").cast("int").alias("session_no"))
    b = bars(spark, at, "close", "volume").where("close > 0 AND volume >= 0")
    # a row per session and month of the calendar
    out = b.join(F.broadcast(spans), "session_no").groupBy(F.date_format("m", "yyyy-MM").alias("month"), "security_id")
    return out.agg(F.count(F.lit(1)).alias("valid"), (F.round(F.avg(F.col("close") * F.col("volume")), 1) + 0.0).alias("adv20"))


SCORES = f"""{EVENTS}, s AS (SELECT strftime(date, '%Y') AS year, lead(close, 5) {LAG} > close AS y, close / nullif(lag(close, 20) {LAG}, 0) - 1 AS score FROM panel), v AS (SELECT * FROM s WHERE y IS NOT NULL AND score IS NOT NULL AND year IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY year ORDER BY score) + (count(*) OVER (PARTITION BY year, score) - 1) / 2.0 AS r FROM v)"""


def _scores(spark: SparkSession, at: str):
    w = series.by_security()
    s = panel(spark, at, "close").withColumns({"y": F.lead("close", 5).over(w) > F.col("close"), "score": series.change("close", 20), "year": F.date_format("date", "yyyy")})
    return s.select("year", "y", "score").dropna()


@query(f"""WITH {SCORES}, g AS (SELECT year, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q, sum(r) FILTER (y) AS s FROM k GROUP BY 1)
SELECT year, p, q, {r('(s - p * (p + 1) / 2.0) / nullif(p * q, 0)', 'auc')}, {r('(s - p * (p + 1) / 2.0 - p * q / 2.0) / sqrt(p * q * (p + q + 1) / 12.0)', 'z')} FROM g""")
def a29_a32_rank_tests(spark, at):
    """Area under the ROC curve and the rank-sum statistic, from one set of ranks."""
    k = _scores(spark, at).withColumn("r", xsec.average_rank("score", ["year"]))
    g = k.groupBy("year").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("q"), F.sum(F.when(F.col("y"), F.col("r"))).alias("s"))
    # the variance is a product of three counts, beyond a bigint from 3.3 million rows a year
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    u = F.col("s") - p * (p + 1) / 2.0
    pairs = p * q
    z = (u - pairs / 2.0) / F.nullif(F.sqrt(pairs * (p + q + 1) / 12.0), F.lit(0.0))
    # where all of a year's outcomes are alike, SQL divides 0 by 0
    alike = (pairs == 0) & u.isNotNull()
    return g.select("year", "p", "q", r6(u / F.nullif(pairs, F.lit(0.0))).alias("auc"), r6(F.when(alike, F.lit(float("nan"))).otherwise(z)).alias("z"))


@query(f"""WITH {SCORES}, t AS (SELECT year, score, count(*) FILTER (y) AS tp, count(*) AS n FROM v GROUP BY ALL), c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY year) AS all_p FROM t WINDOW w AS (PARTITION BY year ORDER BY score DESC))
SELECT year, {r('sum(tp / all_p * (ctp / cn))', 'average_precision')} FROM c GROUP BY 1""")
def a30_average_precision(spark, at):
    """Average precision with equal scores taken together."""
    t = _scores(spark, at).groupBy("year", "score").agg(F.count_if("y").alias("tp"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("year").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    c = t.select("year", "tp", F.sum("tp").over(w).alias("ctp"), F.sum("n").over(w).alias("cn"), F.sum("tp").over(Window.partitionBy("year")).alias("p"))
    return c.groupBy("year").agg(r6(F.sum(F.col("tp") / F.col("p") * (F.col("ctp") / F.col("cn")))).alias("average_precision"))


@query(f"""WITH {SCORES}, p AS (SELECT year, y, 1 / (1 + exp(-score * 10)) AS p FROM v), b AS (SELECT year, least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS m, avg(CASE WHEN y THEN 1.0 ELSE 0 END) AS o FROM p GROUP BY ALL)
SELECT year, {r('sum(n * abs(m - o)) / sum(n)', 'ece')} FROM b GROUP BY 1""")
def a31_calibration(spark, at):
    """Expected calibration error over ten bins of equal width."""
    p = _scores(spark, at).withColumn("p", 1 / (1 + F.exp(-F.col("score") * 10)))
    b = p.groupBy("year", F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("m"), F.avg(F.col("y").cast("double")).alias("o"))
    return b.groupBy("year").agg(r6(F.sum(F.col("n") * F.abs(F.col("m") - F.col("o"))) / F.sum("n")).alias("ece"))


@query(f"""WITH {RET}, h AS (SELECT security_id, session_no, session_no - lag(session_no) {LAG} > 3 AS apart FROM ret WHERE abs(ret) > 0.03), e AS (SELECT *, sum(CASE WHEN coalesce(apart, true) THEN 1 ELSE 0 END) {LAG} AS episode FROM h)
SELECT security_id, CAST(episode AS BIGINT) AS episode, min(session_no) AS first, max(session_no) AS last, count(*) AS hits FROM e GROUP BY ALL""")
def a36_a37_episodes(spark, at):
    """Large moves with at most three sessions between them as episodes (gaps and islands)."""
    h = returns(spark, at).where(F.abs("ret") > 0.03).select("security_id", "session_no").withColumn("_gap", F.coalesce(F.col("session_no") - F.lag("session_no").over(series.by_security()) > 3, F.lit(True)))
    e = series.segments(h, F.col("_gap"), "episode")
    return e.groupBy("security_id", "episode").agg(F.min("session_no").alias("first"), F.max("session_no").alias("last"), F.count(F.lit(1)).alias("hits"))


@query(f"""WITH {RET}, g AS (SELECT grp, session_no, avg(ret) AS m FROM ret WHERE ret IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY m DESC, grp) AS a, row_number() OVER (PARTITION BY session_no ORDER BY m, grp) AS b, count(*) OVER (PARTITION BY session_no) AS n FROM g)
SELECT session_no, grp, CASE WHEN a <= least(3, n // 2) THEN 'TOP' ELSE 'BOTTOM' END AS side FROM k WHERE a <= least(3, n // 2) OR b <= least(3, n // 2)""")
def o01_o02_top_bottom(spark, at):
    """The three best and worst groups of each session, never more than half of them on a side."""
    g = returns(spark, at).where("ret IS NOT NULL").groupBy("grp", "session_no").agg(F.avg("ret").alias("m"))
    w = Window.partitionBy("session_no")
    k = g.withColumns({"a": F.row_number().over(w.orderBy(F.col("m").desc(), "grp")), "b": F.row_number().over(w.orderBy("m", "grp")), "n": F.count(F.lit(1)).over(w)})
    half = F.least(F.lit(3), F.floor(F.col("n") / 2))
    return k.where((F.col("a") <= half) | (F.col("b") <= half)).select("session_no", "grp", F.when(F.col("a") <= half, "TOP").otherwise("BOTTOM").alias("side"))


@query(f"""WITH {BARS_SQL}, n AS (SELECT session_no, date, count(*) AS k FROM bars WHERE close IS NOT NULL GROUP BY ALL), t AS (SELECT count(DISTINCT security_id) AS t FROM bars)
SELECT strftime(max(date), '%Y-%m-%d') AS covered FROM n, t WHERE k >= 0.5 * t""")
def o07_latest_covered(spark, at):
    """The latest session on which at least half of the securities have a close."""
    b = bars(spark, at, "close")
    n = b.where("close IS NOT NULL").groupBy("date").agg(F.count(F.lit(1)).alias("k"))
    t = b.agg(F.countDistinct("security_id").alias("t"))
    # t is one row
    return n.join(F.broadcast(t)).where("k >= 0.5 * t").agg(F.date_format(F.max("date"), "yyyy-MM-dd").alias("covered"))


@query(f"WITH {IC}, m AS (SELECT ic.*, t.session_date FROM ic JOIN trading_sessions t USING (session_no)) SELECT strftime(session_date, '%Y') AS year, " + ", ".join(f"round(avg(ic) FILTER (month(session_date) = {k}), 6) + 0.0 AS m{k}" for k in range(1, 13)) + " FROM m GROUP BY 1")
def g14_monthly_table(spark, at):
    """Mean coefficient by year and month, pivoted."""
    from tidemark.plans.base import sessions

    m = _ic(spark, at).join(F.broadcast(sessions(spark, at)), "session_no").select(F.date_format("session_date", "yyyy").alias("year"), F.month("session_date").alias("m"), "ic")
    p = m.groupBy("year").pivot("m", list(range(1, 13))).agg(F.avg("ic"))
    return p.select("year", *[r6(F.col(f"`{k}`")).alias(f"m{k}") for k in range(1, 13)])


@query("SELECT generation_id, security_id, count(*) AS rows FROM security_master_snapshots GROUP BY ALL HAVING count(*) > 1 OR generation_id IS NULL OR security_id IS NULL")
def g05_primary_key(spark, at):
    """Keys that are missing or repeated."""
    s = load(spark, at, "security_master_snapshots", "generation_id", "security_id")
    return s.groupBy("generation_id", "security_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 OR generation_id IS NULL OR security_id IS NULL")


@query("WITH s AS (SELECT generation_id, count(DISTINCT security_id) AS n, count(DISTINCT security_id) FILTER (trading_status = 'ACTIVE') AS a FROM security_master_snapshots GROUP BY 1) SELECT g.generation_id, row_count - coalesce(n, 0) AS missing, active_count - coalesce(a, 0) AS missing_active FROM security_master_generations g LEFT JOIN s USING (generation_id)")
def g03_g04_reconciliation(spark, at):
    """What the generations announce against what they deliver."""
    s = load(spark, at, "security_master_snapshots", "generation_id", "security_id", "trading_status")
    s = s.groupBy("generation_id").agg(F.countDistinct("security_id").alias("n"), F.countDistinct(F.when(F.col("trading_status") == "ACTIVE", F.col("security_id"))).alias("a"))
    g = load(spark, at, "security_master_generations", "generation_id", "row_count", "active_count")
    z = F.lit(0)
    return g.join(s, "generation_id", "left").select("generation_id", (F.col("row_count") - F.coalesce("n", z)).alias("missing"), (F.col("active_count") - F.coalesce("a", z)).alias("missing_active"))


@query("WITH f AS (SELECT DISTINCT date, security_id, factor_id, clean_value FROM factor_values WHERE isfinite(clean_value)) SELECT strftime(date, '%Y-%m-%d') AS day, security_id, factor_id, round(percent_rank() OVER (PARTITION BY date, factor_id ORDER BY clean_value), 6) + 0.0 AS pr FROM f")
def g27_percent_rank(spark, at):
    """Share of the cross-section below each value."""
    f = load(spark, at, "factor_values", "date", "security_id", "factor_id", "clean_value").where(~F.isnan("clean_value") & (F.abs("clean_value") != float("inf"))).distinct()
    return f.select(F.date_format("date", "yyyy-MM-dd").alias("day"), "security_id", "factor_id", r6(F.percent_rank().over(Window.partitionBy("date", "factor_id").orderBy("clean_value"))).alias("pr"))


@query(f"""WITH {RET}, a AS (SELECT security_id, session_no, rank() OVER (PARTITION BY session_no ORDER BY close) + (count(*) OVER (PARTITION BY session_no, close) - 1) / 2.0 AS x, close FROM ret WHERE close IS NOT NULL),
j AS (SELECT a.session_no, a.security_id, a.close AS now, b.close AS past FROM a JOIN a b ON b.security_id = a.security_id AND b.session_no = a.session_no - 20),
k AS (SELECT session_no, rank() OVER (PARTITION BY session_no ORDER BY now) + (count(*) OVER (PARTITION BY session_no, now) - 1) / 2.0 AS x, rank() OVER (PARTITION BY session_no ORDER BY past) + (count(*) OVER (PARTITION BY session_no, past) - 1) / 2.0 AS y FROM j)
SELECT session_no, count(*) AS n, {r('corr(x, y)', 'autocorrelation')} FROM k GROUP BY 1 HAVING count(*) >= 10""")
def w29_rank_autocorrelation(spark, at):
    """Rank correlation of a session's values with those of 20 sessions before, over common names."""
    now = bars(spark, at, "close").where("close IS NOT NULL")
    past = now.select("security_id", (F.col("session_no") + 20).alias("session_no"), F.col("close").alias("past"))
    j = now.join(past, ["security_id", "session_no"])
    k = j.select("session_no", xsec.average_rank("close", ["session_no"]).alias("x"), xsec.average_rank("past", ["session_no"]).alias("y"))
    return k.groupBy("session_no").agg(F.count(F.lit(1)).alias("n"), r6(xsec.correlation(F.col("x"), F.col("y"))).alias("autocorrelation")).where("n >= 10")
