"""Compositions and remaining data operations of the survey, with their SQL."""

from __future__ import annotations


from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import series, xsec
from tidemark.operators.bars import accepted
from tidemark.plans.base import BARS_SQL, PANEL_SQL, bars, panel, r6, sessions
from tidemark.scale import broadcast_if_bounded, finite, scratch_dir
from tidemark.sources.tables import load
from tidemark.sources.versions import NotPublished, VersionedTable

QUERIES, ORACLES = {}, {}
LAG = "OVER (PARTITION BY security_id ORDER BY session_no)"
RET = f"{PANEL_SQL}, ret AS (SELECT *, adj_close / nullif(lag(adj_close) {LAG}, 0) - 1 AS ret, right(security_id, 1) AS grp FROM panel)"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


G = "OVER (PARTITION BY grp ORDER BY session_no{})"


@query(f"""WITH {RET}, b AS (SELECT session_no, avg(ret) AS b FROM ret WHERE ret IS NOT NULL GROUP BY 1), g AS (SELECT grp, session_no, avg(ret) AS g, sum(close * volume) AS amount, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret <= 0 THEN 0 END) AS breadth FROM ret GROUP BY ALL),
q AS (SELECT grp, session_no, amount, breadth, product(1 + coalesce(g, 0)) {G.format('')} / product(1 + coalesce(b, 0)) {G.format('')} AS q FROM g LEFT JOIN b USING (session_no)),
f AS (SELECT *, q / lag(q, 5) {G.format('')} - 1 AS rs5, q / lag(q, 20) {G.format('')} - 1 AS rs20, amount / nullif(avg(amount) {G.format(' ROWS 19 PRECEDING')}, 0) AS amount_ratio, breadth - lag(breadth, 5) {G.format('')} AS breadth_change FROM q)
SELECT grp, session_no, {r('q', 'ratio')}, {r('rs5', 'rs5')}, {r('rs20', 'rs20')}, {r('amount_ratio', 'amount_ratio')}, {r('breadth_change', 'breadth_change')} FROM f""")
def w20_relative_strength(spark, at):
    """Each group's compounded return against that of all, its changes, turnover and breadth, in one pass over the groups."""
    ret = panel(spark, at, "adj_close", "close", "volume").withColumn("ret", series.change("adj_close")).withColumn("grp", F.right("security_id", F.lit(1)))
    b = ret.where("ret IS NOT NULL").groupBy("session_no").agg(F.avg("ret").alias("b"))
    g = ret.groupBy("grp", "session_no").agg(F.avg("ret").alias("g"), F.sum(F.col("close") * F.col("volume")).alias("amount"), F.avg((F.col("ret") > 0).cast("double")).alias("breadth"))
    w = Window.partitionBy("grp").orderBy("session_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    one = lambda c: F.product(1 + F.coalesce(c, F.lit(0.0))).over(upto)
    q = g.join(b, "session_no", "left").withColumn("q", one("g") / one("b"))
    out = q.select("grp", "session_no", r6(F.col("q")).alias("ratio"), *[r6(F.col("q") / F.lag("q", n).over(w) - 1).alias(f"rs{n}") for n in (5, 20)],
        r6(F.col("amount") / F.nullif(F.avg("amount").over(w.rowsBetween(-19, 0)), F.lit(0.0))).alias("amount_ratio"), r6(F.col("breadth") - F.lag("breadth", 5).over(w)).alias("breadth_change"))
    return out


@query(f"""WITH {BARS_SQL}, t AS (SELECT a.security_id, a.session_no, min(b.session_no) AS at_no FROM bars a JOIN bars b ON b.security_id = a.security_id AND b.session_no BETWEEN a.session_no + 1 AND a.session_no + 6 AND (b.high >= a.close * 1.02 OR b.low <= a.close * 0.96) WHERE a.close > 0 GROUP BY ALL)
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN at_no IS NULL THEN 'none' WHEN b.high >= a.close * 1.02 AND b.low <= a.close * 0.96 THEN 'both' WHEN b.high >= a.close * 1.02 THEN 'up' ELSE 'down' END AS outcome FROM bars a LEFT JOIN t USING (security_id, session_no) LEFT JOIN bars b ON b.security_id = a.security_id AND b.session_no = at_no WHERE a.close > 0) GROUP BY 1""")
def a42_follow_through(spark, at):
    """How often a target or a stop comes first within six sessions."""
    df = panel(spark, at, "high", "low", "close")
    t = series.first_touch(df, ["close"], F.col("close") * 1.02, F.col("close") * 0.96, "high", "low", 6).where("close > 0")
    return t.groupBy(F.col("touch").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RET}, x AS (SELECT row_number() OVER (ORDER BY session_no) - 1 AS i, count(*) OVER () AS n, m FROM (SELECT session_no, avg(ret) AS m FROM ret GROUP BY 1 HAVING count(ret) > 0)),
d AS (SELECT b, j * 10 + k AS place, (CAST('0x' || substr(md5(b || '-' || j), 1, 12) AS BIGINT) + k) % n AS i, n FROM (SELECT DISTINCT n FROM x), (SELECT unnest(range(500)) AS b), (SELECT unnest(range(10)) AS k), LATERAL (SELECT unnest(range((n + 9) // 10)) AS j)),
r AS (SELECT b, avg(m) AS mean FROM d JOIN x USING (i) WHERE place < d.n GROUP BY 1) SELECT {r('quantile_cont(mean, 0.025)', 'low')}, (SELECT {r('avg(m)', 'mean')} FROM x) AS mean, {r('quantile_cont(mean, 0.975)', 'high')} FROM r HAVING count(*) > 0""")
def a33_block_bootstrap(spark, at):
    """An interval of a mean by circular blocks of ten: 500 replicates whose blocks start where a hash of their number says, so that it is the same every time."""
    ret = panel(spark, at, "adj_close").withColumn("ret", series.change("adj_close"))
    # a row per session of the calendar
    whole = Window.partitionBy()
    x = ret.groupBy("session_no").agg(F.avg("ret").alias("m")).where("m IS NOT NULL")
    x = x.select((F.row_number().over(whole.orderBy("session_no")) - 1).cast("bigint").alias("i"), F.count(F.lit(1)).over(whole).alias("n"), "m")
    drawn = x.select("n").distinct().select("n", F.explode(F.sequence(F.lit(0), F.lit(499))).alias("b"))
    drawn = drawn.select("n", "b", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") + 9) / 10) - 1)).alias("j"))
    start = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("b").cast("string"), F.col("j").cast("string"))), 1, 12), 16, 10).cast("bigint")
    drawn = drawn.select("n", "b", "j", start.alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    drawn = drawn.where("j * 10 + k < n").select("b", ((F.col("_s") + F.col("k")) % F.col("n")).alias("i"))
    means = drawn.join(broadcast_if_bounded(x.select("i", "m")), "i").groupBy("b").agg(F.avg("m").alias("mean"))
    edge = means.agg(r6(F.percentile("mean", 0.025)).alias("low"), r6(F.percentile("mean", 0.975)).alias("high"), F.count(F.lit(1)).alias("_n")).where("_n > 0")
    # one row each
    return edge.join(F.broadcast(x.agg(r6(F.avg("m")).alias("mean")))).select("low", "mean", "high")


@query(f"""WITH {RET}, s AS (SELECT *, close / nullif(lag(close, 20) {LAG}, 0) - 1 AS score FROM ret), k AS (SELECT session_no, security_id, score, lead(ret) {LAG} AS next, rank() OVER (PARTITION BY session_no ORDER BY score DESC NULLS LAST) AS rank, ntile(5) OVER (PARTITION BY session_no, score IS NULL ORDER BY score, security_id) AS grp FROM s)
SELECT session_no, security_id, {r('score', 'score')}, rank, grp, {r('next / count(*) OVER (PARTITION BY session_no, grp)', 'contribution')} FROM k WHERE score IS NOT NULL""")
def c16_ranking(spark, at):
    """Per decision day and security: score, rank, group and contribution to the group's next return; filtered by day or security it answers both."""
    s = panel(spark, at, "adj_close", "close").withColumn("ret", series.change("adj_close")).withColumns({"score": series.change("close", 20), "next": F.lead("ret").over(series.by_security())})
    s = s.where("score IS NOT NULL")
    w = Window.partitionBy("session_no")
    k = s.withColumns({"rank": F.rank().over(w.orderBy(F.col("score").desc())), "grp": F.ntile(5).over(w.orderBy("score", "security_id"))})
    return k.select("session_no", "security_id", r6(F.col("score")).alias("score"), "rank", "grp", r6(F.col("next") / F.count(F.lit(1)).over(Window.partitionBy("session_no", "grp"))).alias("contribution"))


@query(f"""WITH {RET}, x AS (SELECT security_id, min(session_no) AS out FROM pit_membership JOIN trading_sessions ON session_date = date WHERE upper(trim(snapshot_type)) = 'FORCED_EXIT' GROUP BY 1)
SELECT security_id, session_no, {r('CASE WHEN session_no > out AND session_no <= ceil(out / 20.0) * 20 THEN 0 ELSE ret END', 'held')} FROM ret LEFT JOIN x USING (security_id)""")
def l07_exit_to_cash(spark, at):
    """Returns after a removal are those of cash until the next rebalance."""
    m = load(spark, at, "pit_membership", "security_id", "date", "snapshot_type").where(F.upper(F.trim("snapshot_type")) == "FORCED_EXIT")
    x = m.join(F.broadcast(sessions(spark, at)), F.col("date") == F.col("session_date")).groupBy("security_id").agg(F.min("session_no").alias("out"))
    ret = panel(spark, at, "adj_close").withColumn("ret", series.change("adj_close")).join(x, "security_id", "left")
    cash = (F.col("session_no") > F.col("out")) & (F.col("session_no") <= F.ceil(F.col("out") / 20.0) * 20)
    return ret.select("security_id", "session_no", r6(F.when(cash, 0.0).otherwise(F.col("ret"))).alias("held"))


FV = "fv AS (SELECT DISTINCT date, security_id, factor_id, CASE WHEN isfinite(raw_value) THEN raw_value END AS raw, CASE WHEN isfinite(clean_value) THEN clean_value END AS clean FROM factor_values)"


@query(f"""WITH {RET}, {FV}, f AS (SELECT session_no, date, security_id, lead(ret) {LAG} AS next FROM ret), j AS (SELECT fv.date, fv.factor_id, raw, clean, next FROM fv JOIN f ON f.security_id = fv.security_id AND f.date = fv.date WHERE next IS NOT NULL AND raw IS NOT NULL AND clean IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY date, factor_id ORDER BY raw) + (count(*) OVER (PARTITION BY date, factor_id, raw) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date, factor_id ORDER BY clean) + (count(*) OVER (PARTITION BY date, factor_id, clean) - 1) / 2.0 AS b, rank() OVER (PARTITION BY date, factor_id ORDER BY next) + (count(*) OVER (PARTITION BY date, factor_id, next) - 1) / 2.0 AS y FROM j)
SELECT factor_id, strftime(date, '%Y-%m-%d') AS day, count(*) AS n, {r('corr(a, y)', 'ic_raw')}, {r('corr(b, y)', 'ic_clean')} FROM k GROUP BY ALL HAVING count(*) >= 5""")
def c13_a38_compare_variants(spark, at):
    """Rank correlations of two variants of every factor with the next return, over the same rows."""
    f = load(spark, at, "factor_values", "date", "security_id", "factor_id", "raw_value", "clean_value").where(finite(F.col("raw_value")) & finite(F.col("clean_value"))).distinct()
    ret = panel(spark, at, "adj_close").withColumn("ret", series.change("adj_close")).withColumn("next", F.lead("ret").over(series.by_security())).where("next IS NOT NULL AND date IS NOT NULL")
    j = f.join(ret.select("security_id", "date", "next"), ["security_id", "date"])
    by = ["date", "factor_id"]
    k = j.select(*by, xsec.average_rank("raw_value", by).alias("a"), xsec.average_rank("clean_value", by).alias("b"), xsec.average_rank("next", by).alias("y"))
    g = k.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r6(xsec.correlation(F.col("a"), F.col("y"))).alias("ic_raw"), r6(xsec.correlation(F.col("b"), F.col("y"))).alias("ic_clean"))
    return g.where("n >= 5").select("factor_id", day("date").alias("day"), "n", "ic_raw", "ic_clean")


@query("""WITH s AS (SELECT DISTINCT security_id, updated_at, current_ticker, trading_status, delisting_date FROM security_master_snapshots WHERE security_id IS NOT NULL), l AS (SELECT security_id, arg_max(upper(trim(current_ticker)), (updated_at, current_ticker)) AS ticker, arg_max(trading_status, (updated_at, current_ticker)) AS status, max(delisting_date) AS gone FROM s GROUP BY 1),
h AS (SELECT security_id, count(DISTINCT upper(trim(ticker))) AS names FROM symbol_history GROUP BY 1) SELECT security_id, ticker, status, strftime(gone, '%Y-%m-%d') AS delisted, coalesce(names, 0) AS names FROM l LEFT JOIN h USING (security_id) WHERE ticker IS NOT NULL""")
def c14_k10_master(spark, at):
    """A master of one row per security from all snapshots and the symbol history."""
    s = load(spark, at, "security_master_snapshots", "security_id", "updated_at", "current_ticker", "trading_status", "delisting_date").where("security_id IS NOT NULL")
    # a row without a ticker never is the latest, as in the SQL
    latest = F.max(F.when(F.col("current_ticker").isNotNull(), F.struct("updated_at", "current_ticker", "trading_status")))
    m = s.groupBy("security_id").agg(latest.alias("l"), F.max("delisting_date").alias("gone"))
    h = load(spark, at, "symbol_history", "security_id", "ticker").groupBy("security_id").agg(F.countDistinct(F.upper(F.trim("ticker"))).alias("names"))
    out = m.join(h, "security_id", "left").select("security_id", F.upper(F.trim("l.current_ticker")).alias("ticker"), F.col("l.trading_status").alias("status"), day("gone").alias("delisted"), F.coalesce("names", F.lit(0)).alias("names"))
    return out.where("ticker IS NOT NULL")


@query(f"""WITH {BARS_SQL}, f AS (SELECT session_no, max(close) AS level, count(*) AS n FROM bars WHERE close > 0 GROUP BY 1), l AS (SELECT session_no, lead(max(close), 5) OVER (ORDER BY session_no) AS ahead FROM bars WHERE close > 0 GROUP BY 1)
SELECT CAST(t.session_no AS BIGINT) AS session_no, level, round(ahead / level - 1, 5) + 0.0 AS label, last_value(n IGNORE NULLS) OVER (ORDER BY t.session_no ROWS 5 PRECEDING) AS known FROM trading_sessions t LEFT JOIN f USING (session_no) LEFT JOIN l USING (session_no)""")
def c08_regime_dataset(spark, at):
    """Features and labels on one calendar, features filled for at most five sessions."""
    f = bars(spark, at, "close").where("close > 0").groupBy("session_no").agg(F.max("close").alias("level"), F.count(F.lit(1)).alias("n"))
    # a row per session of the calendar
    w = Window.partitionBy().orderBy("session_no")
    labelled = f.withColumn("ahead", F.lead("level", 5).over(w))
    t = sessions(spark, at).select(F.col("session_no").cast("bigint").alias("session_no")).join(F.broadcast(labelled), "session_no", "left")
    return t.select("session_no", "level", (F.round(F.col("ahead") / F.col("level") - 1, 5) + F.lit(0.0)).alias("label"), F.last("n", ignorenulls=True).over(w.rowsBetween(-5, 0)).alias("known"))


@query("""SELECT o_custkey, list_position_key AS place, k AS orderkey, p AS price FROM (SELECT o_custkey, unnest(list(o_orderkey ORDER BY o_orderkey)) AS k, unnest(list(o_totalprice ORDER BY o_orderkey)) AS p, unnest(generate_series(1, count(*))) AS list_position_key FROM orders GROUP BY 1) WHERE p > 200000""")
def e17_zipped_arrays(spark, at):
    """Columns of arrays zipped to rows, then filtered."""
    o = load(spark, at, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    lists = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("l"))
    arrays = lists.select("o_custkey", F.transform("l", lambda x: x["o_orderkey"]).alias("k"), F.transform("l", lambda x: x["o_totalprice"]).alias("p"))
    z = arrays.select("o_custkey", F.posexplode(F.arrays_zip("k", "p")).alias("i", "z"))
    return z.select("o_custkey", (F.col("i") + 1).cast("bigint").alias("place"), F.col("z.k").alias("orderkey"), F.col("z.p").alias("price")).where("price > 200000")


@query("""WITH p AS (SELECT security_id, date, close, ingestion_run_id FROM coverage_bars WHERE source_asof < DATE '2026-01-01' AND isfinite(close)), k AS (SELECT security_id, date, arg_max(close, ingestion_run_id) AS a FROM p GROUP BY ALL), n AS (SELECT security_id, date, arg_max(close, ingestion_run_id) AS b FROM coverage_bars WHERE isfinite(close) GROUP BY ALL)
SELECT strftime(date, '%Y-%m') AS month, count(*) FILTER (a IS NOT NULL AND a IS DISTINCT FROM b) AS changed, count(*) FILTER (a IS NULL) AS added FROM n LEFT JOIN k USING (security_id, date) GROUP BY 1""")
def g08_certify(spark, at):
    """In which months a later delivery differs from what was known at the turn of the year."""
    c = load(spark, at, "coverage_bars", "security_id", "date", "close", "ingestion_run_id", "source_asof").where(finite(F.col("close")))
    k = accepted(c.where("source_asof < DATE '2026-01-01'"), ("security_id", "date"), ("ingestion_run_id",), ("close",)).withColumnRenamed("close", "a")
    n = accepted(c, ("security_id", "date"), ("ingestion_run_id",), ("close",))
    j = n.join(k, ["security_id", "date"], "left").groupBy(F.date_format("date", "yyyy-MM").alias("month"))
    return j.agg(F.count_if(F.col("a").isNotNull() & (F.col("a") != F.col("close"))).alias("changed"), F.count_if(F.col("a").isNull()).alias("added"))


@query("SELECT strftime(date, '%Y-%m') AS month, count(*) AS rows FROM eligibility_audit WHERE date_trunc('month', date) <> DATE '2025-03-01' OR eligible GROUP BY 1")
def k02_k03_k04_k09_replace_month(spark, at):
    """A version whose gate fails is refused; the next one replaces a month of the published one and is read instead."""
    a = load(spark, at, "eligibility_audit", "date", "security_id", "eligible")
    table = VersionedTable(spark, scratch_dir(spark, "audits"), month_of="date")
    table.write(a, "v1", {"rows": F.count(F.lit(1)) >= 0})
    table.publish("v1")
    table.write(a.limit(0), "v2", {"rows": F.count(F.lit(1)) > 0})
    try:
        table.publish("v2", expected="v1")
        raise AssertionError("a failed gate was published")
    except NotPublished:
        pass
    table.replace_months("v1", "v3", a.where("eligible AND trunc(date, 'MM') = DATE '2025-03-01'"))
    table.publish("v3", expected="v1")
    return table.read(verify=True).groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("rows"))


@query("""SELECT security_id, count(*) AS rows, count(DISTINCT (date, ingestion_run_id)) AS distinct_rows FROM (SELECT security_id, date, ingestion_run_id FROM coverage_bars WHERE date < DATE '2025-07-05' UNION ALL SELECT security_id, date, ingestion_run_id FROM coverage_bars WHERE date >= DATE '2025-07-01') GROUP BY 1""")
def s15_s17_chunks(spark, at):
    """Chunks that overlap, united and freed of repetitions."""
    c = load(spark, at, "coverage_bars", "security_id", "date", "ingestion_run_id")
    both = c.where("date < DATE '2025-07-05'").unionByName(c.where("date >= DATE '2025-07-01'"))
    per = both.groupBy("security_id", "date", "ingestion_run_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("security_id").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows"))


@query("""WITH m AS (SELECT DISTINCT security_id FROM eligibility_audit), l AS (SELECT security_id, max(date) AS d FROM eligibility_audit GROUP BY 1), c AS (SELECT e.security_id, any_value(adv20_usd) AS cap, count(*) AS n FROM eligibility_audit e JOIN l ON l.security_id = e.security_id AND l.d = e.date GROUP BY 1)
SELECT security_id, round(cap, 4) + 0.0 AS cap, CASE WHEN cap IS NULL THEN 'MISSING' ELSE 'OK' END AS state FROM m LEFT JOIN c USING (security_id)""")
def j14_one_to_one(spark, at):
    """The last figure of each security, one row to one."""
    e = load(spark, at, "eligibility_audit", "security_id", "date", "adv20_usd")
    c = e.groupBy("security_id").agg(F.max_by("adv20_usd", "date").alias("cap"))
    return e.select("security_id").distinct().join(c, "security_id", "left").select("security_id", (F.round("cap", 4) + F.lit(0.0)).alias("cap"), F.when(F.col("cap").isNull(), "MISSING").otherwise("OK").alias("state"))


@query("""WITH n AS (SELECT date, regexp_replace(upper(trim(ticker)), '[./]', '-', 'g') AS t, TRY_CAST(CAST(close AS VARCHAR) AS DOUBLE) AS c, ingestion_run_id FROM coverage_bars WHERE ticker IS NOT NULL AND date IS NOT NULL),
k AS (SELECT date, t, arg_max(c, ingestion_run_id) AS c FROM n WHERE isfinite(c) AND c > 0 GROUP BY ALL) SELECT t AS ticker, count(*) AS days, round(max(c), 4) + 0.0 AS highest FROM k GROUP BY 1""")
def proj01_proj02_proj11_normalise(spark, at):
    """Names in one form, texts as numbers where they are some, bad rows out, one row per name and day."""
    c = load(spark, at, "coverage_bars", "date", "ticker", "close", "ingestion_run_id").where("ticker IS NOT NULL AND date IS NOT NULL")
    n = c.select("date", F.regexp_replace(F.upper(F.trim("ticker")), "[./]", "-").alias("ticker"), F.expr("try_cast(cast(close AS string) AS double)").alias("c"), "ingestion_run_id")
    k = accepted(n.where(finite(F.col("c")) & (F.col("c") > 0)), ("date", "ticker"), ("ingestion_run_id",), ("c",))
    return k.groupBy("ticker").agg(F.count(F.lit(1)).alias("days"), (F.round(F.max("c"), 4) + F.lit(0.0)).alias("highest"))


@query(f"""WITH {BARS_SQL}, s AS (SELECT DISTINCT security_id FROM bars) SELECT s.security_id, count(*) AS slots, count(close) AS filled FROM s CROSS JOIN trading_sessions t LEFT JOIN bars b ON b.security_id = s.security_id AND b.session_no = t.session_no GROUP BY 1""")
def proj19_reindex(spark, at):
    """Every security on the exact axis of all sessions, the missing ones counted."""
    b = bars(spark, at, "close")
    # the calendar as one row
    whole = sessions(spark, at).agg(F.collect_set(F.col("session_no").cast("int")).alias("_axis"))
    axis = b.select("security_id").distinct().join(F.broadcast(whole)).select("security_id", F.explode("_axis").alias("session_no"))
    return axis.join(b, ["security_id", "session_no"], "left").groupBy("security_id").agg(F.count(F.lit(1)).alias("slots"), F.count("close").alias("filled"))


@query(f"""WITH {RET}, b AS (SELECT session_no, adj_close FROM panel WHERE security_id = (SELECT any_value(security_id) FROM coverage_bars WHERE ticker = 'QBMK')), x AS (SELECT session_no, adj_close / nullif(lag(adj_close) OVER (ORDER BY session_no), 0) - 1 AS m FROM b)
SELECT security_id, session_no, {r('ret - m', 'excess')} FROM ret JOIN x USING (session_no) WHERE ret IS NOT NULL AND m IS NOT NULL""")
def j25_benchmark_excess(spark, at):
    """Returns over those of the benchmark, joined by session."""
    ids = load(spark, at, "coverage_bars", "security_id", "ticker").where("ticker = 'QBMK'").agg(F.min("security_id").alias("security_id"))
    ret = panel(spark, at, "adj_close").withColumn("ret", series.change("adj_close")).where("ret IS NOT NULL").select("security_id", "session_no", "ret")
    # the benchmark has a row per session of the calendar
    m = ret.join(F.broadcast(ids), "security_id").select("session_no", F.col("ret").alias("m"))
    return ret.join(F.broadcast(m), "session_no").select("security_id", "session_no", r6(F.col("ret") - F.col("m")).alias("excess"))


@query("""WITH f AS (SELECT DISTINCT date, security_id, factor_id, status, pit_member, raw_value FROM factor_values) SELECT factor_id, count(*) AS rows, count(*) - count(DISTINCT (date, security_id)) AS repeated, count(*) FILTER (NOT isfinite(raw_value)) AS not_finite, count(*) FILTER (status NOT IN ('VALID', 'NOT_MEMBER', 'INSUFFICIENT_HISTORY')) AS bad_status,
  count(*) FILTER (status = 'VALID' AND NOT coalesce(pit_member, true)) AS contradictions FROM f GROUP BY 1""")
def g12_observation_checks(spark, at):
    """All checks of the observations of each factor in one aggregate."""
    f = load(spark, at, "factor_values", "date", "security_id", "factor_id", "status", "pit_member", "raw_value").distinct()
    some = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    n = F.count(F.lit(1))
    return f.groupBy("factor_id").agg(n.alias("rows"), (n - F.countDistinct(F.struct("date", "security_id"))).alias("repeated"), some(~finite(F.col("raw_value")) & F.col("raw_value").isNotNull()).alias("not_finite"),
        some(~F.col("status").isin("VALID", "NOT_MEMBER", "INSUFFICIENT_HISTORY")).alias("bad_status"), some((F.col("status") == "VALID") & ~F.coalesce("pit_member", F.lit(True))).alias("contradictions"))


@query("""WITH d AS (SELECT document_id, doc_id, kind, observed_at FROM documents WHERE observed_at IS NOT NULL AND observed_at <= TIMESTAMP '2025-12-31'), k AS (SELECT *, row_number() OVER (PARTITION BY document_id, kind ORDER BY observed_at DESC, doc_id DESC) AS k FROM d) SELECT kind, count(*) AS current, max(doc_id) AS newest FROM k WHERE k = 1 GROUP BY 1""")
def e05_e07_report_as_of(spark, at):
    """The report of each kind as it stood at a time."""
    d = load(spark, at, "documents", "document_id", "doc_id", "kind", "observed_at").where(F.col("observed_at") <= F.lit("2025-12-31").cast("timestamp_ntz"))
    last = d.groupBy("document_id", "kind").agg(F.max(F.struct("observed_at", "doc_id")).alias("m"))
    return last.groupBy("kind").agg(F.count(F.lit(1)).alias("current"), F.max("m.doc_id").alias("newest"))
