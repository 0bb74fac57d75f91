"""Further scans, shapes, comparisons and reports of the survey, with their SQL."""

from __future__ import annotations


from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import series, stats, xsec
from tidemark.plans.base import BARS_SQL, PANEL_SQL, bars, panel, r6, sessions
from tidemark.scale import finite, scratch_dir
from tidemark.sources.tables import load
from tidemark.sources.versions import read_csv

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


def returns(spark: SparkSession, at: str, *more: str):
    df = panel(spark, at, *dict.fromkeys(["adj_close", *more])).withColumn("ret", series.change("adj_close"))
    return df.withColumn("grp", F.right("security_id", F.lit(1)))


@query("SELECT security_id, strftime(date, '%Y-%m-%d') AS day, close FROM coverage_bars WHERE date BETWEEN DATE '2025-02-01' AND DATE '2025-02-28' AND security_id IN (SELECT security_id FROM eligibility_audit WHERE eligible) AND isfinite(close)")
def s01_s03_s08_pruned_scan(spark, at):
    """A month of the bars of eligible securities: filters and columns reach the scan, the set of ids is a semi join."""
    b = load(spark, at, "coverage_bars", "security_id", "date", "close").where("date BETWEEN DATE '2025-02-01' AND DATE '2025-02-28'").where(finite(F.col("close")))
    return b.join(load(spark, at, "eligibility_audit", "security_id", "eligible").where("eligible").select("security_id"), "security_id", "left_semi").select("security_id", day("date").alias("day"), "close")


@query("SELECT security_id, strftime(min(date), '%Y-%m-%d') AS first, strftime(max(date), '%Y-%m-%d') AS last, count(*) AS rows, count(open) AS opens, count(DISTINCT source) AS sources FROM coverage_bars GROUP BY 1")
def s09_summary(spark, at):
    """Extent and fill of each security in one aggregate."""
    return load(spark, at, "coverage_bars", "security_id", "date", "open", "source").groupBy("security_id").agg(
        day(F.min("date")).alias("first"), day(F.max("date")).alias("last"), F.count(F.lit(1)).alias("rows"), F.count("open").alias("opens"), F.countDistinct("source").alias("sources")
    )


@query("SELECT factor_id, strftime(date, '%Y-%m') AS month, count(*) AS rows FROM factor_values WHERE factor_id = 'MOM_1M' AND date >= DATE '2025-06-01' AND date < DATE '2025-09-01' GROUP BY ALL")
def s10_k05_k06_partitions(spark, at):
    """Rows written by factor and month and read back from the wanted partitions only."""
    root = scratch_dir(spark, "factors")
    f = load(spark, at, "factor_values", "factor_id", "date", "security_id").withColumn("month", F.date_format("date", "yyyy-MM"))
    f.repartition("factor_id", "month").sortWithinPartitions("date", "security_id").write.partitionBy("factor_id", "month").parquet(root)
    read = spark.read.parquet(root).where("factor_id = 'MOM_1M' AND month >= '2025-06' AND month < '2025-09'")
    return read.groupBy("factor_id", F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("rows"))


FACTOR_IDS = ("MOM_1M", "MOM_3M", "VOL_20D", "TURNOVER")
FV = "fv AS (SELECT DISTINCT date, security_id, factor_id, CASE WHEN isfinite(raw_value) THEN raw_value END AS raw FROM factor_values)"


def _raw(spark: SparkSession, at: str):
    f = load(spark, at, "factor_values", "date", "security_id", "factor_id", "raw_value")
    return f.select("date", "security_id", "factor_id", F.when(finite(F.col("raw_value")), F.col("raw_value")).alias("raw")).distinct()


@query(f"WITH {FV} SELECT strftime(date, '%Y-%m-%d') AS day, security_id, " + ", ".join(f"max(raw) FILTER (factor_id = '{f}') AS {f.lower()}" for f in FACTOR_IDS) + f" FROM fv WHERE factor_id IN {FACTOR_IDS} GROUP BY ALL")
def s07_u04_pivot(spark, at):
    """Long to wide over a fixed list of columns."""
    p = _raw(spark, at).where(F.col("factor_id").isin(*FACTOR_IDS)).groupBy("date", "security_id").pivot("factor_id", list(FACTOR_IDS)).agg(F.max("raw"))
    return p.select(day("date").alias("day"), "security_id", *[F.col(f).alias(f.lower()) for f in FACTOR_IDS])


@query(f"WITH {PANEL_SQL} SELECT security_id, session_no, field, value FROM (UNPIVOT (SELECT security_id, session_no, open, close, volume FROM bars) ON open, close, volume INTO NAME field VALUE value)")
def u05_unpivot(spark, at):
    """Wide to long, without missing values."""
    b = bars(spark, at, "open", "close", "volume")
    return b.select("security_id", "session_no", F.expr("stack(3, 'open', open, 'close', close, 'volume', volume) AS (field, value)")).where("value IS NOT NULL")


@query("SELECT session_no, strftime(session_date, '%Y-%m-%d') AS day, CASE WHEN session_no % 7 = 0 THEN NULL ELSE CAST(session_no AS DOUBLE) * 0.5 END AS level FROM trading_sessions")
def s16_s21_s22_k15_csv(spark, at):
    """A table through CSV files with a fixed schema, a point for missing values."""
    root = scratch_dir(spark, "csv")
    s = sessions(spark, at).select("session_no", day("session_date").alias("day"), F.when(F.col("session_no") % 7 != 0, F.col("session_no") * 0.5).alias("level"))
    s.write.csv(root, header=True, nullValue=".")
    return read_csv(spark, root, f"session_no {dict(s.dtypes)['session_no']}, day string, level double")


@query("""WITH p AS (SELECT security_id, date, arg_max(close, (coalesce(source_asof, DATE '0001-01-01'), ingestion_run_id)) AS a FROM coverage_bars WHERE source = 'PRIMARY_FEED' AND isfinite(close) GROUP BY ALL), q AS (SELECT security_id, date, arg_max(close, (coalesce(source_asof, DATE '0001-01-01'), ingestion_run_id)) AS b FROM coverage_bars WHERE source = 'SECONDARY_FEED' AND isfinite(close) GROUP BY ALL)
SELECT security_id, count(*) FILTER (b IS NULL) AS only_primary, count(*) FILTER (a IS NULL) AS only_secondary, count(*) FILTER (a = b) AS same, count(*) FILTER (a <> b) AS differs FROM p FULL JOIN q USING (security_id, date) GROUP BY 1""")
def s23_two_feeds(spark, at):
    """Two feeds of the same bars against each other: a full outer join by key."""
    c = load(spark, at, "coverage_bars", "security_id", "date", "close", "source", "source_asof", "ingestion_run_id").where(finite(F.col("close")))
    latest = F.max_by("close", F.struct("source_asof", "ingestion_run_id"))
    side = lambda s, n: c.where(F.col("source") == s).groupBy("security_id", "date").agg(latest.alias(n))
    j = side("PRIMARY_FEED", "a").join(side("SECONDARY_FEED", "b"), ["security_id", "date"], "full_outer")
    return j.groupBy("security_id").agg(F.count_if(F.col("b").isNull()).alias("only_primary"), F.count_if(F.col("a").isNull()).alias("only_secondary"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.count_if(F.col("a") != F.col("b")).alias("differs"))


@query("""WITH m AS (SELECT date, security_id, coalesce(upper(trim(snapshot_type)), '') AS kind, active FROM pit_membership)
SELECT strftime(date, '%Y-%m-%d') AS day, security_id, count(*) AS rows, count(DISTINCT active) > 1 AS conflict FROM m WHERE kind <> 'FORCED_EXIT' GROUP BY ALL HAVING count(*) > 1""")
def s05_s24_conflicts(spark, at):
    """Repeated membership rows and whether they contradict each other."""
    kind = F.coalesce(F.upper(F.trim("snapshot_type")), F.lit(""))
    m = load(spark, at, "pit_membership", "date", "security_id", "snapshot_type", "active").where(kind != "FORCED_EXIT")
    return m.groupBy(day("date").alias("day"), "security_id").agg(F.count(F.lit(1)).alias("rows"), (F.countDistinct("active") > 1).alias("conflict")).where("rows > 1")


@query(r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '<[a-zA-Z/][^<>]*>')) AS tags, len(list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '<[a-zA-Z/][^<>]*>', '', 'g'), '\n+'), lambda p: length(trim(p)) > 0)) AS paragraphs FROM documents""")
def s28_e18_markup(spark, at):
    """Tags and paragraphs of each text."""
    t = F.coalesce("text", F.lit(""))
    plain = F.regexp_replace(t, "<[a-zA-Z/][^<>]*>", "")
    return load(spark, at, "documents", "doc_id", "text").select("doc_id", F.size(F.regexp_extract_all(t, F.lit("<[a-zA-Z/][^<>]*>"), F.lit(0))).alias("tags"), F.size(F.filter(F.split(plain, "\n+"), lambda p: F.length(F.trim(p)) > 0)).alias("paragraphs"))


@query("""WITH m AS (SELECT security_id, min(listing_date) AS f, max(delisting_date) AS t, any_value(upper(asset_type)) FILTER (asset_type IS NOT NULL) AS unused FROM security_master_snapshots GROUP BY 1)
SELECT security_id, coalesce(f, DATE '1900-01-01') <= DATE '2026-06-30' AND coalesce(t, DATE '9999-12-31') >= DATE '2024-07-01' AS alive FROM m""")
def proj09_lifetime(spark, at):
    """Whether a security's life meets a window."""
    d = lambda x: F.lit(x).cast("date")
    m = load(spark, at, "security_master_snapshots", "security_id", "listing_date", "delisting_date").groupBy("security_id").agg(F.min("listing_date").alias("f"), F.max("delisting_date").alias("t"))
    return m.select("security_id", ((F.coalesce("f", d("1900-01-01")) <= d("2026-06-30")) & (F.coalesce("t", d("9999-12-31")) >= d("2024-07-01"))).alias("alive"))


@query(f"WITH {FV}, l AS (SELECT max(date) AS date FROM fv), k AS (SELECT security_id, factor_id, raw, rank() OVER (PARTITION BY factor_id ORDER BY raw DESC NULLS LAST) AS rank FROM fv JOIN l USING (date)) SELECT * FROM k WHERE raw IS NOT NULL ORDER BY factor_id, rank, security_id LIMIT 15 OFFSET 5")
def proj14_proj15_o03_page(spark, at):
    """A page of the latest ranks: ranked over the whole section first, then filtered, sorted and cut (a page is the feature)."""
    f = _raw(spark, at)
    now = f.join(F.broadcast(f.agg(F.max("date").alias("date"))), "date")
    k = now.select("security_id", "factor_id", "raw", F.rank().over(Window.partitionBy("factor_id").orderBy(F.col("raw").desc_nulls_last())).alias("rank"))
    return k.where("raw IS NOT NULL").orderBy("factor_id", "rank", "security_id").offset(5).limit(15)


@query("SELECT security_id, count(*) AS rows FROM coverage_bars WHERE security_id NOT IN (SELECT security_id FROM bar_quarantine WHERE security_id IS NOT NULL) GROUP BY 1")
def proj24_isolation(spark, at):
    """Rows of securities that are in no quarantine."""
    q = load(spark, at, "bar_quarantine", "security_id")
    return load(spark, at, "coverage_bars", "security_id").join(q, "security_id", "left_anti").groupBy("security_id").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {RET}, k AS (SELECT session_no, grp, security_id, ret, row_number() OVER (PARTITION BY session_no, grp ORDER BY ret DESC, security_id) AS k FROM ret WHERE ret IS NOT NULL) SELECT session_no, grp, array_to_string(list(security_id ORDER BY k), ';') AS leaders FROM k WHERE k <= 3 GROUP BY ALL")
def j21_e23_top_three(spark, at):
    """The three best of each group and session as a list (a top-k report)."""
    k = returns(spark, at).where("ret IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("session_no", "grp").orderBy(F.col("ret").desc(), "security_id"))).where("k <= 3")
    return k.groupBy("session_no", "grp").agg(F.array_sort(F.collect_list(F.struct("k", "security_id"))).alias("l")).select("session_no", "grp", F.array_join(F.transform("l", lambda x: x["security_id"]), ";").alias("leaders"))


MA = f"{PANEL_SQL}, q AS (SELECT session_no, avg(close) AS c FROM panel WHERE close > 0 GROUP BY 1), m AS (SELECT *, CASE WHEN count(c) OVER a = 10 THEN avg(c) OVER a END AS m10, CASE WHEN count(c) OVER b = 20 THEN avg(c) OVER b END AS m20 FROM q WINDOW a AS (ORDER BY session_no ROWS 9 PRECEDING), b AS (ORDER BY session_no ROWS 19 PRECEDING))"


@query(f"WITH {MA} SELECT session_no, CASE WHEN lag(m20, 5) OVER (ORDER BY session_no) IS NULL THEN 'UNKNOWN' WHEN m10 > m20 AND m10 > lag(m10, 5) OVER (ORDER BY session_no) AND m20 > lag(m20, 5) OVER (ORDER BY session_no) THEN 'UP' ELSE 'OTHER' END AS regime FROM m")
def w13_market_filter(spark, at):
    """Whether the mean price's averages rise and are in order."""
    # a row per session of the calendar
    w = Window.partitionBy().orderBy("session_no")
    q = panel(spark, at, "close").where("close > 0").groupBy("session_no").agg(F.avg("close").alias("c"))
    m = q.withColumns({f"m{n}": F.when(F.count("c").over(w.rowsBetween(-(n - 1), 0)) == n, F.avg("c").over(w.rowsBetween(-(n - 1), 0))) for n in (10, 20)})
    up = (F.col("m10") > F.col("m20")) & (F.col("m10") > F.lag("m10", 5).over(w)) & (F.col("m20") > F.lag("m20", 5).over(w))
    return m.select("session_no", F.when(F.lag("m20", 5).over(w).isNull(), "UNKNOWN").when(up, "UP").otherwise("OTHER").alias("regime"))


@query(f"""WITH {RET}, k AS (SELECT *, ntile(5) OVER (PARTITION BY session_no ORDER BY close, security_id) AS g FROM ret WHERE close > 0 AND ret IS NOT NULL), m AS (SELECT session_no, g, avg(ret) AS m FROM k GROUP BY ALL),
s AS (SELECT session_no, g, m, rank() OVER (PARTITION BY session_no ORDER BY m) AS q FROM m) SELECT session_no, {r('regr_slope(m, g)', 'slope')}, {r('corr(g, q)', 'monotone')} FROM s GROUP BY 1 HAVING count(*) = 5""")
def g16_monotonicity(spark, at):
    """Slope and rank correlation of groups' means over their numbers."""
    k = returns(spark, at, "close").where("close > 0 AND ret IS NOT NULL").withColumn("g", F.ntile(5).over(Window.partitionBy("session_no").orderBy("close", "security_id")))
    m = k.groupBy("session_no", "g").agg(F.avg("ret").alias("m"))
    s = m.withColumn("q", F.rank().over(Window.partitionBy("session_no").orderBy("m")))
    out = s.groupBy("session_no").agg(F.count(F.lit(1)).alias("n"), r6(F.regr_slope("m", "g")).alias("slope"), r6(xsec.correlation(F.col("g").cast("double"), F.col("q").cast("double"))).alias("monotone"))
    return out.where("n = 5").drop("n")


@query("""WITH a AS (SELECT n_name AS k, sum(c_acctbal) / (SELECT sum(c_acctbal) FROM customer WHERE c_acctbal > 0) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY 1), b AS (SELECT n_name AS k, sum(s_acctbal) / (SELECT sum(s_acctbal) FROM supplier WHERE s_acctbal > 0) AS w FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 GROUP BY 1)
SELECT k AS nation, round(coalesce(a.w, 0), 6) + 0.0 AS own, round(coalesce(b.w, 0), 6) + 0.0 AS benchmark, round(coalesce(a.w, 0) - coalesce(b.w, 0), 6) + 0.0 AS active FROM a FULL JOIN b USING (k)""")
def a26_exposure(spark, at):
    """Weights by group against those of a benchmark, full outer."""
    n = load(spark, at, "nation", "n_nationkey", "n_name")

    def weights(table, key, value, name):
        t = load(spark, at, table, key, value).where(F.col(value) > 0).join(F.broadcast(n), F.col(key) == F.col("n_nationkey")).groupBy(F.col("n_name").alias("nation")).agg(F.sum(value).alias("s"))
        # a row per nation
        return t.select("nation", (F.col("s") / F.sum("s").over(Window.partitionBy())).alias(name))

    j = weights("customer", "c_nationkey", "c_acctbal", "a").join(weights("supplier", "s_nationkey", "s_acctbal", "b"), "nation", "full_outer")
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return j.select("nation", r6(a).alias("own"), r6(b).alias("benchmark"), r6(a - b).alias("active"))


@query(f"WITH {RET} SELECT grp, session_no, count(*) AS held, count(*) - count(ret) AS missing, {r('CASE WHEN count(*) = count(ret) THEN avg(ret) END', 'strict')} FROM ret GROUP BY ALL")
def a27_strict_groups(spark, at):
    """Group means that are NULL as soon as a member's return is missing."""
    n, k = F.count(F.lit(1)), F.count("ret")
    return returns(spark, at).groupBy("grp", "session_no").agg(n.alias("held"), (n - k).alias("missing"), r6(F.when(n == k, F.avg("ret"))).alias("strict"))


@query()
def a34_logistic(spark, at):
    """Ridge logistic regression of rises on momentum by Newton steps; each is one aggregate of five sums."""
    w = series.by_security()
    s = panel(spark, at, "close").select((F.lead("close", 5).over(w) > F.col("close")).cast("double").alias("y"), series.change("close", 20).alias("x")).dropna()
    a, b = stats.logistic(s, "x", "y", 1.0)
    return spark.createDataFrame([(round(a, 9), round(b, 9))], "intercept double, slope double")


@query("""WITH f AS (SELECT k AS fold, k * 100 + 1 AS test_from, least(k * 100 + 100, (SELECT max(session_no) FROM trading_sessions)) AS test_to FROM (SELECT unnest(generate_series(1, (SELECT CAST(max(session_no) AS BIGINT) // 100 FROM trading_sessions))) AS k) WHERE k * 100 + 1 <= (SELECT max(session_no) FROM trading_sessions))
SELECT fold, test_from, test_to, count(*) FILTER (session_no < test_from - 10) AS train, count(*) FILTER (session_no BETWEEN test_from AND test_to) AS test FROM f, trading_sessions GROUP BY ALL""")
def a35_walk_forward(spark, at):
    """Folds of a hundred sessions, each trained on all sessions that end ten before it."""
    s = sessions(spark, at).select("session_no")
    top = s.agg(F.max("session_no").alias("top"))
    # a row per fold: the calendar is one row, counted in closed form as sessions have no gaps
    f = top.select("top", F.explode(F.sequence(F.lit(1), F.floor((F.col("top") - 1) / 100))).alias("fold"))
    start, end = F.col("fold") * 100 + 1, F.least(F.col("fold") * 100 + 100, F.col("top"))
    return f.select("fold", start.alias("test_from"), end.alias("test_to"), (start - 11).alias("train"), (end - start + 1).alias("test"))


@query("""WITH j AS (SELECT doc_id, ticker, kind = 'EARNINGS' AS fresh, row_number() OVER (PARTITION BY ticker ORDER BY observed_at DESC, doc_id) AS per FROM documents WHERE ticker IS NOT NULL), q AS (SELECT *, row_number() OVER (PARTITION BY fresh ORDER BY per, ticker, doc_id) AS k FROM j)
SELECT doc_id, fresh FROM q WHERE (fresh AND k <= 12) OR (NOT fresh AND k <= 4)""")
def o06_quotas(spark, at):
    """A fair choice within quotas per class: one per ticker first (the quota is the feature)."""
    d = load(spark, at, "documents", "doc_id", "ticker", "kind", "observed_at").where("ticker IS NOT NULL")
    j = d.select("doc_id", "ticker", (F.col("kind") == "EARNINGS").alias("fresh"), F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("observed_at").desc_nulls_last(), "doc_id")).alias("per"))
    q = j.withColumn("k", F.row_number().over(Window.partitionBy("fresh").orderBy("per", "ticker", "doc_id")))
    return q.where("(fresh AND k <= 12) OR (NOT fresh AND k <= 4)").select("doc_id", "fresh")


@query(f"WITH {BARS_SQL}, a AS (SELECT session_no, count(*) AS bars FROM bars GROUP BY 1), b AS (SELECT session_no, count(*) AS audits FROM eligibility_audit JOIN trading_sessions ON session_date = date GROUP BY 1) SELECT CAST(session_no AS BIGINT) AS session_no, bars, audits FROM a FULL JOIN b USING (session_no)")
def u03_outer_combine(spark, at):
    """Two feature tables side by side on one axis."""
    a = bars(spark, at, "close").groupBy("session_no").agg(F.count(F.lit(1)).alias("bars"))
    e = load(spark, at, "eligibility_audit", "date").join(F.broadcast(sessions(spark, at)), F.col("date") == F.col("session_date"))
    b = e.groupBy("session_no").agg(F.count(F.lit(1)).alias("audits"))
    return a.join(b, "session_no", "full_outer").select(F.col("session_no").cast("bigint").alias("session_no"), "bars", "audits")


@query("""WITH o AS (SELECT o_custkey, o_orderdate AS d, o_totalprice FROM orders), x AS (SELECT c_custkey, DATE '1996-01-01' AS ex FROM customer)
SELECT c_custkey, round(coalesce(sum(o_totalprice), 0) * 0.01, 4) + 0.0 AS accrued, count(o_custkey) AS orders FROM x LEFT JOIN o ON o_custkey = c_custkey AND d < ex GROUP BY 1""")
def l16_accrual(spark, at):
    """What had been held before a date, times a rate: a range join and a sum."""
    o = load(spark, at, "orders", "o_custkey", "o_orderdate", "o_totalprice").where(F.col("o_orderdate") < F.lit("1996-01-01").cast("date"))
    g = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"))
    c = load(spark, at, "customer", "c_custkey")
    return c.join(g, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", (F.round(F.coalesce("s", F.lit(0.0)) * 0.01, 4) + F.lit(0.0)).alias("accrued"), F.coalesce("n", F.lit(0)).alias("orders"))


@query("""SELECT security_id, any_value(kind) AS kind FROM (SELECT DISTINCT security_id, CASE WHEN regexp_matches(upper(name), '\\b(ETF|FUND|TRUST)\\b') THEN 'FUND' WHEN regexp_matches(upper(name), '\\b(ADR|PLC)\\b') THEN 'ADR' WHEN name IS NULL THEN 'UNKNOWN' ELSE 'STOCK' END AS kind FROM security_master_snapshots) GROUP BY 1 HAVING count(*) = 1""")
def f02_proj21_inference(spark, at):
    """A type inferred from names, where all of a security's names agree."""
    n = F.upper("name")
    kind = F.when(n.rlike(r"\b(ETF|FUND|TRUST)\b"), "FUND").when(n.rlike(r"\b(ADR|PLC)\b"), "ADR").when(n.isNull(), "UNKNOWN").otherwise("STOCK")
    m = load(spark, at, "security_master_snapshots", "security_id", "name").select("security_id", kind.alias("kind")).distinct()
    return m.groupBy("security_id").agg(F.first("kind").alias("kind"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


@query("SELECT doc_id, strftime(CAST(event_date AS TIMESTAMP) + INTERVAL 23 HOUR, '%Y-%m-%d %H:%M') AS available, date_diff('day', event_date, CAST(observed_at AS DATE)) AS age, CASE WHEN observed_at IS NULL OR event_date IS NULL THEN 'UNKNOWN' WHEN CAST(observed_at AS DATE) <= event_date + 1 THEN 'FRESH' WHEN CAST(observed_at AS DATE) <= event_date + 7 THEN 'RECENT' ELSE 'OLD' END AS freshness FROM documents")
def f11_freshness(spark, at):
    """When an event's value is available, and how fresh its document was when seen."""
    seen, e = F.to_date("observed_at"), F.col("event_date")
    label = F.when(seen.isNull() | e.isNull(), "UNKNOWN").when(seen <= F.date_add(e, 1), "FRESH").when(seen <= F.date_add(e, 7), "RECENT").otherwise("OLD")
    d = load(spark, at, "documents", "doc_id", "event_date", "observed_at")
    return d.select("doc_id", F.date_format(e.cast("timestamp") + F.expr("INTERVAL 23 HOURS"), "yyyy-MM-dd HH:mm").alias("available"), F.datediff(seen, e).cast("bigint").alias("age"), label.alias("freshness"))


@query("""WITH h AS (SELECT DISTINCT security_id, upper(trim(ticker)) AS t, effective_from AS f, effective_to AS e FROM symbol_history), m AS (SELECT DISTINCT security_id, query_ticker, start_date AS s, coalesce(next_alias_start - 1, end_date) AS x FROM query_mappings)
SELECT h.security_id, h.t AS ticker, m.query_ticker, strftime(greatest(coalesce(f, s), s), '%Y-%m-%d') AS from_day, strftime(least(coalesce(e, x), x), '%Y-%m-%d') AS to_day FROM h JOIN m ON m.security_id = h.security_id AND coalesce(f, DATE '0001-01-01') <= x AND coalesce(e, DATE '9999-12-31') >= s""")
def g09_segments(spark, at):
    """The parts of intervals that a reviewed window covers."""
    h = load(spark, at, "symbol_history", "security_id", "ticker", "effective_from", "effective_to").select("security_id", F.upper(F.trim("ticker")).alias("ticker"), F.col("effective_from").alias("f"), F.col("effective_to").alias("e")).distinct()
    m = load(spark, at, "query_mappings").select("security_id", "query_ticker", F.col("start_date").alias("s"), F.coalesce(F.date_sub("next_alias_start", 1), "end_date").alias("x")).distinct()
    d = lambda x: F.lit(x).cast("date")
    j = h.join(m, "security_id").where((F.coalesce("f", d("0001-01-01")) <= F.col("x")) & (F.coalesce("e", d("9999-12-31")) >= F.col("s")))
    return j.select("security_id", "ticker", "query_ticker", day(F.greatest(F.coalesce("f", "s"), "s")).alias("from_day"), day(F.least(F.coalesce("e", "x"), "x")).alias("to_day"))


@query("""WITH f AS (SELECT factor_id, md5(concat_ws('|', coalesce(strftime(date, '%Y-%m-%d'), '-'), coalesce(security_id, '-'), coalesce(upper(trim(ticker)), '-'), coalesce(status, '-'), CASE WHEN isfinite(raw_value) THEN CAST(CAST(round(raw_value * 1000000, 0) AS BIGINT) AS VARCHAR) ELSE '-' END)) AS h FROM factor_values)
SELECT factor_id, count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(h, 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM f GROUP BY 1""")
def g13_fingerprint(spark, at):
    """Order-independent fingerprint of each factor's rows: the sum of a hash of each row's canonical text."""
    f = load(spark, at, "factor_values", "factor_id", "date", "security_id", "ticker", "status", "raw_value")
    number = F.when(finite(F.col("raw_value")), F.round(F.col("raw_value") * 1_000_000, 0).cast("bigint").cast("string"))
    parts = [day("date"), F.col("security_id"), F.upper(F.trim("ticker")), F.col("status"), number]
    text = F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in parts])
    return f.groupBy("factor_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").cast("string").alias("fingerprint"))



@query("""WITH m AS (SELECT DISTINCT generation_id, security_id FROM security_master_snapshots), c AS (SELECT DISTINCT security_id, effective_from AS f, effective_to AS t, source_asof AS k FROM symbol_history), g AS (SELECT DISTINCT generation_id, target_session AS d FROM security_master_generations)
SELECT generation_id, count(DISTINCT m.security_id) AS members, count(DISTINCT c.security_id) AS covered FROM g JOIN m USING (generation_id) LEFT JOIN c ON c.security_id = m.security_id AND d BETWEEN coalesce(f, DATE '0001-01-01') AND coalesce(t, DATE '9999-12-31') GROUP BY 1""")
def g01_a40_coverage(spark, at):
    """Members of each snapshot with a valid classification on its day."""
    d = lambda x: F.lit(x).cast("date")
    m = load(spark, at, "security_master_snapshots", "generation_id", "security_id").distinct()
    g = load(spark, at, "security_master_generations", "generation_id", "target_session").distinct()
    c = load(spark, at, "symbol_history").select(F.col("security_id").alias("cs"), F.coalesce("effective_from", d("0001-01-01")).alias("f"), F.coalesce("effective_to", d("9999-12-31")).alias("t")).distinct()
    j = m.join(g, "generation_id").join(c, (F.col("security_id") == F.col("cs")) & F.col("target_session").between(F.col("f"), F.col("t")), "left")
    return j.groupBy("generation_id").agg(F.countDistinct("security_id").alias("members"), F.countDistinct("cs").alias("covered"))


@query("""WITH o AS (SELECT ticker, doc_id, kind, observed_at, row_number() OVER (PARTITION BY ticker ORDER BY observed_at DESC, doc_id DESC) AS k, min(observed_at) OVER (PARTITION BY ticker) AS first FROM documents WHERE ticker IS NOT NULL AND observed_at IS NOT NULL)
SELECT ticker, max(doc_id) FILTER (k = 1) AS latest, strftime(min(first), '%Y-%m-%d') AS first_day, count(*) AS documents, array_to_string(list_sort(list(DISTINCT kind)), ';') AS kinds FROM o GROUP BY 1""")
def e02_e15_e22_dossier(spark, at):
    """Per ticker: the latest document, the first day, the number and the kinds."""
    o = load(spark, at, "documents", "ticker", "doc_id", "kind", "observed_at").where("ticker IS NOT NULL AND observed_at IS NOT NULL")
    return o.groupBy("ticker").agg(F.max_by("doc_id", F.struct("observed_at", "doc_id")).alias("latest"), day(F.min("observed_at")).alias("first_day"), F.count(F.lit(1)).alias("documents"), F.array_join(F.array_sort(F.collect_set("kind")), ";").alias("kinds"))


@query("""WITH t AS (SELECT ticker, doc_id, published_at AS t, 'PUBLISHED' AS step FROM documents UNION ALL SELECT ticker, doc_id, observed_at, 'OBSERVED' FROM documents), w AS (SELECT * FROM t WHERE ticker IS NOT NULL AND t IS NOT NULL)
SELECT ticker, doc_id, step, row_number() OVER (PARTITION BY ticker ORDER BY t, step, doc_id) AS place FROM w""")
def e06_e12_timeline(spark, at):
    """All steps of a ticker's documents in their order."""
    d = load(spark, at, "documents", "ticker", "doc_id", "published_at", "observed_at")
    steps = d.select("ticker", "doc_id", F.expr("stack(2, published_at, 'PUBLISHED', observed_at, 'OBSERVED') AS (t, step)")).where("ticker IS NOT NULL AND t IS NOT NULL")
    return steps.select("ticker", "doc_id", "step", F.row_number().over(Window.partitionBy("ticker").orderBy("t", "step", "doc_id")).alias("place"))


@query(f"""WITH {RET}, k AS (SELECT session_no, security_id, row_number() OVER (PARTITION BY session_no ORDER BY close DESC, security_id) AS r FROM ret WHERE close > 0 AND session_no % 20 = 0), w AS (SELECT session_no, security_id, CAST(0.1 AS DOUBLE) AS w FROM k WHERE r <= 10)
SELECT coalesce(a.session_no, b.session_no + 20) AS session_no, coalesce(a.security_id, b.security_id) AS security_id, round(coalesce(a.w, 0) - coalesce(b.w, 0), 6) + 0.0 AS delta FROM w a FULL JOIN w b ON b.security_id = a.security_id AND b.session_no = a.session_no - 20 WHERE coalesce(a.w, 0) <> coalesce(b.w, 0)""")
def g22_l14_weight_changes(spark, at):
    """Changes of weights between rebalances: a full outer join of the next with the last ones."""
    k = bars(spark, at, "close").where("close > 0 AND session_no % 20 = 0").withColumn("r", F.row_number().over(Window.partitionBy("session_no").orderBy(F.col("close").desc(), "security_id"))).where("r <= 10")
    # the SQL works on the dense panel, where a row without a bar has no close either
    now = k.select("session_no", "security_id", F.lit(0.1).alias("a"))
    past = k.select((F.col("session_no") + 20).alias("session_no"), "security_id", F.lit(0.1).alias("b"))
    z = F.lit(0.0)
    j = now.join(past, ["session_no", "security_id"], "full_outer").withColumn("d", F.coalesce("a", z) - F.coalesce("b", z)).where("d <> 0")
    return j.select("session_no", "security_id", r6(F.col("d")).alias("delta"))


