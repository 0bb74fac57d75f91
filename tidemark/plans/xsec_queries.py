"""Queries across each date's securities (survey rows X..), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import series, xsec
from tidemark.plans.base import PANEL_SQL, bars, panel, r6
from tidemark.scale import nan_to_null
from tidemark.sources.tables import load

QUERIES, ORACLES = {}, {}
BY = ("date", "factor_id")
FV = """fv AS (SELECT DISTINCT CAST(date AS VARCHAR) AS day, security_id, factor_id, CASE WHEN isfinite(raw_value) THEN raw_value END AS raw,
  CASE WHEN isfinite(clean_value) THEN clean_value END AS clean, pit_member, CASE WHEN right(security_id, 1) < '8' THEN 'A' ELSE 'B' END AS sector FROM factor_values)"""
P = "OVER (PARTITION BY day, factor_id)"


def query(body: str | None = None, before: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if body:
            ORACLES[f.__name__] = f"WITH {before}{FV}{body}"
        return f

    return add


def factors(spark: SparkSession, at: str) -> DataFrame:
    """Factor rows once each, NaN as NULL, with a sector (from the last digit of the id)."""
    df = load(spark, at, "factor_values", "date", "security_id", "factor_id", "raw_value", "clean_value", "pit_member")
    clean = df.select("date", "security_id", "factor_id", nan_to_null(F.col("raw_value")).alias("raw"), nan_to_null(F.col("clean_value")).alias("clean"), "pit_member")
    return clean.distinct().withColumn("day", F.col("date").cast("string")).withColumn("sector", F.when(F.right("security_id", F.lit(1)) < "8", "A").otherwise("B"))


OUT = ("day", "security_id", "factor_id")
MAD = f"""
, m AS (SELECT *, median(raw) {P} AS med FROM fv), d AS (SELECT *, median(abs(raw - med)) {P} AS mad FROM m),
w AS (SELECT *, CASE WHEN mad > 0 THEN greatest(least(raw, med + 3 * 1.4826 * mad), med - 3 * 1.4826 * mad) ELSE raw END AS v FROM d)"""


@query(MAD + " SELECT day, security_id, factor_id, round(CASE WHEN raw IS NULL THEN NULL ELSE v END, 6) + 0.0 AS winsorized FROM w")
def x01_winsorize_mad(spark, at):
    """Clipped to the median ± 3 scaled MADs of the date."""
    return xsec.winsorize_mad(factors(spark, at), "raw", BY, "winsorized").select(*OUT, r6(F.col("winsorized")).alias("winsorized"))


@query(f", s AS (SELECT *, avg(raw) {P} AS m, stddev_samp(raw) {P} AS s FROM fv) SELECT day, security_id, factor_id, round(CASE WHEN raw IS NULL THEN NULL WHEN s IS NULL THEN raw ELSE greatest(least(raw, m + 3 * s), m - 3 * s) END, 6) + 0.0 AS winsorized FROM s")
def x02_winsorize_sigma(spark, at):
    """Clipped to the mean ± 3 standard deviations of the date."""
    return xsec.winsorize_sigma(factors(spark, at), "raw", BY, "winsorized").select(*OUT, r6(F.col("winsorized")).alias("winsorized"))


@query(f" SELECT day, security_id, factor_id, round((raw - avg(raw) {P}) / nullif(stddev_samp(raw) {P}, 0), 6) + 0.0 AS z FROM fv")
def x03_zscore(spark, at):
    """Standardised by the date's mean and deviation."""
    return xsec.zscore(factors(spark, at), "raw", BY, "z").select(*OUT, r6(F.col("z")).alias("z"))


SIZE = f"{PANEL_SQL}, size AS (SELECT security_id, CAST(date AS VARCHAR) AS day, ln(close * volume) AS size FROM bars WHERE close > 0 AND volume > 0), "


@query(f"""
, j AS (SELECT fv.*, size FROM fv LEFT JOIN size USING (security_id, day)), c AS (SELECT * FROM j WHERE raw IS NOT NULL AND size IS NOT NULL),
d AS (SELECT *, raw - avg(raw) OVER g AS dy, size - avg(size) OVER g AS dx, count(*) OVER h AS n FROM c WINDOW g AS (PARTITION BY day, factor_id, sector), h AS (PARTITION BY day, factor_id)),
s AS (SELECT *, dy - coalesce(sum(dx * dy) {P} / nullif(sum(dx * dx) {P}, 0), 0) * dx AS e FROM d)
SELECT day, security_id, factor_id, round(e, 6) + 0.0 AS residual FROM s WHERE n >= 10""", SIZE)  # fmt: skip
def x04_x05_neutralize(spark, at):
    """Residual on sector dummies and log dollar volume, for dates with 10 complete rows."""
    size = bars(spark, at, "close", "volume").where("close > 0 AND volume > 0").select("security_id", "date", F.ln(F.col("close") * F.col("volume")).alias("size"))
    df = xsec.neutralize(factors(spark, at).join(size, ["security_id", "date"], "left"), "raw", BY, "sector", "size", "residual", 10)
    return df.where(F.col("residual").isNotNull()).select(*OUT, r6(F.col("residual")).alias("residual"))


@query(MAD + f""", n AS (SELECT *, CASE WHEN raw IS NOT NULL THEN v - avg(CASE WHEN raw IS NOT NULL THEN v END) OVER (PARTITION BY day, factor_id, sector) END AS e,
  count(raw) {P} AS c FROM w), z AS (SELECT *, CASE WHEN c >= 10 THEN e END AS r FROM n)
SELECT day, security_id, factor_id, round((r - avg(r) {P}) / nullif(stddev_samp(r) {P}, 0), 6) + 0.0 AS processed FROM z""")
def x06_preprocess(spark, at):
    """Winsorised, neutralised by sector, standardised."""
    df = xsec.winsorize_mad(factors(spark, at), "raw", BY, "_w")
    df = xsec.neutralize(df, "_w", BY, "sector", None, "_e", 10)
    return xsec.zscore(df, "_e", BY, "processed").select(*OUT, r6(F.col("processed")).alias("processed"))


RANK = f"""
, r AS (SELECT *, rank() OVER (PARTITION BY day, factor_id ORDER BY clean DESC NULLS LAST) AS a, rank() OVER (PARTITION BY day, factor_id ORDER BY clean NULLS LAST) AS b,
  count(*) OVER (PARTITION BY day, factor_id, clean) AS t, count(clean) {P} AS n, row_number() OVER (PARTITION BY day, factor_id ORDER BY clean NULLS LAST, security_id) AS f FROM fv)"""


@query(RANK + ", p AS (SELECT *, CASE WHEN clean IS NOT NULL THEN a END AS rank, CASE WHEN clean IS NOT NULL THEN 100 * (b + (t - 1) / 2.0) / n END AS p FROM r) SELECT day, security_id, factor_id, rank, round(p, 6) + 0.0 AS percentile, CASE WHEN p <= 20 THEN 1 WHEN p <= 40 THEN 2 WHEN p <= 60 THEN 3 WHEN p <= 80 THEN 4 WHEN p IS NOT NULL THEN 5 END AS quintile FROM p")
def x07_x08_x09_ranks(spark, at):
    """Competition rank, percentile with ties at their mean, and its fifth."""
    df = xsec.ranks(factors(spark, at), "clean", BY)
    return df.select(*OUT, F.col("rank"), r6(F.col("percentile")).alias("percentile"), xsec.quintile(F.col("percentile")).alias("quintile"))


@query(RANK + " SELECT day, security_id, factor_id, CAST(CASE WHEN clean IS NOT NULL AND n >= 5 THEN greatest(1, ceil((f - 1) * 5.0 / greatest(n - 1, 1))) END AS INT) AS grp FROM r")
def x10_x12_quantile_groups(spark, at):
    """Five groups of equal size by rank."""
    return factors(spark, at).select(*OUT, xsec.quantile_groups("clean", BY, "security_id").alias("grp"))


FEATURES = f"""{PANEL_SQL}, feat AS (SELECT security_id, session_no, close / nullif(lag(close, 5) OVER w, 0) - 1 AS r5, close / nullif(lag(close, 20) OVER w, 0) - 1 AS r20,
  volume / nullif(avg(volume) OVER (PARTITION BY security_id ORDER BY session_no ROWS 19 PRECEDING), 0) AS turn FROM panel WINDOW w AS (PARTITION BY security_id ORDER BY session_no)),
whole AS (SELECT * FROM feat WHERE r5 IS NOT NULL AND r20 IS NOT NULL AND turn IS NOT NULL), """


def _features(spark: SparkSession, at: str) -> DataFrame:
    """Three features of each bar that has all of them."""
    turn = series.ratio(F.col("volume"), F.avg("volume").over(series.frame(20)))
    df = panel(spark, at, "close", "volume").withColumns({"r5": series.change("close", 5), "r20": series.change("close", 20), "turn": turn})
    return df.select("security_id", "session_no", "r5", "r20", "turn").dropna()


@query("""
, r AS (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY r5, security_id) AS ra, row_number() OVER (PARTITION BY session_no ORDER BY r20, security_id) AS rb, count(*) OVER (PARTITION BY session_no) AS n FROM whole)
SELECT session_no, security_id, CAST(100 * greatest(1, ceil((rb - 1) * 5.0 / (n - 1))) + greatest(1, ceil((ra - 1) * 5.0 / (n - 1))) AS INT) AS cell FROM r WHERE n >= 5""", FEATURES)
def x11_double_sort(spark, at):
    """Two independent sorts of the same rows as one cell number."""
    cell = 100 * xsec.quantile_groups("r20", ["session_no"], "security_id") + xsec.quantile_groups("r5", ["session_no"], "security_id")
    return _features(spark, at).select("session_no", "security_id", cell.alias("cell")).where(F.col("cell").isNotNull())


@query(""", c AS (SELECT * FROM fv WHERE clean IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY day, factor_id ORDER BY clean DESC, security_id) AS r, count(*) OVER (PARTITION BY day, factor_id) AS n FROM c)
SELECT day, security_id, factor_id, r AS rank, round(CASE WHEN n = 1 THEN 1 ELSE 1 - (r - 1) / (n - 1.0) END, 6) + 0.0 AS percentile FROM r""")
def x13_first_rank(spark, at):
    """Ranks without ties, from 1 down to 0."""
    w = Window.partitionBy(*BY)
    r, n = F.row_number().over(w.orderBy(F.col("clean").desc(), "security_id")), F.count(F.lit(1)).over(w)
    return factors(spark, at).where(F.col("clean").isNotNull()).select(*OUT, r.alias("rank"), r6(F.when(n == 1, 1.0).otherwise(1 - (r - 1) / (n - 1))).alias("percentile"))


@query(" SELECT day, security_id, factor_id, CASE WHEN pit_member IS NULL THEN 'MEMBERSHIP_UNKNOWN' WHEN NOT pit_member THEN 'NOT_A_MEMBER' WHEN raw IS NULL THEN 'RAW_MISSING' WHEN clean IS NULL THEN 'CLEAN_MISSING' ELSE 'VALID' END AS state FROM fv")
def x14_proj16_states(spark, at):
    """The first reason for which a row is left out."""
    state = F.when(F.col("pit_member").isNull(), "MEMBERSHIP_UNKNOWN").when(~F.col("pit_member"), "NOT_A_MEMBER").when(F.col("raw").isNull(), "RAW_MISSING").when(F.col("clean").isNull(), "CLEAN_MISSING").otherwise("VALID")
    return factors(spark, at).select(*OUT, state.alias("state"))


@query("""
, z AS (SELECT *, (r5 - avg(r5) OVER d) / nullif(stddev_samp(r5) OVER d, 0) AS z5, (r20 - avg(r20) OVER d) / nullif(stddev_samp(r20) OVER d, 0) AS z20,
  (turn - avg(turn) OVER d) / nullif(stddev_samp(turn) OVER d, 0) AS zt FROM whole WINDOW d AS (PARTITION BY session_no))
SELECT session_no, security_id, round(0.5 * z20 - 0.25 * z5 - 0.25 * zt, 6) + 0.0 AS score FROM z WHERE z5 IS NOT NULL AND z20 IS NOT NULL AND zt IS NOT NULL""", FEATURES)
def x15_x16_compose(spark, at):
    """Weighted sum of standardised factors where all are there."""
    long = _features(spark, at).select("session_no", "security_id", F.expr("stack(3, 'r5', r5, 'r20', r20, 'turn', turn) AS (factor, value)"))
    z = xsec.zscore(long, "value", ["session_no", "factor"], "z")
    return xsec.compose(z, {"r20": 2.0, "r5": -1.0, "turn": -1.0}, "factor", "z", ("session_no", "security_id"), "score").select("session_no", "security_id", r6(F.col("score")).alias("score"))


@query(RANK + """, g AS (SELECT *, greatest(1, ceil((f - 1) * 5.0 / greatest(n - 1, 1))) AS g FROM r WHERE clean IS NOT NULL AND n >= 5)
SELECT day, security_id, factor_id, round(1.0 / count(*) OVER (PARTITION BY day, factor_id), 6) + 0.0 AS weight FROM g WHERE g = 5""")
def x17_top_targets(spark, at):
    """Equal weights in the top group."""
    top = factors(spark, at).withColumn("g", xsec.quantile_groups("clean", BY, "security_id")).where("g = 5")
    return top.select(*OUT, r6(1 / F.count(F.lit(1)).over(Window.partitionBy(*BY))).alias("weight"))


RETURNS = f"{PANEL_SQL}, ret AS (SELECT security_id, session_no, close, high, low, adj_close / nullif(lag(adj_close) OVER (PARTITION BY security_id ORDER BY session_no), 0) - 1 AS ret FROM panel), "


@query("""
, b AS (SELECT session_no, count(ret) AS n, count(*) FILTER (ret > 0.001) AS a, count(*) FILTER (ret < -0.001) AS d FROM ret GROUP BY 1)
SELECT session_no, n, a AS up, d AS down, round(100.0 * a / n, 6) + 0.0 AS up_pct, round(100.0 * (a - d) / n, 6) + 0.0 AS net_pct, round((a + 0.5) / (d + 0.5), 6) + 0.0 AS ratio FROM b WHERE n > 0""", RETURNS)
def x18_breadth(spark, at):
    """Rising and falling securities beyond a band of ten basis points."""
    ret = panel(spark, at, "adj_close").withColumn("ret", series.change("adj_close"))
    b = ret.groupBy("session_no").agg(F.count("ret").alias("n"), F.count_if(F.col("ret") > 0.001).alias("up"), F.count_if(F.col("ret") < -0.001).alias("down")).where("n > 0")
    return b.select("session_no", "n", "up", "down", r6(100.0 * F.col("up") / F.col("n")).alias("up_pct"), r6(100.0 * (F.col("up") - F.col("down")) / F.col("n")).alias("net_pct"), r6((F.col("up") + 0.5) / (F.col("down") + 0.5)).alias("ratio"))


@query(f"""
, v AS (SELECT day, factor_id, count(raw) AS n_raw, count(clean) AS n_clean, count(*) FILTER (raw IS NOT NULL AND clean IS NULL) AS lost, corr(raw, clean) AS c, stddev_pop(raw) AS s, stddev_pop(clean) AS t FROM fv GROUP BY ALL)
SELECT day, factor_id, n_raw, n_clean, lost, round(CASE WHEN s > 1e-12 AND t > 1e-12 THEN c END, 5) + 0.0 AS correlation FROM v""")
def x20_matched_comparison(spark, at):
    """Two variants of a factor over the same rows: counts, losses and their correlation."""
    g = factors(spark, at).groupBy("day", "factor_id").agg(F.count("raw").alias("n_raw"), F.count("clean").alias("n_clean"), F.count_if(F.col("raw").isNotNull() & F.col("clean").isNull()).alias("lost"),
        xsec.correlation(F.col("raw"), F.col("clean")).alias("c"), F.stddev_pop("raw").alias("s"), F.stddev_pop("clean").alias("t"))
    return g.select("day", "factor_id", "n_raw", "n_clean", "lost", (F.round(F.when((F.col("s") > 1e-12) & (F.col("t") > 1e-12), F.col("c")), 5) + 0.0).alias("correlation"))


@query("""
, k AS (SELECT security_id, session_no, close / nullif(lag(close, 20) OVER (PARTITION BY security_id ORDER BY session_no), 0) - 1 AS r20 FROM ret),
p AS (SELECT *, rank() OVER (PARTITION BY session_no ORDER BY r20) AS a, count(*) OVER (PARTITION BY session_no, r20) AS t, count(*) OVER (PARTITION BY session_no) AS n FROM k WHERE r20 IS NOT NULL)
SELECT security_id, session_no, round((a + (t - 1) / 2.0) / n, 6) + 0.0 AS strength FROM p""", RETURNS)
def x21_relative_strength(spark, at):
    """Percentile of the 20-session change among all securities of the session."""
    df = panel(spark, at, "close").withColumn("r20", series.change("close", 20)).where(F.col("r20").isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy("session_no"))
    return df.select("security_id", "session_no", r6(xsec.average_rank("r20", ["session_no"]) / n).alias("strength"))


@query(", m AS (SELECT max(day) AS day FROM fv) SELECT security_id, factor_id, round(clean, 6) + 0.0 AS clean FROM fv JOIN m USING (day) WHERE clean IS NOT NULL AND factor_id = 'MOM_1M' ORDER BY clean DESC, security_id LIMIT 20")
def x22_top_pool(spark, at):
    """The twenty strongest of the latest date (a top-k report)."""
    df = factors(spark, at)
    latest = df.agg(F.max("day").alias("day"))
    top = df.join(F.broadcast(latest), "day").where((F.col("factor_id") == "MOM_1M") & F.col("clean").isNotNull())
    return top.orderBy(F.col("clean").desc(), "security_id").limit(20).select("security_id", "factor_id", r6(F.col("clean")).alias("clean"))
