"""Feature sets of instruments, breadth, momentum, levels and cross-asset ratios, and the factor block with its confidence report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.functions import factors  # noqa: F401 - registers the built-in factors
from tidemark.operators import series as S
from tidemark.operators import stats, xsec
from tidemark.plans.base import PANEL_SQL, bars, panel, r6, sessions
from tidemark.plans.join_queries import MEMBERS, members
from tidemark.scale import broadcast_if_bounded
from tidemark.sources.tables import load

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


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def last(n: int, key: str = "security_id") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY session_no ROWS {n - 1} PRECEDING)"


def full(agg: str, value: str, n: int) -> str:
    return f"CASE WHEN count({value}) {last(n)} = {n} THEN {agg} {last(n)} END"


def returns(spark: SparkSession, at: str, *more: str) -> DataFrame:
    return panel(spark, at, *dict.fromkeys(["adj_close", *more])).withColumn("ret", S.change("adj_close"))


AVERAGES, SPANS = (5, 10, 20, 50, 200), (1, 5, 20, 60)
_W14 = {
    **{f"ret_{n}": f"adj_close / nullif(lag(adj_close, {n}) {LAG}, 0) - 1" for n in SPANS},
    **{f"off_ma_{n}": f"adj_close / nullif({full('avg(adj_close)', 'adj_close', n)}, 0) - 1" for n in AVERAGES},
    "drawdown_252": f"close / max(close) {last(252)} - 1",
    "realised_vol": f"{full('stddev_samp(ret)', 'ret', 20)} * sqrt(252.0)",
    "atr_pct": f"{full('avg(tr)', 'tr', 14)} / nullif(close, 0)",
    "gap": f"open / nullif(lag(close) {LAG}, 0) - 1",
    "close_location": "(close - low) / nullif(high - low, 0)",
    "illiquidity": f"{full('avg(ill)', 'ill', 20)}",
    "volume_shock": "volume / nullif(CASE WHEN len(vs) = 20 THEN (vs[10] + vs[11]) / 2 END, 0)",
    "down_volume_share": f"sum(CASE WHEN ret < 0 THEN volume ELSE 0 END) {last(20)} / nullif(sum(volume) {last(20)}, 0)",
}


@query(f"""WITH {RET}, t AS (SELECT *, greatest(high - low, abs(high - lag(close) {LAG}), abs(low - lag(close) {LAG})) AS tr0, abs(ret) / nullif(close * volume, 0) * 1e9 AS ill,
  list_sort(list(volume) FILTER (WHERE volume IS NOT NULL) {last(20)}) AS vs, lag(close) {LAG} AS pc FROM ret), u AS (SELECT *, CASE WHEN high IS NOT NULL AND low IS NOT NULL AND pc IS NOT NULL THEN tr0 END AS tr FROM t)
SELECT security_id, session_no, {", ".join(r(e, n) for n, e in _W14.items())} FROM u""")
def w14_price_features(spark, at):
    """All features of an instrument: changes, distances from averages, drawdown, volatility, range, gap, close location, illiquidity, volume shock, share of volume on falling days."""
    df = returns(spark, at, "open", "high", "low", "close", "volume")
    before = F.lag("close").over(S.by_security())
    df = df.withColumns({"tr": F.when(F.col("high").isNotNull() & F.col("low").isNotNull() & before.isNotNull(), S.true_range("high", "low", "close")), "ill": S.ratio(F.abs("ret"), F.col("close") * F.col("volume")) * 1e9})
    f = {f"ret_{n}": S.change("adj_close", n) for n in SPANS}
    f |= {f"off_ma_{n}": S.ratio(F.col("adj_close"), S.full(F.avg("adj_close"), "adj_close", n)) - 1 for n in AVERAGES}
    f |= {
        "drawdown_252": F.col("close") / F.max("close").over(S.frame(252)) - 1,
        "realised_vol": S.full(F.stddev_samp("ret"), "ret", 20) * 252.0**0.5,
        "atr_pct": S.ratio(S.full(F.avg("tr"), "tr", 14), F.col("close")),
        "gap": S.ratio(F.col("open"), before) - 1,
        "close_location": S.ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
        "illiquidity": S.full(F.avg("ill"), "ill", 20),
        "volume_shock": S.ratio(F.col("volume"), S.rolling_median("volume", 20)),
        "down_volume_share": S.ratio(F.sum(F.when(F.col("ret") < 0, F.col("volume")).otherwise(0.0)).over(S.frame(20)), F.sum("volume").over(S.frame(20))),
    }
    return df.withColumns(f).select("security_id", "session_no", *[r6(F.col(c)).alias(c) for c in f])


_WHOLE = "OVER (ORDER BY session_no)"
_ABOVE = ", ".join(f"CASE WHEN count(adj_close) {last(n)} = {n} THEN CAST(adj_close > avg(adj_close) {last(n)} AS INT) END AS a{n}" for n in AVERAGES)


@query(f"""WITH {RET}, {MEMBERS}, i AS (SELECT *, {_ABOVE}, CASE WHEN count(adj_close) {last(252)} = 252 THEN CAST(adj_close >= max(adj_close) {last(252)} AS INT) END AS hi, CASE WHEN count(adj_close) {last(252)} = 252 THEN CAST(adj_close <= min(adj_close) {last(252)} AS INT) END AS lo, lag(adj_close * volume) {LAG} AS cap FROM ret),
j AS (SELECT i.* FROM i JOIN a ON a.security_id = i.security_id AND a.session_no = i.session_no), z AS (SELECT *, median(ret) OVER (PARTITION BY session_no) AS med FROM j),
g AS (SELECT session_no, count(*) AS members, count(ret) AS n, avg(ret) AS ew, sum(ret * cap) / nullif(sum(CASE WHEN ret IS NOT NULL THEN cap END), 0) AS cw, stddev_samp(ret) AS dispersion, median(abs(ret - med)) AS mad,
  count(*) FILTER (ret > 0.0001) AS up, count(*) FILTER (ret < -0.0001) AS down, {", ".join(f"avg(a{n}) AS m{n}" for n in AVERAGES)}, sum(hi) AS highs, sum(lo) AS lows FROM z GROUP BY 1 HAVING count(ret) > 1)
SELECT session_no, members, n, {r('n / members', 'coverage')}, {r('100.0 * up / n', 'up_pct')}, {r('100.0 * down / n', 'down_pct')}, {r('100.0 * (n - up - down) / n', 'flat_pct')}, {r('ew', 'equal_return')}, {r('ew - cw', 'equal_less_weighted')}, {r('dispersion', 'dispersion')}, {r('mad', 'mad')},
  {", ".join(r(f'm{n}', f'above_ma{n}') for n in AVERAGES)}, {", ".join(r(f'm{n} - lag(m{n}, 5) {_WHOLE}', f'above_ma{n}_change') for n in AVERAGES)}, CAST(highs AS BIGINT) AS new_highs, CAST(lows AS BIGINT) AS new_lows, CASE WHEN n >= 0.8 * members THEN 'READY' ELSE 'THIN' END AS gate FROM g""")
def x19_market_breadth(spark, at):
    """Breadth over the members known on each session: rising, falling, above five averages and their changes, new highs and lows, equal and weighted return, dispersion, and the gate on coverage."""
    df = returns(spark, at, "volume")
    above = {f"a{n}": S.full(F.avg("adj_close"), "adj_close", n) for n in AVERAGES}
    df = df.withColumns({c: (F.col("adj_close") > e).cast("int") for c, e in above.items()})
    year = F.count("adj_close").over(S.frame(252)) == 252
    df = df.withColumns({
        "hi": F.when(year, (F.col("adj_close") >= F.max("adj_close").over(S.frame(252))).cast("int")),
        "lo": F.when(year, (F.col("adj_close") <= F.min("adj_close").over(S.frame(252))).cast("int")),
        "cap": F.lag(F.col("adj_close") * F.col("volume")).over(S.by_security()),
    })
    j = df.join(members(spark, at).select("security_id", "session_no"), ["security_id", "session_no"], "left_semi")
    z = j.withColumn("med", F.median("ret").over(Window.partitionBy("session_no")))
    n = F.count("ret")
    g = z.groupBy("session_no").agg(
        F.count(F.lit(1)).alias("members"), n.alias("n"), F.avg("ret").alias("ew"), (F.sum(F.col("ret") * F.col("cap")) / F.nullif(F.sum(F.when(F.col("ret").isNotNull(), F.col("cap"))), F.lit(0.0))).alias("cw"),
        F.stddev_samp("ret").alias("dispersion"), F.median(F.abs(F.col("ret") - F.col("med"))).alias("mad"), F.count_if(F.col("ret") > 0.0001).alias("up"), F.count_if(F.col("ret") < -0.0001).alias("down"),
        *[F.avg(f"a{k}").alias(f"m{k}") for k in AVERAGES], F.sum("hi").alias("new_highs"), F.sum("lo").alias("new_lows"),
    ).where("n > 1")
    # a row per session of the calendar
    whole = Window.partitionBy().orderBy("session_no")
    part = lambda e: r6(100.0 * e / F.col("n"))
    return g.select(
        "session_no", "members", "n", r6(F.col("n") / F.col("members")).alias("coverage"), part(F.col("up")).alias("up_pct"), part(F.col("down")).alias("down_pct"), part(F.col("n") - F.col("up") - F.col("down")).alias("flat_pct"),
        r6(F.col("ew")).alias("equal_return"), r6(F.col("ew") - F.col("cw")).alias("equal_less_weighted"), r6(F.col("dispersion")).alias("dispersion"), r6(F.col("mad")).alias("mad"),
        *[r6(F.col(f"m{k}")).alias(f"above_ma{k}") for k in AVERAGES], *[r6(F.col(f"m{k}") - F.lag(f"m{k}", 5).over(whole)).alias(f"above_ma{k}_change") for k in AVERAGES],
        "new_highs", "new_lows", F.when(F.col("n") >= 0.8 * F.col("members"), "READY").otherwise("THIN").alias("gate"),
    )


@query(f"""WITH {RET}, m AS (SELECT *, lag(adj_close, 21) {LAG} / nullif(lag(adj_close, 252) {LAG}, 0) - 1 AS mom FROM ret), k AS (SELECT *, percent_rank() OVER (PARTITION BY session_no ORDER BY mom) AS p, stddev_samp(ret) OVER (PARTITION BY session_no) AS s FROM m WHERE mom IS NOT NULL AND ret IS NOT NULL),
l AS (SELECT session_no, avg(ret) FILTER (p >= 0.9) AS win, avg(ret) FILTER (p <= 0.1) AS lose, count(*) FILTER (p >= 0.9 AND ret < -2 * s) AS winners_hit, count(*) FILTER (p <= 0.1 AND ret > 2 * s) AS losers_hit FROM k GROUP BY 1),
n AS (SELECT *, win - lose AS spread, product(1 + coalesce(win - lose, 0)) {_WHOLE} AS nav FROM l)
SELECT session_no, {r('win', 'winners')}, {r('lose', 'losers')}, {r('spread', 'spread')}, {r(f'nav / greatest(max(nav) {_WHOLE}, 1) - 1', 'drawdown')}, {r('CASE WHEN count(spread) OVER (ORDER BY session_no ROWS 19 PRECEDING) = 20 THEN stddev_samp(spread) OVER (ORDER BY session_no ROWS 19 PRECEDING) * sqrt(252.0) END', 'vol_20')}, winners_hit, losers_hit FROM n""")
def w28_momentum_stress(spark, at):
    """Legs of the lagged twelve-month momentum, their spread, its drawdown and volatility, and how many of each leg moved against it by two deviations."""
    w = S.by_security()
    m = returns(spark, at).withColumn("mom", S.ratio(F.lag("adj_close", 21).over(w), F.lag("adj_close", 252).over(w)) - 1).where("mom IS NOT NULL AND ret IS NOT NULL")
    day = Window.partitionBy("session_no")
    k = m.withColumns({"p": F.percent_rank().over(day.orderBy("mom")), "s": F.stddev_samp("ret").over(day)})
    top, low = F.col("p") >= 0.9, F.col("p") <= 0.1
    legs = k.groupBy("session_no").agg(F.avg(F.when(top, F.col("ret"))).alias("win"), F.avg(F.when(low, F.col("ret"))).alias("lose"), F.count_if(top & (F.col("ret") < -2 * F.col("s"))).alias("winners_hit"), F.count_if(low & (F.col("ret") > 2 * F.col("s"))).alias("losers_hit"))
    # a row per session of the calendar
    n = S.with_drawdown(legs.withColumn("spread", F.col("win") - F.col("lose")).withColumn("_all", F.lit(0)), "spread", key="_all")
    back = Window.partitionBy("_all").orderBy("session_no").rowsBetween(-19, 0)
    vol = F.when(F.count("spread").over(back) == 20, F.stddev_samp("spread").over(back) * 252.0**0.5)
    return n.select("session_no", r6(F.col("win")).alias("winners"), r6(F.col("lose")).alias("losers"), r6(F.col("spread")).alias("spread"), r6(F.col("drawdown")).alias("drawdown"), r6(vol).alias("vol_20"), "winners_hit", "losers_hit")


_LEVEL = f"{RET}, b AS (SELECT session_no, stddev_samp(ret) * 100 AS level, median(abs(ret)) * 100 AS near, stddev_samp(ret) FILTER (volume > 0) * 100 AS far FROM ret GROUP BY 1 HAVING count(ret) > 1)"
_PCT = "list_filter(list(level) OVER (ORDER BY session_no ROWS 251 PRECEDING), lambda x: x <= level)"


@query(f"""WITH {_LEVEL}, p AS (SELECT *, list(level) OVER (ORDER BY session_no ROWS 251 PRECEDING) AS past FROM b)
SELECT session_no, {r('level', 'level')}, {", ".join(r(f'level - lag(level, {n}) {_WHOLE}', f'diff_{n}') for n in (1, 5, 20))}, {r('CASE WHEN len(past) = 252 THEN len(list_filter(past, lambda x: x <= level)) / 252.0 END', 'percentile_252')}, {r('near / nullif(level, 0)', 'near_ratio')}, {r('far / nullif(level, 0)', 'far_ratio')} FROM p""")
def w16_level_features(spark, at):
    """A volatility level of the market, its differences, its place among the last 252 values, and the ratios of a shorter and a longer measure to it."""
    b = returns(spark, at, "volume").groupBy("session_no").agg(
        (F.stddev_samp("ret") * 100).alias("_level"), (F.median(F.abs("ret")) * 100).alias("near"), (F.stddev_samp(F.when(F.col("volume") > 0, F.col("ret"))) * 100).alias("far"), F.count("ret").alias("_n")
    ).where("_n > 1").withColumn("_all", F.lit(0))
    w = Window.partitionBy("_all").orderBy("session_no")
    past = F.collect_list("_level").over(w.rowsBetween(-251, 0))
    place = F.when(F.size(past) == 252, F.size(F.filter(past, lambda x: x <= F.col("_level"))) / 252.0)
    out = {"level": F.col("_level"), **{f"diff_{n}": F.col("_level") - F.lag("_level", n).over(w) for n in (1, 5, 20)}, "percentile_252": place, "near_ratio": S.ratio(F.col("near"), F.col("_level")), "far_ratio": S.ratio(F.col("far"), F.col("_level"))}
    return b.select("session_no", *[r6(e).alias(c) for c, e in out.items()])


@query(f"""WITH {RET}, g AS (SELECT session_no, right(security_id, 1) AS grp, avg(adj_close) AS c FROM ret WHERE adj_close > 0 GROUP BY ALL), p AS (SELECT a.session_no, a.grp, a.c AS level, a.c / b.c AS ratio FROM g a JOIN g b ON b.session_no = a.session_no AND b.grp = '0' WHERE a.grp <> '0')
SELECT session_no, grp, {r('ratio', 'ratio')}, """ + ", ".join(r(f"ratio / lag(ratio, {n}) OVER (PARTITION BY grp ORDER BY session_no) - 1", f"ratio_change_{n}") for n in (5, 20, 60)) + ", " + ", ".join(r(f"CASE WHEN count(level) OVER (PARTITION BY grp ORDER BY session_no ROWS {n} PRECEDING) = {n + 1} AND session_no - lag(session_no, {n}) OVER (PARTITION BY grp ORDER BY session_no) = {n} THEN level / lag(level, {n}) OVER (PARTITION BY grp ORDER BY session_no) - 1 END", f"strict_return_{n}") for n in (5, 20, 60)) + " FROM p")
def w17_w36_cross_asset(spark, at):
    """Each basket's ratio to a base one with its changes over three horizons, and its own strict returns: no session of the horizon may be missing."""
    g = panel(spark, at, "adj_close").where("adj_close > 0").groupBy("session_no", F.right("security_id", F.lit(1)).alias("grp")).agg(F.avg("adj_close").alias("level"))
    base = g.where("grp = '0'").select("session_no", F.col("level").alias("_b"))
    p = g.where("grp <> '0'").join(base, "session_no").withColumn("ratio", F.col("level") / F.col("_b"))
    w = Window.partitionBy("grp").orderBy("session_no")
    strict = lambda n: F.when((F.count("level").over(w.rowsBetween(-n, 0)) == n + 1) & (F.col("session_no") - F.lag("session_no", n).over(w) == n), F.col("level") / F.lag("level", n).over(w) - 1)
    return p.select("session_no", "grp", r6(F.col("ratio")).alias("ratio"), *[r6(F.col("ratio") / F.lag("ratio", n).over(w) - 1).alias(f"ratio_change_{n}") for n in (5, 20, 60)], *[r6(strict(n)).alias(f"strict_return_{n}") for n in (5, 20, 60)])


@query("""WITH o AS (SELECT CAST(knowledge_date AS DATE) AS known, date AS d, count(*) FILTER (active) AS v FROM pit_membership WHERE knowledge_date IS NOT NULL AND date IS NOT NULL GROUP BY ALL),
k AS (SELECT known, arg_max(v, d) AS v, max(d) AS d FROM o GROUP BY 1), f AS (SELECT s.session_no, s.session_date, k.v, k.d, k.known FROM trading_sessions s ASOF LEFT JOIN k ON s.session_date >= k.known)
SELECT session_no, strftime(known, '%Y-%m-%d') AS known, strftime(d, '%Y-%m-%d') AS observed, CAST(v AS BIGINT) AS level, """ + ", ".join(f"CAST(v - lag(v, {n}) OVER (ORDER BY session_no) AS BIGINT) AS diff_{n}" for n in (1, 5, 20)) + " FROM f")
def w18_by_availability(spark, at):
    """A level on the axis of the days on which it became known: the newest observation of each such day, carried to the sessions, with its differences."""
    o = load(spark, at, "pit_membership", "date", "knowledge_date", "active").dropna(subset=["date", "knowledge_date"]).groupBy("knowledge_date", "date").agg(F.count_if("active").alias("v"))
    k = o.groupBy(F.col("knowledge_date").alias("day")).agg(F.max(F.struct("date", "v")).alias("k"))
    # a row per day of the calendar
    both = sessions(spark, at).select(F.col("session_date").alias("day"), "session_no").join(k.withColumn("known", F.col("day")), "day", "full_outer")
    w = Window.partitionBy().orderBy("day")
    f = both.select("session_no", F.last("known", True).over(w).alias("known"), F.last("k", True).over(w).alias("k")).where("session_no IS NOT NULL")
    s = Window.partitionBy().orderBy("session_no")
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return f.select("session_no", text("known").alias("known"), text("k.date").alias("observed"), F.col("k.v").alias("level"), *[(F.col("k.v") - F.lag("k.v", n).over(s)).alias(f"diff_{n}") for n in (1, 5, 20)])


EIGHT = ("MOM_1M", "MOM_3M", "MOM_6M", "MOM_12M", "VOL_20D", "VOL_60D", "REVERSAL", "TURNOVER")
_MOM = "lag(adj_close, {k}) {w} / nullif(lag(adj_close, {n}) {w}, 0) - 1"
_VOL = "CASE WHEN count(ret) {w} >= {least} THEN stddev_samp(ret) {w} END"
_RAW = {
    **{f"MOM_{m}M": (_MOM.format(k=k, n=n + k, w=LAG), 1) for m, n, k in ((1, 21, 0), (3, 63, 21), (6, 126, 21), (12, 252, 21))},
    **{f"VOL_{n}D": (_VOL.format(w=last(n), least=int(0.8 * n)), -1) for n in (20, 60)},
    "REVERSAL": (f"{full('product(1 + ret)', 'ret', 5)} - 1", -1),
    "TURNOVER": (f"volume / nullif({full('avg(volume)', 'volume', 20)}, 0)", -1),
}
_BY = "OVER (PARTITION BY factor_id, session_no)"
BLOCK = f"""{RET}, {MEMBERS}, e AS (SELECT max(session_no) AS session_no FROM trading_sessions GROUP BY date_trunc('month', session_date)),
wide AS (SELECT security_id, session_no, ln(CASE WHEN close > 0 AND volume > 0 THEN close * volume END) AS size, {", ".join(f"{x} AS {n}" for n, (x, _) in _RAW.items())} FROM ret),
long AS ({" UNION ALL ".join(f"SELECT security_id, session_no, size, '{n}' AS factor_id, {n} AS raw, {d} AS dir FROM wide WHERE session_no IN (SELECT session_no FROM e)" for n, (_, d) in _RAW.items())}),
j AS (SELECT long.*, a.security_id IS NOT NULL AS member, right(long.security_id, 1) < '8' AS sector FROM long LEFT JOIN a ON a.security_id = long.security_id AND a.session_no = long.session_no),
v AS (SELECT *, CASE WHEN member AND size IS NOT NULL THEN raw END AS y FROM j), med AS (SELECT *, median(y) {_BY} AS med FROM v), mad AS (SELECT *, median(abs(y - med)) {_BY} AS mad FROM med),
win AS (SELECT *, CASE WHEN y IS NULL THEN NULL WHEN mad > 0 THEN greatest(least(y, med + 3 * 1.4826 * mad), med - 3 * 1.4826 * mad) ELSE y END AS x FROM mad),
dm AS (SELECT *, x - avg(x) OVER (PARTITION BY factor_id, session_no, sector) AS dy, CASE WHEN x IS NOT NULL THEN size END - avg(CASE WHEN x IS NOT NULL THEN size END) OVER (PARTITION BY factor_id, session_no, sector) AS dx FROM win),
res AS (SELECT *, CASE WHEN count(x) {_BY} >= 10 THEN dy - coalesce(sum(dx * dy) {_BY} / nullif(sum(dx * dx) {_BY}, 0), 0) * dx END AS e FROM dm),
z AS (SELECT *, (e - avg(e) {_BY}) / nullif(stddev_samp(e) {_BY}, 0) AS z FROM res),
block AS (SELECT *, CASE WHEN raw IS NULL THEN 'NO_VALUE' WHEN NOT member THEN 'NOT_MEMBER' WHEN size IS NULL THEN 'NO_SIZE' WHEN z IS NULL THEN 'THIN' ELSE 'VALID' END AS status FROM z)"""


def factor_block(spark: SparkSession, at: str) -> DataFrame:
    """(security_id, session_no, factor_id, raw, z, status, direction) of all registered factors at each month's last session."""
    df = returns(spark, at, "close", "volume")
    size = F.ln(F.when((F.col("close") > 0) & (F.col("volume") > 0), F.col("close") * F.col("volume")))
    wide = df.withColumns({n: fn.REGISTRY[n].build() for n in EIGHT}).withColumn("size", size)
    # a row per month of the calendar
    output = sessions(spark, at).groupBy(F.trunc("session_date", "month")).agg(F.max("session_no").cast("int").alias("session_no")).select("session_no")
    wide = wide.join(F.broadcast(output), "session_no", "left_semi")
    stack = ", ".join(f"'{n}', `{n}`, {fn.REGISTRY[n].direction}" for n in EIGHT)
    long = wide.select("security_id", "session_no", "size", F.expr(f"stack({len(EIGHT)}, {stack}) AS (factor_id, raw, direction)"))
    j = long.join(members(spark, at).select("security_id", "session_no", F.lit(True).alias("member")), ["security_id", "session_no"], "left").withColumn("member", F.coalesce("member", F.lit(False)))
    by = ["factor_id", "session_no"]
    j = j.withColumn("sector", F.right("security_id", F.lit(1)) < "8").withColumn("y", F.when(F.col("member") & F.col("size").isNotNull(), F.col("raw")))
    z = xsec.zscore(xsec.neutralize(xsec.winsorize_mad(j, "y", by, "x"), "x", by, "sector", "size", "e", 10), "e", by, "z")
    status = F.when(F.col("raw").isNull(), "NO_VALUE").when(~F.col("member"), "NOT_MEMBER").when(F.col("size").isNull(), "NO_SIZE").when(F.col("z").isNull(), "THIN").otherwise("VALID")
    return z.select("security_id", "session_no", "factor_id", "raw", "z", status.alias("status"), "direction")


@query(f"WITH {BLOCK} SELECT security_id, session_no, factor_id, {r('raw', 'raw')}, {r('z', 'clean')}, status, CASE WHEN z IS NOT NULL THEN rank() OVER (PARTITION BY factor_id, session_no ORDER BY round(z * dir, 9) DESC NULLS LAST) END AS rank FROM block")
def c01_c02_factor_block(spark, at):
    """From bars to ranked factors at month ends: eight factors, the members known then, clipped, neutralised by sector and size, standardised, with a status for every row."""
    best = Window.partitionBy("factor_id", "session_no").orderBy(F.round(F.col("z") * F.col("direction"), 9).desc_nulls_last())
    return factor_block(spark, at).select("security_id", "session_no", "factor_id", r6(F.col("raw")).alias("raw"), r6(F.col("z")).alias("clean"), "status", F.when(F.col("z").isNotNull(), F.rank().over(best)).alias("rank"))


CONFIDENCE = f"""{BLOCK}, fw AS (SELECT security_id, session_no, CASE WHEN count(ret) OVER w = 20 THEN product(1 + ret) OVER w - 1 END AS fwd FROM ret WINDOW w AS (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
o AS (SELECT factor_id, session_no, security_id, z * dir AS s, fwd FROM block JOIN fw USING (security_id, session_no) WHERE z IS NOT NULL), oc AS (SELECT * FROM o WHERE fwd IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY factor_id, session_no ORDER BY s) + (count(*) OVER (PARTITION BY factor_id, session_no, s) - 1) / 2.0 AS x, rank() OVER (PARTITION BY factor_id, session_no ORDER BY fwd) + (count(*) OVER (PARTITION BY factor_id, session_no, fwd) - 1) / 2.0 AS y FROM oc),
ic AS (SELECT factor_id, session_no, corr(x, y) AS ic FROM rk GROUP BY ALL HAVING count(*) >= 10), dv AS (SELECT *, ic - avg(ic) OVER (PARTITION BY factor_id) AS d FROM ic WHERE ic IS NOT NULL),
gl AS (SELECT *, d * lag(d, 1) OVER w AS g1, d * lag(d, 2) OVER w AS g2, d * lag(d, 3) OVER w AS g3, ntile(3) OVER w AS third FROM dv WINDOW w AS (PARTITION BY factor_id ORDER BY session_no)),
st AS (SELECT factor_id, count(*) AS n, avg(ic) AS mean, stddev_samp(ic) AS sd, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0 END) AS hit, (sum(d * d) + 1.5 * coalesce(sum(g1), 0) + coalesce(sum(g2), 0) + 0.5 * coalesce(sum(g3), 0)) / count(*) AS lrv,
  avg(ic) FILTER (third = 1) AS mean_1, avg(ic) FILTER (third = 2) AS mean_2, avg(ic) FILTER (third = 3) AS mean_3 FROM gl GROUP BY 1),
gr AS (SELECT *, CAST(greatest(1, ceil((rn - 1) * 5.0 / greatest(cn - 1, 1))) AS INT) AS grp FROM (SELECT *, row_number() OVER (PARTITION BY factor_id, session_no ORDER BY s, security_id) AS rn, count(*) OVER (PARTITION BY factor_id, session_no) AS cn FROM o) WHERE cn >= 5),
gm AS (SELECT factor_id, grp, avg(fwd) AS m FROM gr GROUP BY ALL), mono AS (SELECT factor_id, corr(grp, k) AS monotonicity, max(m) FILTER (grp = 5) - max(m) FILTER (grp = 1) AS long_short FROM (SELECT *, rank() OVER (PARTITION BY factor_id ORDER BY m) AS k FROM gm) GROUP BY 1),
tp AS (SELECT factor_id, session_no, security_id FROM gr WHERE grp = 5), es AS (SELECT session_no, lag(session_no) OVER (ORDER BY session_no) AS before FROM e),
tu AS (SELECT factor_id, 1 - count(b) / count(*) AS turnover FROM (SELECT t.factor_id, t.session_no, p.security_id AS b FROM tp t JOIN es USING (session_no) LEFT JOIN tp p ON p.factor_id = t.factor_id AND p.session_no = es.before AND p.security_id = t.security_id WHERE EXISTS (SELECT 1 FROM tp q WHERE q.factor_id = t.factor_id AND q.session_no = es.before)) GROUP BY 1),
ac AS (SELECT factor_id, median(c) AS autocorrelation FROM (SELECT a.factor_id, a.session_no, corr(a.x, b.x) AS c FROM rk a JOIN es USING (session_no) JOIN rk b ON b.factor_id = a.factor_id AND b.security_id = a.security_id AND b.session_no = es.before GROUP BY ALL) GROUP BY 1),
q AS (SELECT *, mean / nullif(sqrt(greatest(lrv, 0) / n), 0) AS t FROM st), "all" AS (SELECT q.*, monotonicity, long_short, turnover, autocorrelation FROM q LEFT JOIN mono USING (factor_id) LEFT JOIN tu USING (factor_id) LEFT JOIN ac USING (factor_id))
SELECT factor_id, n, {r('mean', 'mean')}, {r('mean / sd', 'ir')}, {r('hit', 'hit')}, round(t, 4) + 0.0 AS t, {r('mean_1', 'mean_1')}, {r('mean_2', 'mean_2')}, {r('mean_3', 'mean_3')}, {r('monotonicity', 'monotonicity')}, {r('long_short', 'long_short')}, {r('turnover', 'turnover')}, {r('turnover * 12 * 20', 'cost_bps')}, {r('autocorrelation', 'autocorrelation')} FROM "all" """


@query(f"WITH {CONFIDENCE}")
def a13_a15_a16_a17_c03_confidence(spark, at):
    """The confidence report of each factor, signed by its direction: HAC statistics of its coefficients, thirds of the time, monotone groups, turnover, cost and rank autocorrelation."""
    return _confidence(spark, at).select(
        "factor_id", "n", r6(F.col("mean")).alias("mean"), r6(F.col("mean") / F.col("sd")).alias("ir"), r6(F.col("hit")).alias("hit"), (F.round("t", 4) + 0.0).alias("t"), *[r6(F.col(f"mean_{i}")).alias(f"mean_{i}") for i in (1, 2, 3)],
        *[r6(F.col(c)).alias(c) for c in ("monotonicity", "long_short", "turnover")], r6(F.col("turnover") * 12 * 20).alias("cost_bps"), r6(F.col("autocorrelation")).alias("autocorrelation"),
    )


def _confidence(spark: SparkSession, at: str) -> DataFrame:
    by = ["factor_id", "session_no"]
    fwd = returns(spark, at).select("security_id", "session_no", S.forward("ret", 20).alias("fwd"))
    o = factor_block(spark, at).where("z IS NOT NULL").withColumn("s", F.col("z") * F.col("direction")).join(fwd, ["security_id", "session_no"]).select("factor_id", "session_no", "security_id", "s", "fwd")
    oc = o.where("fwd IS NOT NULL")
    rk = oc.select("factor_id", "session_no", "security_id", xsec.average_rank("s", by).alias("x"), xsec.average_rank("fwd", by).alias("y"))
    ic = rk.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), xsec.correlation(F.col("x"), F.col("y")).alias("ic")).where("_n >= 10 AND ic IS NOT NULL").drop("_n")
    # a row per factor and month from here on
    hac = stats.newey_west(ic, "ic", "session_no", 3, ["factor_id"])
    third = ic.withColumn("third", F.ntile(3).over(Window.partitionBy("factor_id").orderBy("session_no")))
    plain = third.groupBy("factor_id").agg(F.stddev_samp("ic").alias("sd"), F.avg((F.col("ic") > 0).cast("double")).alias("hit"), *[F.avg(F.when(F.col("third") == i, F.col("ic"))).alias(f"mean_{i}") for i in (1, 2, 3)])
    gr = o.withColumn("grp", xsec.quantile_groups("s", by, "security_id")).where("grp IS NOT NULL")
    gm = gr.groupBy("factor_id", "grp").agg(F.avg("fwd").alias("m")).withColumn("k", F.rank().over(Window.partitionBy("factor_id").orderBy("m")))
    mono = gm.groupBy("factor_id").agg(F.corr("grp", "k").alias("monotonicity"), (F.max(F.when(F.col("grp") == 5, F.col("m"))) - F.max(F.when(F.col("grp") == 1, F.col("m")))).alias("long_short"))
    months = sessions(spark, at).groupBy(F.trunc("session_date", "month")).agg(F.max("session_no").cast("int").alias("session_no"))
    months = F.broadcast(months.select("session_no", F.lag("session_no").over(Window.partitionBy().orderBy("session_no")).alias("before")))
    top = gr.where("grp = 5").select(*by, "security_id")
    held = top.select("factor_id", F.col("session_no").alias("before"), "security_id", F.lit(1).alias("_b"))
    there = held.select("factor_id", "before").distinct()
    kept = top.join(months, "session_no").join(there, ["factor_id", "before"], "left_semi").join(held, ["factor_id", "before", "security_id"], "left")
    turnover = kept.groupBy("factor_id").agg((1 - F.count("_b") / F.count(F.lit(1))).alias("turnover"))
    before = rk.select("factor_id", F.col("session_no").alias("before"), "security_id", F.col("x").alias("_x"))
    auto = rk.join(months, "session_no").join(before, ["factor_id", "before", "security_id"]).groupBy(*by).agg(xsec.correlation(F.col("x"), F.col("_x")).alias("c")).groupBy("factor_id").agg(F.median("c").alias("autocorrelation"))
    out = hac.join(plain, "factor_id")
    for side in (mono, turnover, auto):
        out = out.join(side, "factor_id", "left")
    return out


@query(f"""WITH c AS (WITH {CONFIDENCE}), p AS (SELECT factor_id, t, exp(-0.717 * abs(t) - 0.416 * t * t) AS p FROM c WHERE t IS NOT NULL), k AS (SELECT *, row_number() OVER (ORDER BY round(p, 9), factor_id) AS r, count(*) OVER () AS m FROM p)
SELECT factor_id, round(p, 5) + 0.0 AS p, round(least(min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 1), 5) + 0.0 AS q FROM k""")
def a14_c04_false_discovery(spark, at):
    """Benjamini-Hochberg values over the factors' HAC p-values (two-sided normal tail, by its closed approximation exp(-0.717 |t| - 0.416 t²))."""
    t = F.round("t", 4)
    p = _confidence(spark, at).where("t IS NOT NULL").select("factor_id", F.exp(-0.717 * F.abs(t) - 0.416 * t * t).alias("p")).withColumn("_p", F.round("p", 9))
    k = Window.partitionBy().orderBy("_p", "factor_id")
    # a row per factor
    ranked = p.withColumns({"r": F.row_number().over(k), "m": F.count(F.lit(1)).over(Window.partitionBy())})
    down = Window.partitionBy().orderBy(F.col("r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.select("factor_id", (F.round("p", 5) + 0.0).alias("p"), (F.round(F.least(F.min(F.col("p") * F.col("m") / F.col("r")).over(down), F.lit(1.0)), 5) + 0.0).alias("q"))


@query(f"""WITH {PANEL_SQL}, b AS (SELECT session_no, right(security_id, 1) AS g, avg(close) AS c FROM bars WHERE close > 0 GROUP BY ALL), m AS (SELECT a.session_no, a.g, a.c / b.c AS q FROM b a JOIN b ON b.session_no = a.session_no AND b.g = '0' WHERE a.g <> '0'),
x AS (SELECT *, ln(1 + (q / lag(q, 5) OVER w - 1)) AS l5, ln(1 + (q / lag(q, 20) OVER w - 1)) AS l20 FROM m WINDOW w AS (PARTITION BY g ORDER BY session_no)), y AS (SELECT *, l20 AS sx, l5 - (l20 - l5) / 3 AS sy FROM x),
s AS (SELECT *, CASE WHEN sx > 0.005 THEN 'STRONG' WHEN sx < -0.005 THEN 'WEAK' WHEN sx IS NOT NULL THEN 'NEUTRAL' END AS raw, CASE WHEN sy > 0.002 THEN 'FASTER' WHEN sy < -0.002 THEN 'SLOWER' WHEN sy IS NOT NULL THEN 'STEADY' END AS speed FROM y),
f AS (SELECT *, CASE WHEN raw = lag(raw) OVER (PARTITION BY g ORDER BY session_no) THEN raw END AS sure FROM s)
SELECT session_no, g AS grp, {r('sx', 'strength')}, {r('sy', 'momentum')}, last_value(sure IGNORE NULLS) OVER (PARTITION BY g ORDER BY session_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state, speed FROM f""")
def w32_w33_strength_and_speed(spark, at):
    """Two axes of each basket against the base: the strength over twenty sessions, confirmed by two in a row, and the speed, five sessions against the rest, taken at once."""
    b = bars(spark, at, "close").where("close > 0").groupBy("session_no", F.right("security_id", F.lit(1)).alias("grp")).agg(F.avg("close").alias("c"))
    m = b.where("grp <> '0'").join(b.where("grp = '0'").select("session_no", F.col("c").alias("_b")), "session_no").withColumn("q", F.col("c") / F.col("_b"))
    w = Window.partitionBy("grp").orderBy("session_no")
    growth = lambda n: F.ln(1 + (F.col("q") / F.lag("q", n).over(w) - 1))
    # fixed values: dead bands 0.005 and 0.002
    y = m.withColumn("l5", growth(5)).withColumn("sx", growth(20)).withColumn("sy", F.col("l5") - (F.col("sx") - F.col("l5")) / 3)
    axis = lambda v, dead, up, down, flat: F.when(v > dead, up).when(v < -dead, down).when(v.isNotNull(), flat)
    s = y.withColumn("raw", axis(F.col("sx"), 0.005, "STRONG", "WEAK", "NEUTRAL")).withColumn("speed", axis(F.col("sy"), 0.002, "FASTER", "SLOWER", "STEADY"))
    sure = s.withColumn("sure", F.when(F.col("raw") == F.lag("raw").over(w), F.col("raw")))
    return sure.select("session_no", "grp", r6(F.col("sx")).alias("strength"), r6(F.col("sy")).alias("momentum"), F.last("sure", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("state"), "speed")
