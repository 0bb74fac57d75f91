"""Portfolios traded at the next open, double sorts, and the ledger of orders, fills, positions and marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import portfolio, xsec
from tidemark.operators import series as S
from tidemark.plans.base import PANEL_SQL, panel, r6, sessions
from tidemark.scale import broadcast_if_bounded
from tidemark.sources.tables import load

QUERIES, ORACLES = {}, {}
LAG = "OVER (PARTITION BY security_id ORDER BY session_no)"
STEP, COST, STALE = 20, 0.001, 5


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


_BASE = f"""{PANEL_SQL}, px AS (SELECT security_id, session_no, close, volume, CASE WHEN open > 0 AND close > 0 AND adj_close > 0 THEN open * adj_close / close END AS price FROM panel),
mk AS (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN {STALE} PRECEDING AND CURRENT ROW) AS mark FROM px),
mo AS (SELECT security_id, session_no, close / nullif(lag(close, 20) {LAG}, 0) - 1 AS mom, avg(close * volume) OVER (PARTITION BY security_id ORDER BY session_no ROWS 19 PRECEDING) AS size FROM panel),
sc AS (SELECT CAST(session_no / {STEP} - 1 AS INT) AS period, session_no AS decide, session_no + 1 AS trade, least(session_no + {STEP} + 1, (SELECT max(session_no) FROM trading_sessions)) AS until FROM trading_sessions WHERE session_no % {STEP} = 0 AND session_no > {STEP} AND session_no + 1 <= (SELECT max(session_no) FROM trading_sessions)),
ex AS (SELECT DISTINCT security_id, min(session_no) AS exit FROM (SELECT security_id, date FROM pit_membership WHERE upper(trim(snapshot_type)) = 'FORCED_EXIT' AND security_id IS NOT NULL) x JOIN trading_sessions ON session_date > x.date GROUP BY x.security_id, x.date)"""


def _simulation(targets: str) -> str:
    """SQL of the simulation over a table ``tg`` (grp, period, security_id, weight)."""
    return f"""{targets},
go AS (SELECT tg.*, sc.trade, sc.until, p.price AS paid, (SELECT min(exit) FROM ex WHERE ex.security_id = tg.security_id AND exit > sc.trade AND exit <= sc.until) AS exit FROM tg JOIN sc USING (period) LEFT JOIN mk p ON p.security_id = tg.security_id AND p.session_no = sc.trade),
pa AS (SELECT go.*, t.session_no, m.price, m.mark, weight * m.mark / paid AS value FROM go JOIN trading_sessions t ON t.session_no BETWEEN trade AND until LEFT JOIN mk m ON m.security_id = go.security_id AND m.session_no = least(t.session_no, coalesce(exit, t.session_no)) WHERE paid > 0),
su AS (SELECT grp, period, session_no, sum(value) AS v, sum(weight) AS w, count(*) AS members, count(*) FILTER (mark IS NULL) AS lost, count(*) FILTER (price IS NULL AND mark IS NOT NULL) AS stale, count(*) FILTER (exit <= session_no) AS exited, CASE WHEN count(*) FILTER (mark IS NULL) = 0 THEN sum(value) + 1 - sum(weight) END AS growth FROM pa GROUP BY ALL),
en AS (SELECT grp, period + 1 AS period, security_id, value / g AS d FROM (SELECT *, sum(value) OVER (PARTITION BY grp, period) + 1 - sum(weight) OVER (PARTITION BY grp, period) AS g FROM pa WHERE session_no = until) WHERE exit IS NULL OR exit > session_no),
bo AS (SELECT coalesce(a.grp, en.grp) AS grp, coalesce(a.period, en.period) AS period, coalesce(a.weight, 0) AS w, coalesce(d, 0) AS d FROM (SELECT * FROM go WHERE paid > 0) a FULL JOIN en ON en.grp = a.grp AND en.period = a.period AND en.security_id = a.security_id),
li AS (SELECT grp, period, list([w, d]) AS l, sum(w) AS w FROM bo GROUP BY ALL HAVING sum(w) > 0),
fx AS (SELECT *, list_reduce([1.0, 1, 2, 3, 4, 5, 6], lambda x, i: 1 - {COST} * list_sum(list_transform(l, lambda z: abs(x * z[1] - z[2])))) AS x FROM li),
tr AS (SELECT *, list_sum(list_transform(l, lambda z: abs(x * z[1] - z[2]))) AS traded FROM fx),
st AS (SELECT tr.*, product(coalesce(la.growth, 1) * x) OVER w AS s0, count(*) FILTER (la.grp IS NOT NULL AND la.growth IS NULL) OVER w AS broken FROM tr LEFT JOIN (SELECT su.grp, su.period + 1 AS period, growth FROM su JOIN sc ON sc.period = su.period AND sc.until = su.session_no) la ON la.grp = tr.grp AND la.period = tr.period WINDOW w AS (PARTITION BY tr.grp ORDER BY tr.period)),
nav AS (SELECT su.*, CASE WHEN broken = 0 THEN s0 END AS s0, x, traded, session_no = min(session_no) OVER (PARTITION BY su.grp, su.period) AS first FROM su JOIN st ON st.grp = su.grp AND st.period = su.period)"""


def _parts(spark: SparkSession, at: str):
    """Prices, momentum and size, the schedule and the forced exits that the portfolios share."""
    df = panel(spark, at, "open", "close", "adj_close", "volume")
    price = F.when((F.col("open") > 0) & (F.col("close") > 0) & (F.col("adj_close") > 0), F.col("open") * F.col("adj_close") / F.col("close"))
    prices = df.select("security_id", "session_no", price.alias("price"))
    signals = df.select("security_id", "session_no", S.change("close", 20).alias("mom"), F.avg(F.col("close") * F.col("volume")).over(S.frame(20)).alias("size"))
    calendar = sessions(spark, at).select(F.col("session_no").cast("int").alias("s"), "session_date")
    # one row
    end = F.broadcast(calendar.agg(F.max("s").alias("_end")))
    schedule = calendar.where(f"s % {STEP} = 0 AND s > {STEP}").join(end).where("s + 1 <= _end").select((F.col("s") / STEP - 1).cast("int").alias("period"), F.col("s").alias("decide"), (F.col("s") + 1).alias("trade"), F.least(F.col("s") + STEP + 1, "_end").alias("until"))
    from tidemark.plans.problems import session_of_days

    days = session_of_days(sessions(spark, at)).select(F.col("day").alias("date"), (F.col("session_no").cast("int") + 1).alias("exit"))
    left = load(spark, at, "pit_membership", "security_id", "date", "snapshot_type").where(F.upper(F.trim("snapshot_type")) == "FORCED_EXIT").dropna(subset=["security_id", "date"])
    exits = left.join(broadcast_if_bounded(days, load(spark, at, "trading_sessions")), "date").join(end).where("exit <= _end").select("security_id", "exit").distinct()
    return prices, signals, schedule, exits


_QUINTILES = f"""tg AS (SELECT grp, period, security_id, 1.0 / count(*) OVER (PARTITION BY grp, period) AS weight FROM (SELECT period, security_id, CAST(greatest(1, ceil((rn - 1) * 5.0 / greatest(n - 1, 1))) AS INT) AS grp
  FROM (SELECT sc.period, security_id, row_number() OVER (PARTITION BY session_no ORDER BY mom, security_id) AS rn, count(*) OVER (PARTITION BY session_no) AS n FROM mo JOIN sc ON sc.decide = session_no WHERE mom IS NOT NULL) WHERE n >= 5))"""


def _quintiles(signals: DataFrame, schedule: DataFrame) -> DataFrame:
    chosen = signals.where("mom IS NOT NULL").join(F.broadcast(schedule.select("period", F.col("decide").alias("session_no"))), "session_no")
    chosen = chosen.withColumn("grp", xsec.quantile_groups("mom", ["session_no"], "security_id")).where("grp IS NOT NULL")
    return chosen.select("grp", "period", "security_id", (1 / F.count(F.lit(1)).over(Window.partitionBy("grp", "period"))).alias("weight"))


@query(f"WITH {_BASE}, {_simulation(_QUINTILES)} SELECT grp, period, CAST(session_no AS INT) AS session_no, members, {r('1 - w', 'cash')}, exited, stale, {r('CASE WHEN first THEN traded END', 'traded')}, {r('CASE WHEN first THEN s0 / x * (1 - x) END', 'cost')}, {r('s0 * growth', 'nav')} FROM nav")
def l01_l02_l04_l05_portfolio(spark, at):
    """Quintiles bought at the open after the decision: cash for what can't be bought, costs out of the nav, forced exits, no nav where a held price is lost."""
    prices, signals, schedule, exits = _parts(spark, at)
    nav = portfolio.simulate_at_open(_quintiles(signals, schedule), prices, schedule.drop("decide"), exits, COST, STALE)
    return nav.select("grp", "period", "session_no", "members", r6(F.col("cash")).alias("cash"), "exited", "stale", *[r6(F.col(c)).alias(c) for c in ("traded", "cost", "nav")])


_CELLS = """tg AS (SELECT c * 10 + f AS grp, period, security_id, 1.0 / count(*) OVER (PARTITION BY c, f, period) AS weight FROM (SELECT sc.period, security_id, ntile(3) OVER (PARTITION BY session_no ORDER BY size, security_id) AS c, ntile(3) OVER (PARTITION BY session_no ORDER BY mom, security_id) AS f
  FROM mo JOIN sc ON sc.decide = session_no WHERE mom IS NOT NULL AND size IS NOT NULL))"""


@query(f"""WITH {_BASE}, {_simulation(_CELLS)}, g AS (SELECT grp // 10 AS c, grp % 10 AS f, session_no, period, growth, x FROM nav)
SELECT period, CAST(session_no AS INT) AS session_no, CAST(count(*) AS INT) AS cells, round(CASE WHEN count(*) = 9 AND count(growth) = 9 THEN sum(CASE f WHEN 3 THEN growth WHEN 1 THEN -growth ELSE 0 END) / 3 END, 6) + 0.0 AS high_less_low FROM g GROUP BY ALL""")
def l06_double_sort(spark, at):
    """Three by three cells of size and momentum as portfolios: the growth of the high less the low ones, over the size buckets; only where all cells have one."""
    prices, signals, schedule, exits = _parts(spark, at)
    chosen = signals.where("mom IS NOT NULL AND size IS NOT NULL").join(F.broadcast(schedule.select("period", F.col("decide").alias("session_no"))), "session_no")
    w = Window.partitionBy("session_no")
    cells = chosen.select("period", "security_id", (F.ntile(3).over(w.orderBy("size", "security_id")) * 10 + F.ntile(3).over(w.orderBy("mom", "security_id"))).alias("grp"))
    cells = cells.select("grp", "period", "security_id", (1 / F.count(F.lit(1)).over(Window.partitionBy("grp", "period"))).alias("weight"))
    nav = portfolio.simulate_at_open(cells, prices, schedule.drop("decide"), exits, COST, STALE)
    side = F.when(F.col("grp") % 10 == 3, F.col("growth")).when(F.col("grp") % 10 == 1, -F.col("growth")).otherwise(0.0)
    out = nav.groupBy("period", "session_no").agg(F.count(F.lit(1)).cast("int").alias("cells"), F.count("growth").alias("_n"), F.sum(side).alias("_s"))
    return out.select("period", "session_no", "cells", r6(F.when((F.col("cells") == 9) & (F.col("_n") == 9), F.col("_s") / 3)).alias("high_less_low"))


_TRADES = """t AS (SELECT o_custkey AS account, l_partkey % 50 AS instrument, o_orderdate AS d, l_orderkey AS k, l_linenumber AS n, CAST(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 0),
g AS (SELECT account, instrument, list({'q': q, 'p': p} ORDER BY d, k, n, q, p) AS l FROM t GROUP BY ALL),
z AS (SELECT account, instrument, list_reduce(list_prepend({'q': 0.0, 'c': 0.0, 'r': 0.0, 'x': 0.0}, list_transform(l, lambda y: {'q': y.q, 'c': y.p, 'r': 0.0, 'x': 0.0})),
  lambda s, y: CASE WHEN y.q > 0 THEN {'q': s.q + y.q, 'c': (s.q * s.c + y.q * y.c) / (s.q + y.q), 'r': s.r, 'x': s.x} WHEN s.q + y.q >= 0 THEN {'q': s.q + y.q, 'c': CASE WHEN s.q + y.q = 0 THEN 0.0 ELSE s.c END, 'r': s.r - y.q * (y.c - s.c), 'x': s.x} ELSE {'q': s.q, 'c': s.c, 'r': s.r, 'x': s.x + 1} END) AS e FROM g)"""


def _trades(spark: SparkSession, at: str) -> DataFrame:
    lines = load(spark, at, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag").where("l_quantity > 0")
    t = lines.join(load(spark, at, "orders", "o_orderkey", "o_custkey", "o_orderdate"), F.col("o_orderkey") == F.col("l_orderkey"))
    quantity = F.col("l_quantity").cast("double")
    return t.select(F.col("o_custkey").alias("account"), (F.col("l_partkey") % 50).alias("instrument"), F.col("o_orderdate").alias("d"), "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", -quantity).otherwise(quantity).alias("q"), (F.col("l_extendedprice").cast("double") / quantity).alias("p"))


@query(f"WITH {_TRADES} SELECT account, instrument, e.q AS quantity, round(e.c, 9) + 0.0 AS average_cost, round(e.r, 6) + 0.0 AS realised, CAST(e.x AS INT) AS refused FROM z")
def l13_ledger_positions(spark, at):
    """Positions by replay of the fills: average cost on buys, realised gain on sells; a sell of more than is held is refused.

    The rule is sequential; the fills of one account and instrument are one sorted array that is folded once.
    """
    t = _trades(spark, at).groupBy("account", "instrument").agg(F.array_sort(F.collect_list(F.struct("d", "l_orderkey", "l_linenumber", "q", "p"))).alias("l"))
    zero = F.lit(0.0)
    state = lambda q, c, g, x: F.struct(q.alias("q"), c.alias("c"), g.alias("r"), x.alias("x"))

    def step(s, y):
        left = s["q"] + y["q"]
        bought = state(left, (s["q"] * s["c"] + y["q"] * y["p"]) / left, s["r"], s["x"])
        sold = state(left, F.when(left == 0, zero).otherwise(s["c"]), s["r"] - y["q"] * (y["p"] - s["c"]), s["x"])
        return F.when(y["q"] > 0, bought).when(left >= 0, sold).otherwise(state(s["q"], s["c"], s["r"], s["x"] + 1))

    e = t.select("account", "instrument", F.aggregate("l", state(zero, zero, zero, zero), step).alias("e"))
    return e.select("account", "instrument", F.col("e.q").alias("quantity"), (F.round("e.c", 9) + 0.0).alias("average_cost"), (F.round("e.r", 6) + 0.0).alias("realised"), F.col("e.x").cast("int").alias("refused"))


@query(f"""WITH {_TRADES}, p AS (SELECT instrument, arg_max(p, (d, k, n, p)) AS last FROM t WHERE d <= DATE '1998-01-01' GROUP BY 1), h AS (SELECT account, instrument, sum(q) AS q, sum(-q * p) AS paid FROM t WHERE d <= DATE '1998-01-01' GROUP BY ALL)
SELECT account, count(*) AS positions, count(*) FILTER (q <> 0 AND last IS NULL) AS unpriced, round(sum(paid), 2) + 0.0 AS cash, round(CASE WHEN count(*) FILTER (q <> 0 AND last IS NULL) = 0 THEN sum(paid) + sum(q * last) END, 2) + 0.0 AS equity FROM h LEFT JOIN p USING (instrument) GROUP BY 1""")
def l17_mark_to_market(spark, at):
    """Cash and equity of each account at a day: quantity times the last price at or before it; without a price of a held instrument there is no equity."""
    t = _trades(spark, at).where("d <= DATE '1998-01-01'")
    p = t.groupBy("instrument").agg(F.max_by("p", F.struct("d", "l_orderkey", "l_linenumber", "p")).alias("last"))
    h = t.groupBy("account", "instrument").agg(F.sum("q").alias("q"), F.sum(-F.col("q") * F.col("p")).alias("paid"))
    unpriced = F.count_if((F.col("q") != 0) & F.col("last").isNull())
    g = h.join(p, "instrument", "left").groupBy("account").agg(F.count(F.lit(1)).alias("positions"), unpriced.alias("unpriced"), F.sum("paid").alias("c"), F.sum(F.col("q") * F.col("last")).alias("v"))
    return g.select("account", "positions", "unpriced", (F.round("c", 2) + 0.0).alias("cash"), (F.round(F.when(F.col("unpriced") == 0, F.col("c") + F.col("v")), 2) + 0.0).alias("equity"))


_ORDERS = f"""WITH {PANEL_SQL}, f AS (SELECT security_id, session_no, close, close / nullif(lag(close, 20) {LAG}, 0) - 1 AS mom FROM panel), s AS (SELECT session_no AS s, session_no - {STEP} AS b FROM trading_sessions WHERE session_no % {STEP} = 0 AND session_no > {STEP}),
k AS (SELECT session_no, security_id, close, row_number() OVER (PARTITION BY session_no ORDER BY mom DESC, security_id) AS r FROM f WHERE mom IS NOT NULL AND close > 0 AND session_no % {STEP} = 0), t AS (SELECT * FROM k WHERE r <= 10),
h AS (SELECT s.s AS session_no, t.security_id, floor(10000 / t.close) AS held FROM s JOIN t ON t.session_no = s.b),
o AS (SELECT s.s AS session_no, x.security_id, coalesce(h.held, 0) AS held, CASE WHEN t.security_id IS NOT NULL THEN floor(10000 / t.close) ELSE 0 END AS goal, p.close AS price, coalesce(t.r, 99) AS r FROM s JOIN (SELECT session_no, security_id FROM t UNION SELECT session_no, security_id FROM h) x ON x.session_no = s.s
  LEFT JOIN t ON t.session_no = s.s AND t.security_id = x.security_id LEFT JOIN h ON h.session_no = s.s AND h.security_id = x.security_id LEFT JOIN panel p ON p.session_no = s.s AND p.security_id = x.security_id),
c AS (SELECT *, goal - held AS want, 5000 + coalesce(sum(CASE WHEN goal < held AND price > 0 THEN (held - goal) * price END) OVER (PARTITION BY session_no), 0) AS cash FROM o),
b AS (SELECT *, coalesce(sum(CASE WHEN want > 0 THEN want * price END) OVER (PARTITION BY session_no ORDER BY r, security_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM c)
SELECT session_no, security_id, want AS ordered, CASE WHEN want = 0 OR price IS NULL OR price <= 0 THEN 0 WHEN want < 0 THEN want ELSE greatest(least(want, floor((cash - spent) / price)), 0) END AS filled FROM b"""


@query(_ORDERS)
def l14_l15_orders_within_cash(spark, at):
    """Orders from what is held to the target quantities; sells first, then buys by rank within the cash, the last one in part. What has no price isn't filled."""
    df = panel(spark, at, "close").withColumn("mom", S.change("close", 20)).where(f"session_no % {STEP} = 0")
    rank = F.row_number().over(Window.partitionBy("session_no").orderBy(F.col("mom").desc(), "security_id"))
    t = df.where("mom IS NOT NULL AND close > 0").withColumn("r", rank).where("r <= 10").select("session_no", "security_id", "r", F.floor(10000 / F.col("close")).alias("goal"))
    decided = sessions(spark, at).where(f"session_no % {STEP} = 0 AND session_no > {STEP}").select(F.col("session_no").cast("int").alias("session_no"))
    h = t.select((F.col("session_no") + STEP).alias("session_no"), "security_id", F.col("goal").alias("held"))
    o = t.join(h, ["session_no", "security_id"], "full_outer").join(F.broadcast(decided), "session_no", "left_semi")
    o = o.join(df.select("session_no", "security_id", F.col("close").alias("price")), ["session_no", "security_id"], "left").fillna(0, ["goal", "held"]).fillna(99, ["r"]).withColumn("want", F.col("goal") - F.col("held"))
    day = Window.partitionBy("session_no")
    sold = F.sum(F.when((F.col("want") < 0) & (F.col("price") > 0), -F.col("want") * F.col("price"))).over(day)
    spent = F.sum(F.when(F.col("want") > 0, F.col("want") * F.col("price"))).over(day.orderBy("r", "security_id").rowsBetween(Window.unboundedPreceding, -1))
    b = o.withColumns({"cash": 5000 + F.coalesce(sold, F.lit(0.0)), "spent": F.coalesce(spent, F.lit(0.0))})
    filled = F.when((F.col("want") == 0) | F.col("price").isNull() | (F.col("price") <= 0), 0).when(F.col("want") < 0, F.col("want")).otherwise(F.greatest(F.least("want", F.floor((F.col("cash") - F.col("spent")) / F.col("price"))), F.lit(0)))
    return b.select("session_no", "security_id", F.col("want").cast("double").alias("ordered"), filled.cast("double").alias("filled"))


@query(f"""WITH {PANEL_SQL}, f AS (SELECT security_id, session_no, close, close / nullif(lag(close, 20) {LAG}, 0) - 1 AS mom, lead(open) {LAG} AS open1, lead(volume) {LAG} AS vol1 FROM panel),
o AS (SELECT *, CASE WHEN mom > 0 THEN 1 ELSE -1 END AS side, floor(50000 / close) AS quantity FROM f WHERE session_no % {STEP} = 0 AND mom IS NOT NULL AND close > 0),
x AS (SELECT *, CASE WHEN open1 > 0 THEN least(quantity, greatest(floor(coalesce(vol1, 0) * 0.025), 0)) ELSE 0 END AS filled, 2.0 + 0.1 * power(least(coalesce(quantity / nullif(vol1, 0), 0.025), 0.025), 2) * 10000 AS bps FROM o), p AS (SELECT *, CASE WHEN filled > 0 THEN open1 * (1 + side * bps / 10000) END AS price FROM x)
SELECT security_id, session_no, side, quantity, filled, CASE WHEN filled = 0 THEN 'NONE' WHEN filled < quantity THEN 'PARTIAL' ELSE 'FULL' END AS state, quantity > coalesce(vol1, 0) * 0.025 AS breach, round(bps, 5) + 0.0 AS slippage_bps, {r('price', 'price')}, round(CASE WHEN filled > 0 THEN least(greatest(filled * 0.005, 1), filled * price * 0.01) END, 5) + 0.0 AS per_share_fee, round(CASE WHEN filled > 0 THEN filled * price * 0.0005 END, 5) + 0.0 AS value_fee FROM p""")
def l03_l09_l10_executions(spark, at):
    """Order rows executed at the next open: the quantity its volume allows, slippage on the side's price, two forms of fees, and whether the order breaks the limit."""
    w = S.by_security()
    f = panel(spark, at, "open", "close", "volume").withColumns({"mom": S.change("close", 20), "open1": F.lead("open").over(w), "vol1": F.lead("volume").over(w)})
    o = f.where(f"session_no % {STEP} = 0 AND mom IS NOT NULL AND close > 0").withColumns({"side": F.when(F.col("mom") > 0, 1).otherwise(-1), "quantity": F.floor(50000 / F.col("close")).cast("double")})
    x = o.withColumns({"filled": F.when(F.col("open1") > 0, portfolio.fillable(F.col("quantity"), F.col("vol1"))).otherwise(0.0), "bps": portfolio.slippage_bps(F.col("quantity"), F.col("vol1"))})
    some = F.col("filled") > 0
    p = x.withColumn("price", F.when(some, F.col("open1") * (1 + F.col("side") * F.col("bps") / 10000)))
    state = F.when(F.col("filled") == 0, "NONE").when(F.col("filled") < F.col("quantity"), "PARTIAL").otherwise("FULL")
    fee = F.when(some, portfolio.commission(F.col("filled"), F.col("price")))
    return p.select("security_id", "session_no", "side", "quantity", "filled", state.alias("state"), (F.col("quantity") > F.coalesce("vol1", F.lit(0.0)) * 0.025).alias("breach"), (F.round("bps", 5) + 0.0).alias("slippage_bps"), r6(F.col("price")).alias("price"), (F.round(fee, 5) + 0.0).alias("per_share_fee"), (F.round(F.when(some, F.col("filled") * F.col("price") * 0.0005), 5) + 0.0).alias("value_fee"))
