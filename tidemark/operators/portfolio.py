"""Group portfolios as a relational plan: target weights at each trade, drift in between, costs on the turnover.

Between two trades, a portfolio's value is the weighted mean of its members' growth, so its path needs no
state. Periods are chained by a product. No group is replayed in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slippage_bps(quantity: Column, volume: Column, spread: float = 2.0, impact: float = 0.1, limit: float = 0.025) -> Column:
    """Half spread 2, impact 0.1, limit 0.025. Half spread and an impact that grows with the square of the share of volume, up to ``limit``; without volume, at the limit."""
    part = F.coalesce(F.abs(quantity) / F.nullif(volume, F.lit(0.0)), F.lit(limit))
    taken = F.least(part, F.lit(limit))
    return spread + impact * taken * taken * 10_000


def commission(quantity: Column, price: Column, per_share: float = 0.005, least: float = 1.0, most: float = 0.01) -> Column:
    """Per share, at least ``least``, at most a share ``most`` of the value."""
    return F.least(F.greatest(F.abs(quantity) * per_share, F.lit(least)), F.abs(quantity) * price * most)


def fillable(quantity: Column, volume: Column, limit: float = 0.025) -> Column:
    """The whole quantity that a share of the volume allows; 0 without volume."""
    return F.greatest(F.least(F.abs(quantity), F.floor(F.coalesce(volume, F.lit(0.0)) * limit)), F.lit(0)) * F.signum(quantity)


def affordable(cash: Column, price: Column, per_share: float = 0.005) -> Column:
    """The most whole units that cash buys at a price with a cost per unit: in closed form, as the cost is linear."""
    return F.greatest(F.floor(cash / F.nullif(price + per_share, F.lit(0.0))), F.lit(0))


def simulate_at_open(targets: DataFrame, prices: DataFrame, schedule: DataFrame, exits: DataFrame, cost: float, stale: int = 5, iterations: int = 6) -> DataFrame:
    """(grp, period, session_no, members, cash, exited, stale, traded, cost, growth, nav) of portfolios traded at the open after each decision.

    ``targets``: (grp, period, security_id, weight); ``prices``: (security_id, session_no, price), the opens on
    a dense axis, NULL where there is none; ``schedule``: (period, trade, until), the session at whose open a
    period is bought and the one at whose open it ends, a row per period; ``exits``: (security_id, exit), the
    sessions at whose open a security must be sold. A name without a price at its trade isn't bought: its
    weight stays cash. A held name without a price is marked at its last one, at most ``stale`` sessions
    old; beyond that the nav is NULL from there on, as nothing true can be said. A forced exit turns into
    cash until the next trade.

    All values of a period are shares of the nav at its trade, so no group is replayed in one task. Costs
    reserve their own cash: the nav after a trade is the fixed point of ``x = 1 - cost * sum |x w - d|`` with
    the target weights ``w`` and the shares ``d`` held before; a few steps suffice, as each shrinks the error by
    ``cost``. Nav before a trade is nav after it plus the cost.
    """
    whole, names = Window.partitionBy("grp", "period"), ["grp", "period", "security_id"]
    known = F.last("price", True).over(Window.partitionBy("security_id").orderBy("session_no").rowsBetween(-stale, 0))
    marks = prices.withColumn("mark", known).select("security_id", "session_no", "price", "mark")
    # a row per period
    plan = F.broadcast(schedule)
    entry = marks.select("security_id", F.col("session_no").alias("trade"), F.col("price").alias("paid"))
    goal = targets.join(plan, "period").join(entry, ["security_id", "trade"], "left")
    goal = goal.join(exits.groupBy("security_id").agg(F.array_sort(F.collect_set("exit")).alias("_exits")), "security_id", "left")
    # at most one exit counts: the first one after the trade
    goal = goal.withColumn("exit", F.array_min(F.filter("_exits", lambda x: (x > F.col("trade")) & (x <= F.col("until"))))).drop("_exits")
    held = goal.where("paid > 0").select(*names, "weight", "paid", "exit", F.explode(F.sequence("trade", "until")).alias("session_no"), "until")
    held = held.withColumn("at", F.least("session_no", F.coalesce("exit", "session_no")))
    path = held.join(marks.select("security_id", F.col("session_no").alias("at"), "price", "mark"), ["security_id", "at"], "left").withColumn("value", F.col("weight") * F.col("mark") / F.col("paid"))
    sums = path.groupBy("grp", "period", "session_no").agg(
        F.sum("value").alias("_v"), F.sum("weight").alias("_w"), F.count(F.lit(1)).alias("members"), F.count_if(F.col("mark").isNull()).alias("_lost"), F.count_if(F.col("price").isNull() & F.col("mark").isNotNull()).alias("stale"), F.count_if(F.col("exit") <= F.col("session_no")).alias("exited")
    )
    sums = sums.withColumn("growth", F.when(F.col("_lost") == 0, F.col("_v") + 1 - F.col("_w"))).withColumn("cash", 1 - F.col("_w"))
    ends = path.where("session_no = until").withColumn("_g", F.sum("value").over(whole) + 1 - F.sum("weight").over(whole)).where("exit IS NULL OR exit > session_no")
    ends = ends.select("grp", (F.col("period") + 1).alias("period"), "security_id", (F.col("value") / F.col("_g")).alias("d"))
    both = goal.where("paid > 0").select(*names, F.col("weight").alias("w")).join(ends, names, "full_outer").fillna(0.0, ["w", "d"])
    both = both.withColumn("_x", F.lit(1.0))
    for _ in range(iterations):
        both = both.withColumn("_x", 1 - cost * F.sum(F.abs(F.col("_x") * F.col("w") - F.col("d"))).over(whole))
    trades = both.groupBy("grp", "period").agg(F.max("_x").alias("x"), F.sum(F.abs(F.col("_x") * F.col("w") - F.col("d"))).alias("traded"), F.sum("w").alias("_w")).where("_w > 0")
    last = sums.join(F.broadcast(schedule.select("period", F.col("until").alias("session_no"))), ["period", "session_no"]).select("grp", (F.col("period") + 1).alias("period"), F.col("growth").alias("_end"), F.lit(True).alias("_had"))
    steps = trades.join(last, ["grp", "period"], "left")
    chain = Window.partitionBy("grp").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    broken = F.count_if(F.coalesce("_had", F.lit(False)) & F.col("_end").isNull()).over(chain) > 0
    start = F.when(~broken, F.product(F.coalesce("_end", F.lit(1.0)) * F.col("x")).over(chain))
    starts = steps.select("grp", "period", "x", "traded", start.alias("_start"))
    first = F.col("session_no") == F.min("session_no").over(whole)
    out = sums.join(starts, ["grp", "period"])
    return out.select(
        "grp", "period", "session_no", "members", "cash", "exited", "stale", F.when(first, F.col("traded")).alias("traded"), F.when(first, F.col("_start") / F.col("x") * (1 - F.col("x"))).alias("cost"), "growth", (F.col("_start") * F.col("growth")).alias("nav")
    )
