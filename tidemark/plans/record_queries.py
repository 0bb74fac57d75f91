"""Ledgers of membership changes, checks between sets, identity and history rules, audits and outcomes of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.plans.aggregate_queries import IC, _ic
from tidemark.plans.base import BARS_SQL, PANEL_SQL, bars, panel, r6, sessions
from tidemark.plans.join_queries import MEMBERS, H, begin_inside, history, members
from tidemark.plans.problems import COMPLETE, session_of_days
from tidemark.scale import broadcast_if_bounded, finite, scratch_dir
from tidemark.sources.tables import load
from tidemark.sources.versions import VersionedTable

QUERIES, ORACLES = {}, {}
LAG = "OVER (PARTITION BY security_id ORDER BY session_no)"


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


LEDGER = """m0 AS (SELECT date, security_id, max_by(coalesce(active, false), (knowledge_date, coalesce(active, false))) AS active FROM pit_membership WHERE coalesce(upper(trim(snapshot_type)), '') IN ('MONTH_END', 'FORCED_EXIT_CARRY_FORWARD', '') AND date IS NOT NULL AND security_id IS NOT NULL AND knowledge_date IS NOT NULL GROUP BY ALL),
sn AS (SELECT date, lag(date) OVER (ORDER BY date) AS before, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM m0)), mem AS (SELECT date, security_id FROM m0 WHERE active),
led AS (SELECT sn.date, sn.i, m.security_id, 'ADD' AS what FROM mem m JOIN sn ON sn.date = m.date WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM mem p WHERE p.date = sn.before AND p.security_id = m.security_id)
  UNION ALL SELECT sn.date, sn.i, p.security_id, 'REMOVE' FROM mem p JOIN sn ON sn.before = p.date WHERE NOT EXISTS (SELECT 1 FROM mem m WHERE m.date = sn.date AND m.security_id = p.security_id))"""


def _snapshots(spark: SparkSession, at: str) -> tuple[DataFrame, DataFrame]:
    """(date, security_id) of the members of each complete snapshot by its latest delivery, and (date, before, i) of the snapshots in order."""
    kind = F.coalesce(F.upper(F.trim("snapshot_type")), F.lit(""))
    m = load(spark, at, "pit_membership", "date", "security_id", "active", "snapshot_type", "knowledge_date").where(kind.isin(*COMPLETE)).dropna(subset=["date", "security_id", "knowledge_date"])
    state = m.groupBy("date", "security_id").agg(F.max(F.struct("knowledge_date", F.coalesce("active", F.lit(False)).alias("a"))).alias("s"))
    # a row per snapshot, at most one per day
    order = Window.partitionBy().orderBy("date")
    snaps = m.select("date").distinct().select("date", F.lag("date").over(order).alias("before"), F.row_number().over(order).alias("i"))
    return state.where("s.a").select("date", "security_id"), snaps


def ledger(spark: SparkSession, at: str) -> DataFrame:
    """(date, i, security_id, what): additions and removals between consecutive snapshots, from one full outer join."""
    mem, snaps = _snapshots(spark, at)
    snaps = broadcast_if_bounded(snaps)
    now = mem.join(snaps, "date").where("before IS NOT NULL").select("date", "i", "security_id", F.lit(True).alias("_now"))
    past = mem.withColumnRenamed("date", "before").join(snaps, "before").select("date", "i", "security_id", F.lit(True).alias("_past"))
    both = now.join(past, ["date", "i", "security_id"], "full_outer").where("_now IS NULL OR _past IS NULL")
    return both.select("date", "i", "security_id", F.when(F.col("_now"), "ADD").otherwise("REMOVE").alias("what"))


@query(f"""WITH {LEDGER}, k AS (SELECT *, row_number() OVER (PARTITION BY date, what ORDER BY security_id) AS k FROM led), a AS (SELECT * FROM k WHERE what = 'ADD'), x AS (SELECT * FROM k WHERE what = 'REMOVE'), p AS (SELECT coalesce(a.date, x.date) AS date, coalesce(a.k, x.k) AS k, a.security_id AS added, x.security_id AS removed FROM a FULL JOIN x ON a.date = x.date AND a.k = x.k)
SELECT strftime(date, '%Y-%m-%d') AS day, k, added, removed, CASE WHEN added IS NOT NULL AND removed IS NOT NULL THEN 'PAIRED' ELSE 'INCOMPLETE' END AS quality, CASE WHEN added IS NULL THEN 'NO_ADDITION' WHEN removed IS NULL THEN 'NO_REMOVAL' ELSE '' END AS reasons FROM p""")
def s06_u09_event_ledger(spark, at):
    """The ledger of membership events: additions paired with removals of the same day in order, with the quality of each pair."""
    k = ledger(spark, at).withColumn("k", F.row_number().over(Window.partitionBy("date", "what").orderBy("security_id")))
    p = k.groupBy("date", "k").agg(F.max(F.when(F.col("what") == "ADD", F.col("security_id"))).alias("added"), F.max(F.when(F.col("what") == "REMOVE", F.col("security_id"))).alias("removed"))
    whole = F.col("added").isNotNull() & F.col("removed").isNotNull()
    return p.select(day("date").alias("day"), "k", "added", "removed", F.when(whole, "PAIRED").otherwise("INCOMPLETE").alias("quality"), F.when(F.col("added").isNull(), "NO_ADDITION").when(F.col("removed").isNull(), "NO_REMOVAL").otherwise("").alias("reasons"))


@query(f"""WITH {LEDGER}, ids AS (SELECT security_id FROM led UNION SELECT security_id FROM mem WHERE date = (SELECT max(date) FROM sn)), g AS (SELECT ids.security_id, sn.date, sn.i FROM ids CROSS JOIN sn),
e AS (SELECT g.*, led.what, first_value(led.what IGNORE NULLS) OVER (PARTITION BY g.security_id ORDER BY g.i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following, f.security_id IS NOT NULL AS final FROM g LEFT JOIN led ON led.security_id = g.security_id AND led.i = g.i LEFT JOIN (SELECT security_id FROM mem WHERE date = (SELECT max(date) FROM sn)) f ON f.security_id = g.security_id),
s AS (SELECT date, i, security_id FROM e WHERE CASE following WHEN 'ADD' THEN false WHEN 'REMOVE' THEN true ELSE final END)
SELECT strftime(sn.date, '%Y-%m-%d') AS day, count(s.security_id) AS replayed, count(m.security_id) AS delivered, count(s.security_id) = count(m.security_id) AND count(*) FILTER (s.security_id IS NULL OR m.security_id IS NULL) = 0 AS agrees
FROM sn JOIN (s FULL JOIN (SELECT * FROM mem) m ON m.date = s.date AND m.security_id = s.security_id) ON sn.date = coalesce(s.date, m.date) GROUP BY sn.date""")
def u06_u07_u08_reverse_replay(spark, at):
    """Members of every snapshot by walking the events backward from the last one, checked against the delivered snapshots.

    The state before an event is the reverse of it: a security is a member where its next event removes it,
    and where it has no further event and is in the last snapshot.
    """
    mem, snaps = _snapshots(spark, at)
    events = ledger(spark, at).select("security_id", "i", "what")
    # one row
    top = F.broadcast(snaps.agg(F.max("i").alias("_top"), F.max("date").alias("date")))
    final = mem.join(top, "date").select("security_id", F.lit(True).alias("final"))
    ids = events.select("security_id").union(final.select("security_id")).distinct().join(final, "security_id", "left")
    grid = ids.join(top.select("_top")).select("security_id", "final", F.explode(F.sequence(F.lit(1), F.col("_top"))).alias("i"))
    ahead = Window.partitionBy("security_id").orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    e = grid.join(events, ["security_id", "i"], "left").withColumn("following", F.first("what", True).over(ahead))
    member = F.when(F.col("following") == "ADD", False).when(F.col("following") == "REMOVE", True).otherwise(F.coalesce("final", F.lit(False)))
    s = e.where(member).join(broadcast_if_bounded(snaps.select("i", "date")), "i").select("date", "security_id", F.lit(1).alias("_s"))
    both = s.join(mem.withColumn("_m", F.lit(1)), ["date", "security_id"], "full_outer")
    out = both.groupBy("date").agg(F.count("_s").alias("replayed"), F.count("_m").alias("delivered"), F.count_if(F.col("_s").isNull() | F.col("_m").isNull()).alias("_d"))
    return out.select(day("date").alias("day"), "replayed", "delivered", (F.col("_d") == 0).alias("agrees"))


@query(f"""WITH {LEDGER} SELECT strftime(date, '%Y-%m-%d') AS day, security_id, what FROM led WHERE date = (SELECT max(date) FROM sn)""")
def c15_last_changes(spark, at):
    """Additions and removals between the last two snapshots."""
    _, snaps = _snapshots(spark, at)
    return ledger(spark, at).join(F.broadcast(snaps.agg(F.max("date").alias("date"))), "date", "left_semi").select(day("date").alias("day"), "security_id", "what")


@query(f"""WITH {LEDGER}, x AS (SELECT DISTINCT sn.date, p.security_id FROM pit_membership p JOIN sn ON p.date > sn.before AND p.date <= sn.date WHERE upper(trim(p.snapshot_type)) = 'FORCED_EXIT' AND p.security_id IS NOT NULL), o AS (SELECT date, security_id FROM led WHERE what = 'REMOVE')
SELECT strftime(coalesce(o.date, x.date), '%Y-%m-%d') AS day, count(o.security_id) AS removed, count(x.security_id) AS announced, count(*) FILTER (x.security_id IS NULL) AS unannounced, count(*) FILTER (o.security_id IS NULL) AS unfulfilled, count(*) FILTER (x.security_id IS NULL OR o.security_id IS NULL) = 0 AS verified FROM o FULL JOIN x ON x.date = o.date AND x.security_id = o.security_id GROUP BY 1""")
def g24_event_groups(spark, at):
    """Groups of announced exits against the removals observed between two snapshots: the sets must be equal."""
    _, snaps = _snapshots(spark, at)
    left = load(spark, at, "pit_membership", "date", "security_id", "snapshot_type").where(F.upper(F.trim("snapshot_type")) == "FORCED_EXIT").dropna(subset=["date", "security_id"]).select("date", "security_id").distinct()
    # a snapshot's days, so that exits meet it by equality
    days = broadcast_if_bounded(snaps.where("before IS NOT NULL").select(F.col("date").alias("snap"), F.explode(F.sequence(F.date_add("before", 1), "date")).alias("date")))
    x = left.join(days, "date").select(F.col("snap").alias("date"), "security_id").distinct().withColumn("_x", F.lit(1))
    both = ledger(spark, at).where("what = 'REMOVE'").select("date", "security_id", F.lit(1).alias("_o")).join(x, ["date", "security_id"], "full_outer")
    g = both.groupBy(day("date").alias("day")).agg(F.count("_o").alias("removed"), F.count("_x").alias("announced"), F.count_if(F.col("_x").isNull()).alias("unannounced"), F.count_if(F.col("_o").isNull()).alias("unfulfilled"))
    return g.withColumn("verified", (F.col("unannounced") + F.col("unfulfilled")) == 0)


@query(f"""WITH {LEDGER}, o AS (SELECT security_id FROM mem WHERE date = (SELECT max(date) FROM sn)), v AS (SELECT security_id FROM (SELECT security_id, max_by(upper(trim(trading_status)), (updated_at, upper(trim(trading_status)))) AS s FROM security_master_snapshots WHERE updated_at IS NOT NULL AND security_id IS NOT NULL GROUP BY 1) WHERE s = 'ACTIVE')
SELECT security_id, 'ONLY_MEMBERS' AS side FROM (SELECT * FROM o EXCEPT SELECT * FROM v) UNION ALL SELECT security_id, 'ONLY_MASTER' FROM (SELECT * FROM v EXCEPT SELECT * FROM o)""")
def g25_constituents(spark, at):
    """Members of the last snapshot against the active securities of the master: what only one of them has."""
    mem, snaps = _snapshots(spark, at)
    o = mem.join(F.broadcast(snaps.agg(F.max("date").alias("date"))), "date", "left_semi").select("security_id")
    s = load(spark, at, "security_master_snapshots", "security_id", "trading_status", "updated_at").dropna(subset=["security_id", "updated_at"]).withColumn("s", F.upper(F.trim("trading_status")))
    v = s.groupBy("security_id").agg(F.max(F.struct("updated_at", "s")).alias("l")).where("l.s = 'ACTIVE'").select("security_id")
    return o.exceptAll(v).withColumn("side", F.lit("ONLY_MEMBERS")).unionByName(v.exceptAll(o).withColumn("side", F.lit("ONLY_MASTER")))


@query("""WITH d AS (SELECT DISTINCT date, security_id, knowledge_date, active, upper(trim(ticker)) AS ticker FROM pit_membership WHERE date IS NOT NULL AND security_id IS NOT NULL AND knowledge_date IS NOT NULL AND coalesce(upper(trim(snapshot_type)), '') <> 'FORCED_EXIT'),
w AS (SELECT *, lag(active) OVER o AS was, lag(ticker) OVER o AS named, row_number() OVER o AS n FROM d WINDOW o AS (PARTITION BY date, security_id ORDER BY knowledge_date, active NULLS FIRST, ticker NULLS FIRST))
SELECT strftime(date, '%Y-%m-%d') AS day, security_id, n, CASE WHEN n = 1 THEN 'FIRST' WHEN active IS NULL OR was IS NULL THEN 'REFUSED' WHEN active <> was THEN 'REVERSED' WHEN ticker IS DISTINCT FROM named AND NOT EXISTS (SELECT 1 FROM symbol_history h WHERE h.security_id = w.security_id AND upper(trim(h.ticker)) = w.ticker) THEN 'UNKNOWN_NAME' WHEN ticker IS DISTINCT FROM named THEN 'RENAMED' ELSE 'REPEATED' END AS outcome FROM w""")
def g23_corrections(spark, at):
    """What each later delivery of a membership row does to the one before it; a correction from or to nothing is refused, a new name must be in the symbol history."""
    d = load(spark, at, "pit_membership", "date", "security_id", "knowledge_date", "active", "ticker", "snapshot_type").where(F.coalesce(F.upper(F.trim("snapshot_type")), F.lit("")) != "FORCED_EXIT").dropna(subset=["date", "security_id", "knowledge_date"])
    d = d.select("date", "security_id", "knowledge_date", "active", F.upper(F.trim("ticker")).alias("ticker")).distinct()
    o = Window.partitionBy("date", "security_id").orderBy("knowledge_date", "active", "ticker")
    w = d.withColumns({"was": F.lag("active").over(o), "named": F.lag("ticker").over(o), "n": F.row_number().over(o)})
    names = load(spark, at, "symbol_history", "security_id", "ticker").select("security_id", F.upper(F.trim("ticker")).alias("ticker"), F.lit(True).alias("_h")).distinct()
    other = ~F.col("ticker").eqNullSafe(F.col("named"))
    what = F.when(F.col("n") == 1, "FIRST").when(F.col("active").isNull() | F.col("was").isNull(), "REFUSED").when(F.col("active") != F.col("was"), "REVERSED").when(other & F.col("_h").isNull(), "UNKNOWN_NAME").when(other, "RENAMED").otherwise("REPEATED")
    return w.join(names, ["security_id", "ticker"], "left").select(day("date").alias("day"), "security_id", "n", what.alias("outcome"))


@query(f"""WITH {H}, i AS (SELECT DISTINCT security_id, ticker, f, t FROM h WHERE f <= t AND security_id IS NOT NULL AND ticker IS NOT NULL), c AS (SELECT DISTINCT a.security_id FROM i a JOIN i b ON b.security_id = a.security_id AND b.ticker <> a.ticker AND (b.f, b.ticker) < (a.f, a.ticker) AND b.t >= a.f),
b AS (SELECT security_id, min(date) AS first FROM coverage_bars WHERE security_id IS NOT NULL GROUP BY 1), k AS (SELECT security_id, min(f) AS f FROM i GROUP BY 1)
SELECT b.security_id, CASE WHEN c.security_id IS NOT NULL OR k.f IS NULL THEN 'EXCLUDED' WHEN k.f <= b.first THEN 'FULL' ELSE 'PROSPECTIVE' END AS policy, sha256(b.security_id || '|' || coalesce(strftime(k.f, '%Y-%m-%d'), '') || '|' || strftime(b.first, '%Y-%m-%d')) AS evidence FROM b LEFT JOIN k ON k.security_id = b.security_id LEFT JOIN c ON c.security_id = b.security_id""")
def g10_history_policy(spark, at):
    """Whether the whole history of a security may be used, only what comes later, or none: by conflicts and the start of its names; with a hash of the evidence."""
    i = history(spark, at).where("f <= t AND security_id IS NOT NULL AND ticker IS NOT NULL").select("security_id", "ticker", "f", "t").distinct()
    c = begin_inside(i, "security_id", "ticker").select("security_id").distinct().withColumn("_c", F.lit(True))
    k = i.groupBy("security_id").agg(F.min("f").alias("f"))
    b = load(spark, at, "coverage_bars", "security_id", "date").where("security_id IS NOT NULL").groupBy("security_id").agg(F.min("date").alias("first"))
    policy = F.when(F.col("_c").isNotNull() | F.col("f").isNull(), "EXCLUDED").when(F.col("f") <= F.col("first"), "FULL").otherwise("PROSPECTIVE")
    return b.join(k, "security_id", "left").join(c, "security_id", "left").select("security_id", policy.alias("policy"), F.sha2(F.concat_ws("|", "security_id", F.coalesce(day("f"), F.lit("")), day("first")), 256).alias("evidence"))


@query("""WITH q AS (SELECT security_id, min(start_date) AS s FROM query_mappings WHERE security_id IS NOT NULL GROUP BY 1), e AS (SELECT DISTINCT security_id, date FROM pit_membership WHERE security_id IS NOT NULL AND date IS NOT NULL), x AS (SELECT min(date) AS first FROM e)
SELECT security_id, strftime(date, '%Y-%m-%d') AS day, 'DELIVERED' AS origin FROM e UNION ALL SELECT q.security_id, strftime(least(coalesce(q.s, x.first), x.first), '%Y-%m-%d'), 'REQUESTED' FROM q, x WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.security_id = q.security_id) AND x.first IS NOT NULL""")
def g11_request_membership(spark, at):
    """Membership rows with static ones for requested securities that have none, at the earlier of their start and the first delivered day."""
    e = load(spark, at, "pit_membership", "security_id", "date").dropna().distinct()
    q = load(spark, at, "query_mappings", "security_id", "start_date").where("security_id IS NOT NULL").groupBy("security_id").agg(F.min("start_date").alias("s"))
    # one row
    x = F.broadcast(e.agg(F.min("date").alias("first")).where("first IS NOT NULL"))
    new = q.join(e, "security_id", "left_anti").join(x).select("security_id", day(F.least(F.coalesce("s", "first"), "first")).alias("day"), F.lit("REQUESTED").alias("origin"))
    return e.select("security_id", day("date").alias("day"), F.lit("DELIVERED").alias("origin")).unionByName(new)


@query(f"""WITH {BARS_SQL}, {MEMBERS}, cov AS (SELECT strftime(d, '%Y-%m-%d') AS day, count(*) AS expected, count(b.security_id) AS observed FROM a LEFT JOIN bars b ON b.security_id = a.security_id AND b.session_no = a.session_no GROUP BY 1)
SELECT day, expected, observed, round(observed / expected, 6) + 0.0 AS coverage FROM cov ORDER BY observed / expected, day LIMIT 20""")
def o04_worst_coverage(spark, at):
    """The twenty sessions on which the fewest of the members had a bar (a report)."""
    b = bars(spark, at, "close").select("security_id", "session_no", F.lit(1).alias("_b"))
    c = members(spark, at).join(b, ["security_id", "session_no"], "left").groupBy(day("d").alias("day")).agg(F.count(F.lit(1)).alias("expected"), F.count("_b").alias("observed"))
    return c.orderBy(F.col("observed") / F.col("expected"), "day").limit(20).select("day", "expected", "observed", r6(F.col("observed") / F.col("expected")).alias("coverage"))


@query("""WITH j AS (SELECT doc_id, published_at, observed_at, published_at + INTERVAL 2 HOUR AS due, TIMESTAMP '2026-01-01' AS now FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, CASE WHEN published_at IS NULL OR published_at > now THEN 'NOT_YET' WHEN observed_at <= least(due, now) THEN 'DONE' WHEN due <= now AND observed_at <= now THEN 'DONE_LATE' WHEN due <= now THEN 'EXPIRED' ELSE 'OPEN' END AS state, CASE WHEN due <= now AND (observed_at IS NULL OR observed_at > due) THEN date_diff('second', due, least(coalesce(observed_at, now), now)) END AS overdue FROM j""")
def e11_expiry(spark, at):
    """Jobs that were due at a time: done, done late, expired, open; and how long they were overdue."""
    now = F.lit("2026-01-01").cast("timestamp")
    j = load(spark, at, "documents", "doc_id", "published_at", "observed_at").where("doc_id IS NOT NULL").withColumn("due", F.col("published_at") + F.expr("INTERVAL 2 HOURS"))
    seen, due = F.col("observed_at"), F.col("due")
    state = F.when(F.col("published_at").isNull() | (F.col("published_at") > now), "NOT_YET").when(seen <= F.least(due, now), "DONE").when((due <= now) & (seen <= now), "DONE_LATE").when(due <= now, "EXPIRED").otherwise("OPEN")
    seconds = lambda c: F.unix_seconds(F.date_trunc("second", c))
    over = F.when((due <= now) & (seen.isNull() | (seen > due)), seconds(F.least(F.coalesce(seen, now), now)) - seconds(due))
    return j.select("doc_id", state.alias("state"), over.alias("overdue"))


@query("""WITH s AS (SELECT session_date AS d, coalesce(lag(session_date) OVER (ORDER BY session_date), DATE '0001-01-01') AS before FROM trading_sessions), b AS (SELECT date AS d, count(DISTINCT security_id) AS priced FROM coverage_bars GROUP BY 1), q AS (SELECT date AS d, count(*) AS rejected FROM (SELECT DISTINCT date, security_id, ingestion_run_id FROM bar_quarantine) GROUP BY 1),
x AS (SELECT s.d, count(*) AS known, count(*) FILTER (CAST(published_at AS DATE) <= s.d) AS published FROM documents JOIN s ON CAST(observed_at AS DATE) > s.before AND CAST(observed_at AS DATE) <= s.d WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT strftime(s.d, '%Y-%m-%d') AS day, coalesce(priced, 0) AS priced, coalesce(rejected, 0) AS rejected, coalesce(known, 0) AS known, coalesce(published, 0) AS published, CASE WHEN coalesce(priced, 0) = 0 THEN 'NO_PRICES' WHEN coalesce(rejected, 0) > 0.05 * priced THEN 'REJECTED' WHEN coalesce(known, 0) = 0 THEN 'NO_EVENTS' ELSE 'COMPLETE' END AS verdict FROM s LEFT JOIN b USING (d) LEFT JOIN q USING (d) LEFT JOIN x USING (d)""")
def c12_session_audit(spark, at):
    """Every session with what was known by it: prices, rejected rows, documents seen since the session before, and a verdict."""
    s = sessions(spark, at).select(F.col("session_date").alias("d"))
    days = s.withColumn("before", F.lag("d").over(Window.partitionBy().orderBy("d")))
    b = load(spark, at, "coverage_bars", "security_id", "date").groupBy(F.col("date").alias("d")).agg(F.countDistinct("security_id").alias("priced"))
    q = load(spark, at, "bar_quarantine", "date", "security_id", "ingestion_run_id").distinct().groupBy(F.col("date").alias("d")).agg(F.count(F.lit(1)).alias("rejected"))
    # the session that ends each day's wait: days after the one before, up to it; what came before the first session belongs to it
    first = F.broadcast(s.agg(F.min("d").alias("_first"), F.max("d").alias("_last")))
    to = days.where("before IS NOT NULL").select(F.col("d").alias("session"), F.explode(F.sequence(F.date_add("before", 1), "d")).alias("seen"))
    x = load(spark, at, "documents", "doc_id", "published_at", "observed_at").where("doc_id IS NOT NULL AND observed_at IS NOT NULL").withColumn("seen", F.to_date("observed_at")).join(first).join(broadcast_if_bounded(to), "seen", "left")
    x = x.withColumn("d", F.when(F.col("seen") <= F.col("_first"), F.col("_first")).otherwise(F.col("session"))).where("d IS NOT NULL").groupBy("d").agg(F.count(F.lit(1)).alias("known"), F.count_if(F.to_date("published_at") <= F.col("d")).alias("published"))
    out = s.join(b, "d", "left").join(q, "d", "left").join(x, "d", "left").fillna(0)
    verdict = F.when(F.col("priced") == 0, "NO_PRICES").when(F.col("rejected") > 0.05 * F.col("priced"), "REJECTED").when(F.col("known") == 0, "NO_EVENTS").otherwise("COMPLETE")
    return out.select(day("d").alias("day"), "priced", "rejected", "known", "published", verdict.alias("verdict"))


_STEP = "session_no % 20 = 0"


@query(f"""WITH {PANEL_SQL}, f AS (SELECT security_id, session_no, close / nullif(lag(close, 20) {LAG}, 0) - 1 AS mom FROM panel), k AS (SELECT *, row_number() OVER (PARTITION BY session_no ORDER BY mom DESC, security_id) AS r, count(*) OVER (PARTITION BY session_no) AS n FROM f WHERE mom IS NOT NULL AND {_STEP}), t AS (SELECT session_no AS s, security_id FROM k WHERE r <= floor(n / 5)),
b AS (SELECT s + 20 AS s, security_id FROM t WHERE s + 20 IN (SELECT s FROM t)) SELECT coalesce(t.s, b.s) AS session_no, count(*) FILTER (t.s IS NULL OR b.s IS NULL) AS changed, round(count(*) FILTER (t.s IS NULL OR b.s IS NULL) / (count(t.s) + count(b.s)), 6) + 0.0 AS turnover FROM t FULL JOIN b USING (s, security_id) GROUP BY 1""")
def a28_symmetric_turnover(spark, at):
    """Turnover of the top fifth as the share of names that only one of two successive selections has."""
    f = panel(spark, at, "close").withColumn("mom", S.change("close", 20)).where(f"mom IS NOT NULL AND {_STEP}")
    w = Window.partitionBy("session_no")
    t = f.withColumns({"r": F.row_number().over(w.orderBy(F.col("mom").desc(), "security_id")), "n": F.count(F.lit(1)).over(w)}).where("r <= floor(n / 5)").select("session_no", "security_id", F.lit(1).alias("_t"))
    b = t.select((F.col("session_no") + 20).alias("session_no"), "security_id", F.lit(1).alias("_b")).join(broadcast_if_bounded(t.select("session_no").distinct()), "session_no", "left_semi")
    both = t.join(b, ["session_no", "security_id"], "full_outer").groupBy("session_no").agg(F.count_if(F.col("_t").isNull() | F.col("_b").isNull()).alias("changed"), (F.count("_t") + F.count("_b")).alias("_n"))
    return both.select("session_no", "changed", r6(F.col("changed") / F.col("_n")).alias("turnover"))


_CUT = "2025-07-01"
_WINDOWS = f"""d AS (SELECT security_id, date, max_by({{'c': close, 'v': volume}}, (source_asof, ingestion_run_id)) FILTER (source_asof < DATE '{_CUT}') AS a, max_by({{'c': close, 'v': volume}}, (source_asof, ingestion_run_id)) FILTER (source_asof >= DATE '{_CUT}') AS b FROM coverage_bars WHERE isfinite(close) AND close > 0 AND source_asof IS NOT NULL AND security_id IS NOT NULL AND date IS NOT NULL GROUP BY ALL)"""


def _windows(spark: SparkSession, at: str) -> DataFrame:
    """The last delivery of each bar before a day and the last one since: one aggregate is the full outer join of the two windows."""
    df = load(spark, at, "coverage_bars", "security_id", "date", "close", "volume", "source_asof", "ingestion_run_id").where(finite(F.col("close")) & (F.col("close") > 0)).dropna(subset=["source_asof", "security_id", "date"])
    value = F.struct("source_asof", "ingestion_run_id", F.col("close").alias("c"), F.col("volume").alias("v"))
    new = F.col("source_asof") >= F.lit(_CUT).cast("date")
    return df.groupBy("security_id", "date").agg(F.max(F.when(~new, value)).alias("a"), F.max(F.when(new, value)).alias("b"))


@query(f"""WITH {_WINDOWS}, s AS (SELECT security_id, median(b.c / a.c) AS scale FROM d WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1)
SELECT d.security_id, CASE WHEN a IS NULL THEN 'NEW' WHEN b IS NULL THEN 'KEPT' WHEN a.c = b.c AND a.v IS NOT DISTINCT FROM b.v THEN 'UNCHANGED' WHEN a.c = b.c THEN 'VOLUME' WHEN abs(b.c / a.c / scale - 1) <= 1e-4 THEN 'RESCALED' ELSE 'REVISED' END AS class, count(*) AS bars FROM d LEFT JOIN s USING (security_id) GROUP BY ALL""")
def j17_revision_classes(spark, at):
    """Bars of an earlier and a fresh delivery window aligned and classified per security: new, kept, unchanged, other volume, rescaled as the security's others, revised."""
    d = _windows(spark, at)
    s = d.where("a IS NOT NULL AND b IS NOT NULL").groupBy("security_id").agg(F.median(F.col("b.c") / F.col("a.c")).alias("scale"))
    same = F.col("a.c") == F.col("b.c")
    kind = F.when(F.col("a").isNull(), "NEW").when(F.col("b").isNull(), "KEPT").when(same & F.col("a.v").eqNullSafe(F.col("b.v")), "UNCHANGED").when(same, "VOLUME").when(F.abs(F.col("b.c") / F.col("a.c") / F.col("scale") - 1) <= 1e-4, "RESCALED").otherwise("REVISED")
    return d.join(s, "security_id", "left").groupBy("security_id", kind.alias("class")).agg(F.count(F.lit(1)).alias("bars"))


@query(f"""WITH {_WINDOWS}, o AS (SELECT * FROM d WHERE a IS NOT NULL AND b IS NOT NULL AND isfinite(a.v) AND isfinite(b.v)), g AS (SELECT security_id, count(*) AS overlap, median(b.c / a.c) AS scale, median(b.v / a.v) FILTER (a.v > 0 AND b.v > 0) AS volume_scale, count(*) FILTER ((a.v = 0) <> (b.v = 0)) AS zero_conflicts FROM o GROUP BY 1)
SELECT security_id, overlap, {r('scale', 'scale')}, {r('volume_scale', 'volume_scale')}, zero_conflicts, CASE WHEN zero_conflicts > 0 THEN 'ZERO_CONFLICT' WHEN overlap < 3 THEN 'SHORT_OVERLAP' WHEN abs(scale - 1) > 0.5 THEN 'SCALE' ELSE 'OK' END AS verdict FROM g""")
def g07_overlap_audit(spark, at):
    """The scales of price and volume over the overlap of two delivery windows of each security, zeros that only one of them has, and the failure, if any."""
    o = _windows(spark, at).where("a IS NOT NULL AND b IS NOT NULL").where(finite(F.col("a.v")) & finite(F.col("b.v")))
    both = (F.col("a.v") > 0) & (F.col("b.v") > 0)
    g = o.groupBy("security_id").agg(F.count(F.lit(1)).alias("overlap"), F.median(F.col("b.c") / F.col("a.c")).alias("scale"), F.median(F.when(both, F.col("b.v") / F.col("a.v"))).alias("volume_scale"), F.count_if((F.col("a.v") == 0) != (F.col("b.v") == 0)).alias("zero_conflicts"))
    verdict = F.when(F.col("zero_conflicts") > 0, "ZERO_CONFLICT").when(F.col("overlap") < 3, "SHORT_OVERLAP").when(F.abs(F.col("scale") - 1) > 0.5, "SCALE").otherwise("OK")
    return g.select("security_id", "overlap", r6(F.col("scale")).alias("scale"), r6(F.col("volume_scale")).alias("volume_scale"), "zero_conflicts", verdict.alias("verdict"))


_HOR = (5, 20)
_OUT = ", ".join(
    f"lead(open, {h + 1}) {LAG} AS x{h}, max(high) OVER (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS h{h}, min(low) OVER (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS l{h}, max(session_no) OVER (PARTITION BY security_id) < session_no + {h + 1} AS c{h}" for h in _HOR
)
OUTCOMES = f"""{PANEL_SQL}, w AS (SELECT security_id, session_no, close, max(close) OVER (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS top, count(close) OVER (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS n, lead(open) {LAG} AS entry, {_OUT} FROM panel),
ev AS (SELECT *, {", ".join(f"x{h} / nullif(entry, 0) - 1 AS gross{h}" for h in _HOR)} FROM w WHERE close > top AND n = 60)"""


def _outcomes(spark: SparkSession, at: str) -> DataFrame:
    w = S.by_security()
    df = panel(spark, at, "open", "high", "low", "close")
    past = w.rowsBetween(-60, -1)
    cols = {"top": F.max("close").over(past), "n": F.count("close").over(past), "entry": F.lead("open").over(w), "_end": F.max("session_no").over(Window.partitionBy("security_id"))}
    for h in _HOR:
        ahead = w.rowsBetween(1, h)
        cols |= {f"x{h}": F.lead("open", h + 1).over(w), f"h{h}": F.max("high").over(ahead), f"l{h}": F.min("low").over(ahead)}
    ev = df.withColumns(cols).where("close > top AND n = 60")
    for h in _HOR:
        ev = ev.withColumn(f"gross{h}", S.ratio(F.col(f"x{h}"), F.col("entry")) - 1).withColumn(f"c{h}", F.col("_end") < F.col("session_no") + h + 1)
    return ev


@query(f"WITH {OUTCOMES} SELECT security_id, session_no, " + ", ".join(f"{r(f'gross{h}', f'gross_{h}')}, {r(f'gross{h} - 0.002', f'net_{h}')}, {r(f'h{h} / nullif(entry, 0) - 1', f'best_{h}')}, {r(f'l{h} / nullif(entry, 0) - 1', f'worst_{h}')}, c{h} AS censored_{h}" for h in _HOR) + " FROM ev")
def w39_event_outcomes(spark, at):
    """Outcomes of new highs: bought at the next open, sold at the open after the horizon; gross, net of costs, best and worst price before the day of sale, and whether the horizon is cut off."""
    ev = _outcomes(spark, at)
    out = []
    for h in _HOR:
        out += [r6(F.col(f"gross{h}")).alias(f"gross_{h}"), r6(F.col(f"gross{h}") - 0.002).alias(f"net_{h}"), r6(S.ratio(F.col(f"h{h}"), F.col("entry")) - 1).alias(f"best_{h}"), r6(S.ratio(F.col(f"l{h}"), F.col("entry")) - 1).alias(f"worst_{h}"), F.col(f"c{h}").alias(f"censored_{h}")]
    return ev.select("security_id", "session_no", *out)


@query(f"""WITH {OUTCOMES}, k AS (SELECT ev.*, strftime(t.session_date, '%Y') AS year, CASE WHEN b.up >= 0.5 THEN 'RISING' WHEN b.up IS NOT NULL THEN 'FALLING' END AS regime FROM ev JOIN trading_sessions t USING (session_no) LEFT JOIN (SELECT session_no, avg(CASE WHEN close > p THEN 1.0 WHEN p IS NOT NULL AND close IS NOT NULL THEN 0.0 END) AS up FROM (SELECT session_no, close, lag(close) {LAG} AS p FROM panel) GROUP BY 1) b USING (session_no)),
u AS (SELECT 'year' AS kind, year AS key, gross5, gross20 FROM k UNION ALL SELECT 'regime', regime, gross5, gross20 FROM k)
SELECT kind, key, count(*) AS events, count(gross5) AS complete, {r('avg(gross5)', 'mean_5')}, {r('median(gross5)', 'median_5')}, {r('avg(CASE WHEN gross20 > 0 THEN 1.0 WHEN gross20 IS NOT NULL THEN 0.0 END)', 'hit_20')} FROM u WHERE key IS NOT NULL GROUP BY ALL""")
def a24_outcomes_by_key(spark, at):
    """Summaries of event outcomes by year and by the breadth of the event's session; events without a key are left out."""
    w = S.by_security()
    p = panel(spark, at, "close").withColumn("p", F.lag("close").over(w))
    up = p.groupBy("session_no").agg(F.avg(F.when(F.col("close") > F.col("p"), 1.0).when(F.col("p").isNotNull() & F.col("close").isNotNull(), 0.0)).alias("up"))
    calendar = broadcast_if_bounded(sessions(spark, at).select(F.col("session_no").cast("int").alias("session_no"), F.date_format("session_date", "yyyy").alias("year")), load(spark, at, "trading_sessions"))
    k = _outcomes(spark, at).join(calendar, "session_no").join(up, "session_no", "left").withColumn("regime", F.when(F.col("up") >= 0.5, "RISING").when(F.col("up").isNotNull(), "FALLING"))
    u = k.select("gross5", "gross20", F.expr("stack(2, 'year', year, 'regime', regime) AS (kind, key)")).where("key IS NOT NULL")
    hit = F.avg(F.when(F.col("gross20") > 0, 1.0).when(F.col("gross20").isNotNull(), 0.0))
    return u.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("events"), F.count("gross5").alias("complete"), r6(F.avg("gross5")).alias("mean_5"), r6(F.median("gross5")).alias("median_5"), r6(hit).alias("hit_20"))


@query(f"WITH {PANEL_SQL}, d AS (SELECT security_id, session_no, CASE WHEN close > 0 AND volume > 0 THEN close * volume END AS usd FROM panel) SELECT security_id, session_no, count(usd) OVER w AS sessions, round(avg(usd) OVER w, 0) + 0.0 AS adv60 FROM d WINDOW w AS (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)")
def g06_adv60(spark, at):
    """Mean traded value of the sixty sessions strictly before each one, of the positive ones."""
    d = panel(spark, at, "close", "volume").withColumn("usd", F.when((F.col("close") > 0) & (F.col("volume") > 0), F.col("close") * F.col("volume")))
    w = S.by_security().rowsBetween(-60, -1)
    return d.select("security_id", "session_no", F.count("usd").over(w).alias("sessions"), (F.round(F.avg("usd").over(w), 0) + 0.0).alias("adv60"))


@query(f"WITH {IC}, v AS (SELECT session_no, ic, " + ", ".join(f"CASE WHEN count(ic) OVER w{n} >= {n} / 2 THEN avg(ic) OVER w{n} END AS m{n}, CASE WHEN count(ic) OVER w{n} >= {n} / 2 THEN stddev_samp(ic) OVER w{n} END AS s{n}" for n in (21, 63)) + " FROM ic WINDOW " + ", ".join(f"w{n} AS (ORDER BY session_no ROWS {n - 1} PRECEDING)" for n in (21, 63)) + ") SELECT session_no, " + ", ".join(f"{r(f'm{n}', f'mean_{n}')}, round(m{n} / nullif(s{n}, 0), 5) + 0.0 AS ratio_{n}" for n in (21, 63)) + " FROM v")
def g15_rolling_ic(spark, at):
    """Rolling mean and information ratio of the coefficients over 21 and 63 sessions, of which half must have one."""
    order = Window.partitionBy().orderBy("session_no")
    out = []
    for n in (21, 63):
        w = order.rowsBetween(-(n - 1), 0)
        enough = F.count("ic").over(w) >= n / 2
        mean, sd = F.when(enough, F.avg("ic").over(w)), F.when(enough, F.stddev_samp("ic").over(w))
        out += [r6(mean).alias(f"mean_{n}"), (F.round(mean / F.nullif(sd, F.lit(0.0)), 5) + 0.0).alias(f"ratio_{n}")]
    return _ic(spark, at).select("session_no", *out)


@query("""WITH f AS (SELECT factor_id, date, count(DISTINCT security_id) FILTER (isfinite(clean_value)) AS n FROM factor_values WHERE factor_id IS NOT NULL AND date IS NOT NULL GROUP BY ALL) SELECT factor_id, count(*) AS dates, count(*) FILTER (n >= 10) AS evaluable, max(n) AS widest, count(*) FILTER (n >= 10) >= 24 AS ready FROM f GROUP BY 1""")
def g02_evaluable_dates(spark, at):
    """Dates on which a factor has enough clean values to be evaluated, and whether they are enough."""
    f = load(spark, at, "factor_values", "factor_id", "date", "security_id", "clean_value").dropna(subset=["factor_id", "date"])
    n = f.groupBy("factor_id", "date").agg(F.countDistinct(F.when(finite(F.col("clean_value")), F.col("security_id"))).alias("n"))
    ok = F.count_if(F.col("n") >= 10)
    return n.groupBy("factor_id").agg(F.count(F.lit(1)).alias("dates"), ok.alias("evaluable"), F.max("n").alias("widest"), (ok >= 24).alias("ready"))


@query(f"""WITH {PANEL_SQL}, e AS (SELECT max(session_no) AS s FROM trading_sessions GROUP BY date_trunc('month', session_date)), p AS (SELECT security_id, session_no, right(security_id, 1) AS grp, lead(open) {LAG} AS entry, lead(close, 10) {LAG} AS out, count(close) OVER (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS n FROM panel),
f AS (SELECT *, out / nullif(entry, 0) - 1 AS fwd FROM p WHERE session_no IN (SELECT s FROM e) AND n = 10), g AS (SELECT session_no, grp, count(fwd) AS n, avg(fwd) AS fwd FROM f GROUP BY ALL HAVING count(fwd) > 0), m AS (SELECT session_no, avg(fwd) AS market FROM f GROUP BY 1)
SELECT g.session_no, grp, n, {r('g.fwd', 'forward')}, {r('g.fwd - market', 'excess')}, rank() OVER (PARTITION BY g.session_no ORDER BY round(g.fwd, 9) DESC) + (count(*) OVER (PARTITION BY g.session_no, round(g.fwd, 9)) - 1) / 2.0 AS place FROM g JOIN m USING (session_no)""")
def g26_sector_comparison(spark, at):
    """Each group's return from the open after a month end to the close ten sessions on, over names priced throughout, its excess over all, and its place with ties at their mean."""
    w = S.by_security()
    p = panel(spark, at, "open", "close").select("security_id", "session_no", F.lead("open").over(w).alias("entry"), F.lead("close", 10).over(w).alias("out"), F.count("close").over(w.rowsBetween(1, 10)).alias("n"))
    # a row per month
    ends = F.broadcast(sessions(spark, at).groupBy(F.trunc("session_date", "month")).agg(F.max("session_no").cast("int").alias("session_no")).select("session_no"))
    f = p.join(ends, "session_no", "left_semi").where("n = 10").select("session_no", F.right("security_id", F.lit(1)).alias("grp"), (S.ratio(F.col("out"), F.col("entry")) - 1).alias("fwd"))
    g = f.groupBy("session_no", "grp").agg(F.count("fwd").alias("n"), F.avg("fwd").alias("fwd")).where("n > 0").join(f.groupBy("session_no").agg(F.avg("fwd").alias("market")), "session_no").withColumn("_r", F.round("fwd", 9))
    place = F.rank().over(Window.partitionBy("session_no").orderBy(F.col("_r").desc())) + (F.count(F.lit(1)).over(Window.partitionBy("session_no", "_r")) - 1) / 2
    return g.select("session_no", "grp", "n", r6(F.col("fwd")).alias("forward"), r6(F.col("fwd") - F.col("market")).alias("excess"), place.alias("place"))


@query(f"""WITH {PANEL_SQL}, e AS (SELECT max(session_no) AS session_no, max(session_date) AS d FROM trading_sessions GROUP BY date_trunc('month', session_date)), v AS (SELECT security_id, session_no, unadjusted_close, count(*) FILTER (close > 0 AND volume >= 0) OVER w AS n, avg(CASE WHEN close > 0 AND volume >= 0 THEN close * volume END) OVER w AS adv FROM panel WINDOW w AS (PARTITION BY security_id ORDER BY session_no ROWS 19 PRECEDING)),
k AS (SELECT v.*, e.d FROM v JOIN e USING (session_no)), s AS (SELECT k.security_id, k.session_no, max_by({{'st': upper(trim(trading_status)), 'ty': upper(trim(asset_type)), 'ex': upper(trim(primary_exchange))}}, (source_asof, updated_at)) AS m FROM k JOIN security_master_snapshots x ON x.security_id = k.security_id AND x.source_asof <= k.d WHERE updated_at IS NOT NULL GROUP BY ALL),
g AS (SELECT k.security_id, k.session_no, coalesce(m.st = 'ACTIVE', false) AS listed, coalesce(m.ty = 'STOCK', false) AS asset, coalesce(m.ex IN ('NYSE', 'NASDAQ', 'AMEX'), false) AS exchange, coalesce(unadjusted_close >= 5, false) AS price, coalesce(adv >= 1000000 AND n >= 15, false) AS liquid FROM k LEFT JOIN s ON s.security_id = k.security_id AND s.session_no = k.session_no)
SELECT security_id, session_no, listed AND asset AND exchange AND price AND liquid AS eligible, concat_ws(';', CASE WHEN NOT listed THEN 'LISTED' END, CASE WHEN NOT asset THEN 'ASSET_TYPE' END, CASE WHEN NOT exchange THEN 'EXCHANGE' END, CASE WHEN NOT price THEN 'PRICE' END, CASE WHEN NOT liquid THEN 'LIQUIDITY' END) AS codes FROM g""")
def proj22_u10_month_end_gates(spark, at):
    """The gates of all month ends at once: master as known then, unadjusted price, trailing traded value with enough valid sessions; with the code of each that fails."""
    df = panel(spark, at, "close", "volume", "unadjusted_close")
    valid = (F.col("close") > 0) & (F.col("volume") >= 0)
    w = S.frame(20)
    v = df.select("security_id", "session_no", "unadjusted_close", F.count_if(valid).over(w).alias("n"), F.avg(F.when(valid, F.col("close") * F.col("volume"))).over(w).alias("adv"))
    # a row per month
    ends = F.broadcast(sessions(spark, at).groupBy(F.trunc("session_date", "month")).agg(F.max("session_no").cast("int").alias("session_no"), F.max("session_date").alias("date")).select("session_no", "date"))
    k = v.join(ends, "session_no")
    from tidemark.operators.asof import History, last_known

    up = lambda c: F.upper(F.trim(c))
    m = load(spark, at, "security_master_snapshots", "security_id", "source_asof", "updated_at", "trading_status", "asset_type", "primary_exchange").where("updated_at IS NOT NULL")
    m = m.select("security_id", "source_asof", F.struct("updated_at", up("trading_status").alias("st"), up("asset_type").alias("ty"), up("primary_exchange").alias("ex")).alias("m"))
    s = last_known(k.select("security_id", "date").distinct(), "date", {"m": History(m, ("security_id",), "source_asof", "m")})
    yes = lambda c: F.coalesce(c, F.lit(False))
    g = k.join(s, ["security_id", "date"], "left")
    gates = {"LISTED": yes(F.col("m.st") == "ACTIVE"), "ASSET_TYPE": yes(F.col("m.ty") == "STOCK"), "EXCHANGE": yes(F.col("m.ex").isin("NYSE", "NASDAQ", "AMEX")), "PRICE": yes(F.col("unadjusted_close") >= 5), "LIQUIDITY": yes((F.col("adv") >= 1_000_000) & (F.col("n") >= 15))}
    codes = F.concat_ws(";", *[F.when(~c, n) for n, c in gates.items()])
    return g.select("security_id", "session_no", (codes == "").alias("eligible"), codes.alias("codes"))


@query(f"""WITH {PANEL_SQL}, v AS (SELECT security_id, session_no, avg(CASE WHEN close > 0 AND volume > 0 THEN close * volume END) OVER (PARTITION BY security_id ORDER BY session_no ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS adv FROM panel), l AS (SELECT security_id, max_by(adv, session_no) AS adv FROM v GROUP BY 1), u AS (SELECT security_id, max_by(upper(trim(issuer_id)), (updated_at, upper(trim(issuer_id)))) AS issuer FROM security_master_snapshots WHERE updated_at IS NOT NULL AND issuer_id IS NOT NULL AND security_id IS NOT NULL GROUP BY 1),
k AS (SELECT issuer, u.security_id, round(adv, 0) AS adv, row_number() OVER (PARTITION BY issuer ORDER BY round(adv, 0) DESC NULLS LAST, u.security_id) AS r, count(*) OVER (PARTITION BY issuer) AS n FROM u LEFT JOIN l ON l.security_id = u.security_id) SELECT issuer, security_id AS representative, n AS classes, adv + 0.0 AS adv60 FROM k WHERE r = 1""")
def u14_counting_units(spark, at):
    """One unit per issuer: of its share classes, the one with the greatest traded value of the sixty sessions strictly before its last."""
    d = panel(spark, at, "close", "volume").withColumn("usd", F.when((F.col("close") > 0) & (F.col("volume") > 0), F.col("close") * F.col("volume")))
    v = d.select("security_id", "session_no", F.avg("usd").over(S.by_security().rowsBetween(-60, -1)).alias("adv"))
    last = v.groupBy("security_id").agg(F.max_by("adv", "session_no").alias("adv"))
    u = load(spark, at, "security_master_snapshots", "security_id", "issuer_id", "updated_at").dropna().groupBy("security_id").agg(F.max(F.struct("updated_at", F.upper(F.trim("issuer_id")).alias("i"))).alias("u")).select("security_id", F.col("u.i").alias("issuer"))
    k = u.join(last, "security_id", "left").withColumn("adv", F.round("adv", 0))
    w = Window.partitionBy("issuer")
    k = k.withColumns({"r": F.row_number().over(w.orderBy(F.col("adv").desc_nulls_last(), "security_id")), "n": F.count(F.lit(1)).over(w)})
    return k.where("r = 1").select("issuer", F.col("security_id").alias("representative"), F.col("n").alias("classes"), (F.col("adv") + 0.0).alias("adv60"))


@query("""WITH c AS (SELECT 'audits' AS dataset, count(*) AS rows FROM eligibility_audit UNION ALL SELECT 'factors', count(*) FROM factor_values UNION ALL SELECT 'membership', count(*) FROM pit_membership) SELECT dataset, 'v1' AS version, rows, true AS pinned FROM c""")
def s12_k07_k11_published_bundle(spark, at):
    """Three published versions pinned in one contract: what is published later doesn't change what the contract reads."""
    root = scratch_dir(spark, "bundle")
    tables = {"audits": "eligibility_audit", "factors": "factor_values", "membership": "pit_membership"}
    versions = {n: VersionedTable(spark, f"{root}/{n}", month_of="date") for n in tables}
    for n, t in tables.items():
        versions[n].write(load(spark, at, t), "v1", {"rows": F.count(F.lit(1)) >= 0})
        versions[n].publish("v1")
    contract = {n: v.published() for n, v in versions.items()}
    versions["factors"].write(load(spark, at, "factor_values").limit(0), "v2")
    versions["factors"].publish("v2", expected="v1")
    found = None
    for n, v in versions.items():
        rows = v.read(contract[n]).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("dataset"), F.lit(contract[n]).alias("version"), "rows", F.lit(v.manifest(contract[n]) is not None).alias("pinned"))
        found = rows if found is None else found.unionByName(rows)
    return found


@query(f"""WITH {LEDGER}, m AS (SELECT security_id, max_by({{'t': upper(trim(current_ticker)), 's': upper(trim(trading_status))}}, (updated_at, upper(trim(current_ticker)))) AS m FROM security_master_snapshots WHERE security_id IS NOT NULL AND updated_at IS NOT NULL AND current_ticker IS NOT NULL GROUP BY 1)
SELECT m.security_id, m.m.t AS ticker, m.m.s AS status FROM m WHERE security_id IN (SELECT security_id FROM mem WHERE date = (SELECT max(date) FROM sn))""")
def s04_current_universe(spark, at):
    """The master's rows of current members: the predicate is a semi join with the last snapshot."""
    mem, snaps = _snapshots(spark, at)
    now = mem.join(F.broadcast(snaps.agg(F.max("date").alias("date"))), "date", "left_semi").select("security_id")
    up = lambda c: F.upper(F.trim(c))
    s = load(spark, at, "security_master_snapshots", "security_id", "current_ticker", "trading_status", "updated_at").dropna(subset=["security_id", "current_ticker", "updated_at"])
    m = s.groupBy("security_id").agg(F.max(F.struct("updated_at", up("current_ticker").alias("t"), up("trading_status").alias("s"))).alias("m"))
    return m.join(now, "security_id", "left_semi").select("security_id", F.col("m.t").alias("ticker"), F.col("m.s").alias("status"))


@query("""WITH d AS (SELECT doc_id, document_id, coalesce(kind, 'UNKNOWN') AS family, published_at, observed_at, timezone('UTC', CAST(event_date + 8 AS TIMESTAMP)) AS cutoff, row_number() OVER (PARTITION BY document_id ORDER BY observed_at NULLS LAST, doc_id) AS n FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT *, concat_ws(';', CASE WHEN published_at IS NULL OR observed_at IS NULL OR cutoff IS NULL THEN 'NO_CLOCK' END, CASE WHEN observed_at < published_at THEN 'ORDER' END, CASE WHEN greatest(published_at, observed_at) > cutoff THEN 'AFTER_CUTOFF' END, CASE WHEN published_at < cutoff - INTERVAL 7 DAY THEN 'OLD' END, CASE WHEN n > 1 THEN 'REPEATED' END) AS reasons FROM d)
SELECT family, doc_id, reasons = '' AS kept, reasons FROM r""")
def g21_context_families(spark, at):
    """Documents of each family as context for their event: clocks in order, known by the cutoff, not older than a week, each once; with the reasons against the others."""
    d = load(spark, at, "documents", "doc_id", "document_id", "kind", "published_at", "observed_at", "event_date").where("doc_id IS NOT NULL")
    n = F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("observed_at").asc_nulls_last(), "doc_id"))
    d = d.withColumns({"cutoff": F.date_add("event_date", 8).cast("timestamp"), "n": n})
    p, o, c = F.col("published_at"), F.col("observed_at"), F.col("cutoff")
    reasons = F.concat_ws(";", F.when(p.isNull() | o.isNull() | c.isNull(), "NO_CLOCK"), F.when(o < p, "ORDER"), F.when(F.greatest(p, o) > c, "AFTER_CUTOFF"), F.when(p < c - F.expr("INTERVAL 7 DAYS"), "OLD"), F.when(F.col("n") > 1, "REPEATED"))
    return d.select(F.coalesce("kind", F.lit("UNKNOWN")).alias("family"), "doc_id", reasons.alias("reasons")).select("family", "doc_id", (F.col("reasons") == "").alias("kept"), "reasons")


@query("""WITH a AS (SELECT DISTINCT date, security_id, upper(trim(ticker)) AS ticker, asset_type_pass, CASE WHEN isfinite(adv20_usd) THEN adv20_usd END AS size FROM eligibility_audit WHERE date IS NOT NULL AND security_id IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY date, security_id ORDER BY size DESC NULLS LAST, ticker, asset_type_pass) AS n FROM a),
r AS (SELECT *, CASE WHEN n > 1 THEN 'REPEATED' WHEN NOT coalesce(asset_type_pass, false) THEN 'ASSET_KIND' WHEN size IS NULL OR size <= 0 THEN 'NO_WEIGHT' END AS excluded FROM k)
SELECT strftime(date, '%Y-%m-%d') AS day, security_id, round(CASE WHEN excluded IS NULL THEN size / sum(CASE WHEN excluded IS NULL THEN size END) OVER (PARTITION BY date) END, 8) + 0.0 AS weight, excluded FROM r""")
def g20_holdings(spark, at):
    """Holdings of each date in one form: other asset kinds, repeated lines and lines without a weight are listed as excluded, the weights of the others are shares of their sum."""
    a = load(spark, at, "eligibility_audit", "date", "security_id", "ticker", "asset_type_pass", "adv20_usd").dropna(subset=["date", "security_id"])
    a = a.select("date", "security_id", F.upper(F.trim("ticker")).alias("ticker"), "asset_type_pass", F.when(finite(F.col("adv20_usd")), F.col("adv20_usd")).alias("size")).distinct()
    n = F.row_number().over(Window.partitionBy("date", "security_id").orderBy(F.col("size").desc_nulls_last(), F.col("ticker").asc_nulls_last(), F.col("asset_type_pass").asc_nulls_last()))
    why = F.when(F.col("n") > 1, "REPEATED").when(~F.coalesce("asset_type_pass", F.lit(False)), "ASSET_KIND").when(F.col("size").isNull() | (F.col("size") <= 0), "NO_WEIGHT")
    r_ = a.withColumn("n", n).withColumn("excluded", why).withColumn("_in", F.when(F.col("excluded").isNull(), F.col("size")))
    return r_.select(day("date").alias("day"), "security_id", (F.round(F.col("_in") / F.sum("_in").over(Window.partitionBy("date")), 8) + 0.0).alias("weight"), "excluded")


@query(f"""WITH {PANEL_SQL}, b AS (SELECT session_no, right(security_id, 1) AS grp, avg(adj_close) AS c FROM panel WHERE adj_close > 0 GROUP BY ALL), m AS (SELECT session_no, avg(c) AS mc FROM b GROUP BY 1), q AS (SELECT b.*, c / mc AS q FROM b JOIN m USING (session_no)),
k AS (SELECT *, q / lag(q, 20) OVER w - 1 AS rs20, CASE WHEN q > lag(q) OVER w THEN 1 ELSE 0 END AS beat, ln(q / lag(q, 5) OVER w) AS l5, ln(q / lag(q, 20) OVER w) AS l20 FROM q WINDOW w AS (PARTITION BY grp ORDER BY session_no)),
r AS (SELECT *, rank() OVER (PARTITION BY session_no ORDER BY rs20 DESC) AS rank FROM k WHERE rs20 IS NOT NULL), t AS (SELECT *, lag(rank, 5) OVER w AS rank_5, lag(rank, 20) OVER w AS rank_20, sum(beat) OVER (PARTITION BY grp ORDER BY session_no ROWS 19 PRECEDING) AS days FROM r WINDOW w AS (PARTITION BY grp ORDER BY session_no))
SELECT session_no, grp, rank, rank_5, rank_20, rank_20 - rank AS climbed, CAST(days AS BIGINT) AS outperformed, round(CASE WHEN abs(l20) > 0.001 THEN l5 / l20 END, 3) + 0.0 AS share_5, CASE WHEN rank_20 IS NULL THEN 'NEW' WHEN rank <= 3 AND rank_5 <= 3 AND rank_20 <= 3 THEN 'PERSISTENT' WHEN rank <= 3 AND rank_20 > 3 THEN 'RISEN' WHEN rank > 3 AND rank_20 <= 3 THEN 'FALLEN' ELSE 'OUTSIDE' END AS persistence FROM t""")
def w34_rotation_timeline(spark, at):
    """Rank of each basket by its twenty-session strength now and at earlier offsets, its change, the sessions it outperformed, the share of the last five sessions in its move, and how lasting it is."""
    b = panel(spark, at, "adj_close").where("adj_close > 0").groupBy("session_no", F.right("security_id", F.lit(1)).alias("grp")).agg(F.avg("adj_close").alias("c"))
    q = b.withColumn("q", F.col("c") / F.avg("c").over(Window.partitionBy("session_no")))
    w = Window.partitionBy("grp").orderBy("session_no")
    ago = lambda n: F.lag("q", n).over(w)
    k = q.withColumns({"rs20": F.col("q") / ago(20) - 1, "beat": F.when(F.col("q") > ago(1), 1).otherwise(0), "l5": F.ln(F.col("q") / ago(5)), "l20": F.ln(F.col("q") / ago(20))}).where("rs20 IS NOT NULL")
    k = k.withColumn("rank", F.rank().over(Window.partitionBy("session_no").orderBy(F.col("rs20").desc())))
    t = k.withColumns({"rank_5": F.lag("rank", 5).over(w), "rank_20": F.lag("rank", 20).over(w), "days": F.sum("beat").over(w.rowsBetween(-19, 0))})
    top = F.col("rank") <= 3
    lasting = F.when(F.col("rank_20").isNull(), "NEW").when(top & (F.col("rank_5") <= 3) & (F.col("rank_20") <= 3), "PERSISTENT").when(top & (F.col("rank_20") > 3), "RISEN").when(~top & (F.col("rank_20") <= 3), "FALLEN").otherwise("OUTSIDE")
    return t.select("session_no", "grp", "rank", "rank_5", "rank_20", (F.col("rank_20") - F.col("rank")).alias("climbed"), F.col("days").alias("outperformed"), (F.round(F.when(F.abs("l20") > 0.001, F.col("l5") / F.col("l20")), 3) + 0.0).alias("share_5"), lasting.alias("persistence"))
