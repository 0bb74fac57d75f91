"""The queries of the general data-pipeline problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import anomalies, intervals, rolling, snapshots
from tidemark.operators.asof import History, last_known
from tidemark.operators.bars import accepted
from tidemark.scale import broadcast_if_bounded, cut_lineage, finite
from tidemark.sources.tables import load

MASTER_COLUMNS = (
    "issuer_id", "current_ticker", "name", "asset_type", "primary_exchange", "country", "cik",
    "listing_date", "trading_status", "delisting_date", "currency",
)


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    """Master rows added, removed or changed between consecutive usable generations."""
    generations = load(spark, at, "security_master_generations")
    rows = load(spark, at, "security_master_snapshots", "generation_id", "security_id", "updated_at", *MASTER_COLUMNS)
    delivered = snapshots.delivered_rows(
        rows, generation="generation_id", key="security_id", compare=MASTER_COLUMNS, latest="updated_at", active=("trading_status", "ACTIVE")
    )
    usable = snapshots.complete_generations(
        generations,
        delivered,
        generation="generation_id",
        series="universe",
        order=("target_session", "created_at"),
        status=("status", "PUBLISHED"),
        row_count="row_count",
        active_count="active_count",
    )
    return snapshots.snapshot_changes(delivered, usable, generations).select(
        F.col("_generation").alias("generation_id"), F.col("_key").alias("security_id"), "change_kind"
    )


DELIVERY = ("source_asof", "ingestion_run_id")


def _valid_bars(spark: SparkSession, at: str) -> DataFrame:
    """Accepted bars with a usable close and volume: security_id, date, close, volume."""
    bars = load(spark, at, "coverage_bars", "security_id", "date", "close", "volume", *DELIVERY)
    best = accepted(bars, ("security_id", "date"), DELIVERY, ("close", "volume"))
    close, volume = F.col("close"), F.col("volume")
    return best.where(finite(close) & finite(volume) & (close > 0) & (volume >= 0))


def session_of_days(sessions: DataFrame, after: int = 366) -> DataFrame:
    """(day, session_no): the last session on or before each calendar day, up to ``after`` days behind the last one."""
    # one row per session of the calendar, so one task may order them
    following = sessions.withColumn("_next", F.lead("session_date").over(Window.partitionBy().orderBy("session_date")))
    return following.select("session_no", F.explode(F.expr(f"sequence(session_date, coalesce(date_sub(_next, 1), date_add(session_date, {after})))")).alias("day"))


#: positions after which a version of the rolling state is stored
STRETCH_SESSIONS, STRETCH_DAYS = 128, 184


def _calendar(spark: SparkSession, at: str) -> tuple[DataFrame, dict]:
    """The sessions, and their first and last number and day; one row is read."""
    sessions = load(spark, at, "trading_sessions", "session_date", "session_no").dropna().dropDuplicates(["session_date"])
    low, high = F.min("session_no"), F.max("session_no")
    ends = sessions.agg(low.alias("low"), high.alias("high"), F.unix_date(F.min("session_date")).alias("first"), F.unix_date(F.max("session_date")).alias("last")).first()
    return sessions, ends.asDict()


def _positions(low: int | None, high: int | None, stretch: int) -> list[int]:
    """Where versions of the state are stored between the ends of an axis."""
    if low is None:
        return [0]
    return [*range(low + stretch - 1, high, stretch), high]


def _session_amounts(spark: SparkSession, at: str, sessions: DataFrame) -> DataFrame:
    calendar = broadcast_if_bounded(sessions, load(spark, at, "trading_sessions"))
    valid = _valid_bars(spark, at).join(calendar, F.col("date") == F.col("session_date"))
    return rolling.daily_amounts(valid, "security_id", F.col("session_no"), {"usd": F.col("close") * F.col("volume")})


def p2_found(spark: SparkSession, at: str) -> DataFrame:
    """Audit rows whose 20-session figures disagree with the accepted bars, from the rolling state advanced through the calendar."""
    sessions, ends = _calendar(spark, at)
    amounts = _session_amounts(spark, at, sessions)
    audit = load(spark, at, "eligibility_audit", "date", "security_id", "adv20_usd", "valid_sessions_20d").dropna(subset=["date", "security_id"])
    requests = audit.distinct().join(broadcast_if_bounded(session_of_days(sessions), sessions), F.col("date") == F.col("day"), "left").select(
        F.col("security_id").alias("_entity"), F.coalesce("session_no", F.lit((ends["low"] or 0) - 1)).alias("_pos"), "date", "adv20_usd", "valid_sessions_20d"
    )
    state = rolling.RollingState(spark, "sessions", {"s20": 20}, ["usd"])
    totals = state.replay(amounts, requests, _positions(ends["low"], ends["high"], STRETCH_SESSIONS))
    mean = F.col("usd_s20").cast("double") / F.nullif(F.col("n_s20"), F.lit(0))
    stored = F.when(finite(F.col("adv20_usd")), F.col("adv20_usd"))
    wrong = (
        ~F.col("valid_sessions_20d").eqNullSafe(F.col("n_s20"))
        | (stored.isNull() != F.col("_mean").isNull())
        | F.coalesce(F.abs(stored - F.col("_mean")) > 0.002 * F.abs("_mean"), F.lit(False))
    )
    return totals.withColumn("_mean", mean).where(wrong).select(F.date_format("date", "yyyy-MM-dd").alias("audit_date"), F.col("_entity").alias("security_id")).distinct()


def p2_totals(spark: SparkSession, at: str) -> DataFrame:
    """For each security and calendar day from its first delivered bar to the end of the calendar: totals of 7 and 30 days and 20 sessions.

    All three windows lie on the day axis of one rolling state: a bar on a session expires from the 20
    sessions on the day of the 20th session after it; a bar on another day is in no session window.
    """
    sessions, ends = _calendar(spark, at)
    calendar = sessions.withColumn("_out", F.date_add("session_date", 100_000))
    # one row per session of the calendar, so one task may order them
    calendar = calendar.withColumn("_out", F.coalesce(F.lead("session_date", 20).over(Window.partitionBy().orderBy("session_date")), "_out"))
    calendar = broadcast_if_bounded(calendar.select("session_date", "_out"), load(spark, at, "trading_sessions"))
    bars = _valid_bars(spark, at).join(calendar, F.col("date") == F.col("session_date"), "left")
    measures = {"volume": F.col("volume"), "usd": F.col("close") * F.col("volume")}
    amounts = rolling.daily_amounts(bars, "security_id", F.unix_date("date"), measures, {"s20": F.unix_date("_out")})
    # securities without a valid bar have days too; a bar behind the calendar's last session is within them
    delivered = load(spark, at, "coverage_bars", "security_id", "date").dropna().groupBy("security_id").agg(F.min("date").alias("_from"), F.max("date").alias("_last"))
    end = F.lit(ends["last"] if ends["last"] is not None else -(2**31))
    asked = delivered.select(F.col("security_id").alias("_entity"), F.unix_date("_from").alias("_pos"), F.greatest(F.unix_date("_last"), end).cast("int").alias("_to"))
    state = rolling.RollingState(spark, "days", {"d7": 7, "d30": 30, "s20": None}, list(measures))
    totals = state.replay(amounts, asked, _positions(ends["first"], ends["last"], STRETCH_DAYS))
    out = [F.col("_entity").alias("security_id"), F.date_format(F.date_from_unix_date("_pos"), "yyyy-MM-dd").alias("day")]
    for w in ("d7", "d30", "s20"):
        n = F.nullif(F.col(f"n_{w}"), F.lit(0))
        out += [F.coalesce(f"n_{w}", F.lit(0)).alias(f"n_{w}")]
        out += [x for m in measures for x in (F.col(f"{m}_{w}").cast("double").alias(f"{m}_{w}"), F.round(F.col(f"{m}_{w}").cast("double") / n, 1).alias(f"mean_{m}_{w}"))]
    return totals.select(*out)


def p2_state(spark: SparkSession, at: str) -> DataFrame:
    """The stored versions of the 20-session state after corrections: (session_no, security_id, n_s20, usd_s20).

    The state is advanced over the first delivery of each bar and then corrected by the accepted ones: the
    versions from the first session with another amount on are computed anew from the version before it.
    """
    sessions, ends = _calendar(spark, at)
    calendar = broadcast_if_bounded(sessions, load(spark, at, "trading_sessions"))
    rows = load(spark, at, "coverage_bars", "security_id", "date", "close", "volume", *DELIVERY).dropna(subset=["security_id", "date"])
    close, volume, order = F.col("close"), F.col("volume"), F.struct(*DELIVERY, "close", "volume")
    both = rows.groupBy("security_id", "date").agg(F.min(order).alias("first"), F.max(order).alias("last")).join(calendar, F.col("date") == F.col("session_date"))
    both = both.select("security_id", "session_no", F.explode(F.array(F.struct(F.lit(0).alias("v"), "first.close", "first.volume"), F.struct(F.lit(1).alias("v"), "last.close", "last.volume"))).alias("x"))
    valid = cut_lineage(both.select("security_id", "session_no", "x.*").where(finite(close) & finite(volume) & (close > 0) & (volume >= 0)))
    of = lambda v: rolling.daily_amounts(valid.where(F.col("v") == v), "security_id", F.col("session_no"), {"usd": close * volume})
    state = rolling.RollingState(spark, "corrected", {"s20": 20}, ["usd"])
    done = None
    for p in _positions(ends["low"], ends["high"], STRETCH_SESSIONS):
        state.advance_to(of(0) if done is None else of(0).where(F.col("_pos") > done), p)
        done = p
    changed = valid.groupBy("security_id", "session_no").agg(F.min_by(F.struct("close", "volume"), "v").alias("a"), F.max_by(F.struct("close", "volume"), "v").alias("b"), F.count(F.lit(1)).alias("n"))
    first = changed.where("n < 2 OR a <> b").agg(F.min("session_no")).first()[0]
    if first is not None:
        state.correct(of(1), first)
    found = None
    for v in state.versions:
        part = state.load(v).totals.where("_n_s20 > 0").select(F.lit(v).alias("session_no"), F.col("_entity").alias("security_id"), F.col("_n_s20").alias("n_s20"), F.when(F.col("_big_s20") == 0, F.round(F.col("_s_usd_s20").cast("double"), 2)).alias("usd_s20"))
        found = part if found is None else found.unionByName(part)
    return found


def _judged(spark: SparkSession, at: str, everything: bool) -> DataFrame:
    columns = ("security_id", "date", "open", "high", "low", "close", "adj_close", "unadjusted_close", "volume", *DELIVERY)
    found = anomalies.judged_rows(
        load(spark, at, "coverage_bars", *columns),
        load(spark, at, "bar_quarantine", *columns),
        source="security_id",
        date="date",
        run="ingestion_run_id",
        order=DELIVERY,
        fields=("open", "adj_close", "unadjusted_close"),
        steady=("adj_close", "unadjusted_close"),
        base="close",
        activity="volume",
        bounds=("high", "low"),
        origins=("coverage_bars", "bar_quarantine"),
        everything=everything,
    )
    key = [F.col("_source").alias("security_id"), F.date_format("_date", "yyyy-MM-dd").alias("bar_date"), F.col("_run").alias("ingestion_run_id")]
    return found.select("origin", *key, "score", "reasons")


def p3_found(spark: SparkSession, at: str) -> DataFrame:
    """Delivered and quarantined bars with a spike, a stuck value or an impossible reading."""
    return _judged(spark, at, False).drop("score", "reasons")


def p3_scores(spark: SparkSession, at: str) -> DataFrame:
    """Every delivered and quarantined bar with the forest's score and the reasons against it, ``unusual`` where the forest alone finds it suspect."""
    return _judged(spark, at, True).select("origin", "security_id", "bar_date", "ingestion_run_id", F.round("score", 4).alias("score"), F.array_join("reasons", ";").alias("reasons"))


def p4_found(spark: SparkSession, at: str) -> DataFrame:
    """Continuous periods of the symbol intervals and alias windows of each security, and the gaps between them."""
    history = load(spark, at, "symbol_history").select("security_id", F.col("effective_from").alias("_start"), F.col("effective_to").alias("_end"))
    mapped = load(spark, at, "query_mappings").select(
        "security_id",
        F.col("start_date").alias("_start"),
        F.when(F.col("next_alias_start").isNotNull(), F.date_sub("next_alias_start", 1)).otherwise(F.col("end_date")).alias("_end"),
    )
    periods = intervals.merged_periods(history.unionByName(mapped), "security_id", "_start", "_end")
    day = lambda c: F.date_format(F.date_from_unix_date(c), "yyyy-MM-dd")
    return intervals.periods_and_gaps(periods).select(
        F.col("_entity").alias("security_id"), "kind", day("_from").alias("from_day"), day("_to").alias("to_day")
    )


COMPLETE = ("MONTH_END", "FORCED_EXIT_CARRY_FORWARD", "")


def known_membership(membership: DataFrame, requests: DataFrame, calendar_bound: int = 100_000) -> DataFrame:
    """(security_id, date, snapshot, active, last_exit, member) for distinct (security_id, date) requests.

    The snapshot known on a day is the same for all securities; its history has at most a row per day, so it
    is matched over days alone and joined back by day.
    """
    kind = F.coalesce(F.upper(F.trim("snapshot_type")), F.lit(""))
    rows = membership.select("security_id", F.col("date").alias("_date"), "knowledge_date", F.coalesce("active", F.lit(False)).alias("_active"), kind.alias("_kind"))
    complete = rows.where(F.col("_kind").isin(*COMPLETE))
    exits = rows.where(F.col("_kind") == "FORCED_EXIT").withColumn("_known", F.greatest("_date", "knowledge_date"))
    days = last_known(
        requests.select("date").distinct(), "date", {"snapshot": History(complete.select("knowledge_date", "_date"), (), "knowledge_date", "_date", greatest=True)}
    )
    asked = requests.join(broadcast_if_bounded(days, max_rows=calendar_bound), "date").select("security_id", "date", "snapshot")
    state = complete.select("security_id", F.col("_date").alias("snapshot"), "knowledge_date", "_active")
    known = last_known(
        asked,
        "date",
        {
            "active": History(state, ("security_id", "snapshot"), "knowledge_date", "_active"),
            "last_exit": History(exits, ("security_id",), "_known", "_date", greatest=True),
        },
    )
    left = F.coalesce(F.col("last_exit") > F.col("snapshot"), F.lit(False))
    return known.withColumn("member", F.coalesce("active", F.lit(False)) & ~left)


def p5_found(spark: SparkSession, at: str) -> DataFrame:
    """Factor rows whose pit_member differs from the membership known on their date."""
    factors = load(spark, at, "factor_values", "date", "security_id", "factor_id", "pit_member").dropna()
    known = known_membership(load(spark, at, "pit_membership"), factors.select("security_id", "date").distinct())
    return (
        factors.join(known.select("security_id", "date", "member"), ["security_id", "date"])
        .where(F.col("pit_member") != F.col("member"))
        .select(F.date_format("date", "yyyy-MM-dd").alias("obs_date"), "security_id", "factor_id")
        .distinct()
    )


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_totals": p2_totals, "p2_state": p2_state, "p3_found": p3_found, "p3_scores": p3_scores, "p4_found": p4_found, "p5_found": p5_found}
