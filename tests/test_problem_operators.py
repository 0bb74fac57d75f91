"""The general problems' operators on small cases, against brute force."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import anomalies, intervals, rolling, snapshots
from tidemark.operators.asof import History, last_known
from tidemark.operators.bars import accepted
from tidemark.scale import hot_keys


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_digest_keeps_neighbours_and_nulls_apart(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", None), (None, "ab"), ("a ", "B"), ("", "ab"), ("a|b", None)], "x string, y string")
    d = [bytes(r[0]) for r in df.select(snapshots.row_digest(df, ["x", "y"])).collect()]
    assert d[0] == d[3] and d[2] == d[4]
    assert len({d[0], d[1], d[2], d[5]}) == 4


def test_snapshot_changes_of_small_generations(spark):
    rows = [("g1", "a", "x"), ("g1", "b", "y"), ("g1", "b", "y"), ("g2", "a", "X "), ("g2", "c", None), ("bad", "a", "q"), ("g3", "c", ""), ("g3", "a", "z"), (None, "a", "x"), ("g1", None, "x")]
    rows = spark.createDataFrame(rows, "g string, k string, v string").withColumn("s", F.lit("active"))
    gens = spark.createDataFrame([("g1", 1, "published", 2, 2), ("g2", 2, "PUBLISHED", 2, 2), ("bad", 3, "PUBLISHED", 5, 1), ("g3", 4, "PUBLISHED", 2, 2), ("g3", 4, "PUBLISHED", 2, 2), ("none", 5, None, None, None)], "g string, o int, st string, n int, a int").withColumn("u", F.lit("u"))
    delivered = snapshots.delivered_rows(rows, generation="g", key="k", compare=["v"], active=("s", "ACTIVE"))
    usable = snapshots.complete_generations(gens, delivered, generation="g", series="u", order=["o"], status=("st", "PUBLISHED"), row_count="n", active_count="a")
    got = {tuple(r) for r in snapshots.snapshot_changes(delivered, usable).collect()}
    assert got == {("g2", "b", "removed"), ("g2", "c", "added"), ("g3", "a", "changed")}


def test_accepted_takes_the_latest_with_null_first(spark):
    df = spark.createDataFrame([("s", day(0), None, "r9", 1.0), ("s", day(0), day(1), "r1", 2.0), ("s", day(0), day(1), "r2", 3.0), (None, day(0), day(1), "r2", 3.0)], "k string, d date, a date, r string, v double")
    assert [tuple(r) for r in accepted(df, ("k", "d"), ("a", "r"), ("v",)).collect()] == [("s", day(0), 3.0)]


def amounts_of(spark, rows):
    return rolling.daily_amounts(spark.createDataFrame(rows, "e string, p int, v double"), "e", F.col("p"), {"v": F.col("v")})


def brute_totals(rows, e, p, w):
    inside = [v for x, q, v in rows if x == e and p - w < q <= p]
    return len(inside), (round(sum(inside), 6) if inside else None)


@pytest.mark.parametrize("cut", [None, 12])
def test_trailing_totals_equal_brute_force(spark, cut):
    rng = random.Random(3)
    rows = [(e, p, round(rng.uniform(-5, 1e6), 4)) for e in "abc" for p in range(40) if rng.random() < 0.6]
    windows = {"w3": 3, "w10": 10}
    state, new = None, rows
    if cut is not None:
        state = rolling.advance(amounts_of(spark, [r for r in rows if r[1] <= cut]), cut, windows, ["v"])
        new = [r for r in rows if r[1] > cut]
    asked = spark.createDataFrame([(e, p, "extra") for e in "abcd" for p in range((cut or -1) + 1, 45)], "_entity string, _pos int, note string")
    got = rolling.trailing_totals(amounts_of(spark, new), asked, windows, ["v"], state).collect()
    assert len(got) == asked.count()
    for r in got:
        for w, n in windows.items():
            count, total = brute_totals(rows, r["_entity"], r["_pos"], n)
            assert r[f"n_{w}"] == count
            assert (r[f"v_{w}"] is None) == (total is None) and (total is None or float(r[f"v_{w}"]) == pytest.approx(total, abs=1e-6))


def test_corrections_replay_only_later_versions(spark, tmp_path):
    rows = [("a", p, float(p)) for p in range(20)]
    store = rolling.RollingState(spark, "t", {"w": 5}, ["v"], root=str(tmp_path))
    for to in (4, 9, 14, 19):
        store.advance_to(amounts_of(spark, [r for r in rows if to - 5 < r[1] <= to]), to)
    fixed = [(e, p, v + (100 if p == 11 else 0)) for e, p, v in rows]
    assert store.correct(amounts_of(spark, fixed), 11) == [14, 19]
    for at in store.versions:
        assert float(store.load(at).totals.first()["_s_v_w"]) == brute_totals(fixed, "a", at, 5)[1]


def test_state_survives_a_restart_and_refuses_late_amounts(spark, tmp_path):
    rows = [("a", p, float(p + 1)) for p in range(12)]
    store = lambda: rolling.RollingState(spark, "t", {"w": 5}, ["v"], root=str(tmp_path))
    store().advance_to(amounts_of(spark, rows[:6]), 5)
    with pytest.raises(ValueError, match="late"):
        store().advance_to(amounts_of(spark, [("a", 4, 100.0)]), 8)
    with pytest.raises(ValueError, match="not later"):
        store().advance_to(amounts_of(spark, rows[6:]), 5)
    store().advance_to(amounts_of(spark, rows[6:]), 9)
    again = store()
    assert again.versions == [5, 9] and float(again.load().totals.first()["_s_v_w"]) == brute_totals(rows, "a", 9, 5)[1]
    late = rows + [("b", 4, 100.0)]
    assert again.correct(amounts_of(spark, late), 4) == [5, 9]
    assert {r["_entity"]: float(r["_s_v_w"]) for r in store().load(5).totals.collect()} == {"a": brute_totals(rows, "a", 5, 5)[1], "b": 100.0}


def test_replay_by_stretches_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(e, p, float(rng.randrange(50))) for e in "abc" for p in range(60) if rng.random() < 0.4]
    for positions in ([59], [19, 39, 59], [0, 3, 58]):
        store = rolling.RollingState(spark, "replay", {"w": 7, "v": 1}, ["v"])
        asked = spark.createDataFrame([(e, -2, 70) for e in "abcd"], "_entity string, _pos int, _to int")
        got = {(r["_entity"], r["_pos"]): (r["n_w"], None if r["v_w"] is None else float(r["v_w"])) for r in store.replay(amounts_of(spark, rows), asked, positions).collect()}
        assert len(got) == 4 * 73 and store.versions == positions
        for (e, p), (n, total) in got.items():
            count, want = brute_totals(rows, e, p, 7)
            assert n == count and total == (want if count else None)


def test_medians_of_split_sources_are_exact(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice([0.0, 1e-9, rng.random(), rng.random() * 1e-4, 7.5])) for k in "abcdef" for _ in range(rng.randrange(1, 60))]
    got = {r["k"]: r["_scale"] for r in anomalies._exact_medians(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {k: float(np.median([v for x, v in rows if x == k])) for k in {r[0] for r in rows}}


def test_splitting_hot_sources_changes_nothing(spark, small):
    from tidemark.plans import problems

    how = dict(source="security_id", date="date", run="ingestion_run_id", order=("source_asof", "ingestion_run_id"), fields=("open", "adj_close"), steady=("adj_close",), base="close", activity="volume", bounds=("high", "low"), everything=True)
    bars, quarantine = (problems.load(spark, small, t).limit(10**9) for t in ("coverage_bars", "bar_quarantine"))
    # most rows of one source are quarantined: they count for the split too
    one = quarantine.first()["security_id"]
    quarantine = quarantine.unionByName(quarantine.where(quarantine.security_id == one).withColumn("ingestion_run_id", F.explode(F.array(*[F.lit(f"x{i}") for i in range(300)])))).unionByName(quarantine.limit(2).withColumn("security_id", F.lit(None).cast("string")))
    whole, split = ({tuple(map(str, r)) for r in anomalies.judged_rows(bars, quarantine, **how, rows_per_task=n).collect()} for n in (10**6, 250))
    assert whole == split and len(whole) > 3000


def test_amounts_without_meaning_are_left_out(spark):
    df = spark.createDataFrame([(None, 1, 1.0), ("a", None, 1.0), ("a", 1, None), ("a", 1, 2.0), ("a", 2, 1e30)], "e string, p int, v double")
    amounts = rolling.daily_amounts(df, "e", F.col("p"), {"v": F.col("v")})
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("a", 9)], "_entity string, _pos int")
    got = {r["_pos"]: (r["n_w"], None if r["v_w"] is None else float(r["v_w"])) for r in rolling.trailing_totals(amounts, asked, {"w": 3}, ["v"]).collect()}
    assert got == {1: (1, 2.0), 2: (2, None), 9: (0, None)}


def brute_periods(rows):
    out = set()
    for e in {r[0] for r in rows if r[0]}:
        own = sorted((a or dt.date.min, b or dt.date.max) for x, a, b in rows if x == e and (a or dt.date.min) <= (b or dt.date.max))
        merged = []
        for a, b in own:
            if merged and (a - merged[-1][1]).days <= 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(e, "period", a, b) for a, b in merged}
        out |= {(e, "gap", p[1] + dt.timedelta(1), q[0] - dt.timedelta(1)) for p, q in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("days", [1, 7, 3653])
def test_periods_equal_brute_force(spark, days):
    rng = random.Random(days)
    rows = [("hot" if rng.random() < 0.4 else f"e{rng.randrange(6)}", day(a), day(a + rng.randrange(-3, 30))) for a in (rng.randrange(900) for _ in range(150))]
    rows += [("open", None, day(3)), ("open", day(4), None), ("left", None, day(0)), ("left", day(2), day(2)), ("all", None, None), (None, day(0), day(1)), ("edge", dt.date(1899, 12, 30), dt.date(1900, 1, 1)), ("edge", dt.date(1900, 1, 2), dt.date(2101, 5, 5))]
    df = spark.createDataFrame(rows * 2, "e string, a date, b date")
    shards = intervals.Shards(days, dt.date(2024, 1, 1) if days < 99 else dt.date(1900, 1, 1), dt.date(2026, 1, 1) if days < 99 else dt.date(2100, 1, 1))
    epoch = dt.date(1970, 1, 1)
    # every entity of two rows and more by shards, some, and none
    for rows_per_task in (1, 30, 20_000):
        got = intervals.periods_and_gaps(intervals.merged_periods(df, "e", "a", "b", shards, rows_per_task)).collect()
        assert Counter((r["_entity"], r["kind"], epoch + dt.timedelta(r["_from"]), epoch + dt.timedelta(r["_to"])) for r in got) == Counter(brute_periods(rows))


def test_last_known_matches_each_attribute_by_itself(spark):
    rng = random.Random(5)
    a = [(f"k{rng.randrange(3)}", day(rng.randrange(40)), rng.randrange(9)) for _ in range(40)] + [("k0", None, 1), (None, day(1), 2), ("k0", day(2), None)]
    b = [(day(rng.randrange(40)), f"v{rng.randrange(5)}") for _ in range(8)]
    asked = [(f"k{i}", day(d)) for i in range(4) for d in range(0, 45, 3)]
    requests = spark.createDataFrame(asked, "key string, t date")
    got = last_known(requests, "t", {
        "price": History(spark.createDataFrame(a, "key string, d date, v int"), ("key",), "d", "v"),
        "best": History(spark.createDataFrame(a, "key string, d date, v int"), ("key",), "d", "v", greatest=True),
        "state": History(spark.createDataFrame(b, "d date, s string"), (), "d", "s"),
    })
    assert got.columns == ["key", "t", "price", "best", "state"]
    for r in got.collect():
        known = [(d, v) for k, d, v in a if k == r["key"] and d and v is not None and d <= r["t"]]
        assert r["price"] == (max(known)[1] if known else None)
        assert r["best"] == (max(v for _, v in known) if known else None)
        assert r["state"] == (max([x for x in b if x[0] <= r["t"]])[1] if any(x[0] <= r["t"] for x in b) else None)
    assert got.count() == len(asked)


def test_isolation_forest_ranks_outliers_first():
    rng = np.random.default_rng(0)
    normal = np.abs(rng.normal(0, 0.1, (500, 4)))
    forest = anomalies.IsolationForest(normal, 32, 64, 1, np.ones(4), np.full(4, 0.25))
    odd = normal[:5] + np.array([1.0, 0, 0, 0])
    assert forest.score(odd).min() > np.quantile(forest.score(normal), 0.99)
    assert len(forest.score(normal[:0])) == 0


def series(spark, n=60, seed=2):
    """A source with normal noise; returns rows (source, date, run, asof, open, close, adj, unadj, volume)."""
    rng = random.Random(seed)
    return [["s", day(i), f"r{i:03}", day(i), 100 * math.exp(rng.gauss(0, 0.006)), 100.0 + rng.gauss(0, 1), None, None, 1000.0 + i] for i in range(n)]


def judged(spark, rows, quarantined=(), **more):
    schema = "source string, date date, run string, asof date, open double, close double, adj double, unadj double, volume double"
    df, q = spark.createDataFrame([tuple(r) for r in rows], schema), spark.createDataFrame([tuple(r) for r in quarantined], schema)
    out = anomalies.flagged_rows(df, q, source="source", date="date", run="run", order=("asof", "run"), fields=("open", "adj", "unadj"), steady=("adj", "unadj"), base="close", activity="volume", bounds=(), **more)
    return {(r["origin"], r["_run"]): tuple(r["reasons"]) for r in out.collect()}


def test_spikes_runs_and_limits(spark):
    rows = series(spark)
    for i, r in enumerate(rows):
        r[4] = r[5] * math.exp(random.Random(i).gauss(0, 0.006))
        r[6] = r[5] * (0.9 if i < 30 else 1.0)  # a lasting change is no spike
        r[7] = r[5]
    rows[10][4] = rows[10][5] * 1.5  # a spike of the open
    rows[20][6] *= 2  # of a steady field
    for i in (40, 41, 42):
        rows[i][7] *= 3  # a spell of three
    for i in range(30, 34):
        rows[i][7] *= 3  # four sessions are no spell
    for i in range(50, 55):
        rows[i][4] = 123.456
        rows[i][5] = 123.4
        rows[i][6] = rows[i][7] = rows[i][5] * 1.0001
    rows[52][8] = 0.0
    rows += [["s", day(56), "late", day(50), -1.0, 100.0, None, float("nan"), 1.0], ["s", day(57), "nothing", None, None, None, None, None, None], [None, day(1), "lost", day(1), 0.0, 1.0, 1.0, 1.0, 1.0]]
    rows[55][4:8] = [123.456, 123.4, 123.4, 123.4]
    bad = [["s", day(5), "q1", day(5), 400.0, 100.0, 90.0, 100.0, 1.0], ["s", day(5), "q2", day(5), 100.0, None, float("inf"), 1.0, 1.0], ["s", day(5), "q3", day(5), 100.0, 100.0, 90.0, 100.0, 1.0], ["unknown", day(5), "q4", day(5), 0.0, 1.0, 1.0, 1.0, 1.0]]
    got = judged(spark, rows + rows, bad, rows_per_task=30)
    want = {("deliveries", "r010"): ("spike",), ("deliveries", "r020"): ("spike",), ("deliveries", "late"): ("impossible",), ("deliveries", "lost"): ("impossible",)}
    want |= {("deliveries", f"r{i:03}"): ("spike",) for i in (40, 41, 42)}
    want |= {("deliveries", f"r{i:03}"): ("stuck",) for i in (50, 51, 53, 54, 55)}
    want |= {("quarantined", "q1"): ("spike",), ("quarantined", "q2"): ("impossible",), ("quarantined", "q4"): ("impossible",)}
    assert got == want


def test_hot_keys_are_few_and_enough(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("k"))
    assert [tuple(r) for r in hot_keys(df, "k", 100).collect()] == [(0, 4)]
    assert hot_keys(df.limit(0), "k", 100).count() == 0
