"""Library parts without SQL of their own: versions, sequential rules, portfolios, statistics, the registry."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.operators import portfolio, series, states, stats, xsec
from tidemark.scale import broadcast_if_bounded
from tidemark.sources.versions import NotPublished, VersionedTable, fingerprint, upsert


def test_versions_are_gated_published_and_never_overwritten(spark, tmp_path):
    df = spark.createDataFrame([("a", "2025-01-03", 1.0), ("b", "2025-02-04", None)], "k string, d string, v double").withColumn("d", F.to_date("d"))
    table = VersionedTable(spark, str(tmp_path), month_of="d")
    with pytest.raises(NotPublished):
        table.read()
    table.write(df, "v1", {"full": F.count_if(F.col("v").isNull()) == 0})
    with pytest.raises(NotPublished):
        table.publish("v1")
    table.write(df.fillna(0.0), "v2", {"full": F.count_if(F.col("v").isNull()) == 0})
    table.publish("v2")
    with pytest.raises(NotPublished):
        table.publish("v2", expected="v0")
    with pytest.raises(Exception):
        table.write(df, "v2")
    assert [r["k"] for r in table.read(start="2025-02-01").collect()] == ["b"]
    table.replace_months("v2", "v3", df.where("k = 'b'").fillna(9.0))
    table.publish("v3", expected="v2")
    assert {r["k"]: r["v"] for r in table.read(verify=True).collect()} == {"a": 1.0, "b": 9.0}


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.range(50).withColumn("v", F.col("id") * 3)
    of = lambda d: d.agg(fingerprint(d)).first()[0]
    assert of(df) == of(df.orderBy(F.col("id").desc()).repartition(7)) != of(df.where("id <> 4"))
    assert of(df.limit(0)) is not None


def test_upsert_keeps_the_latest(spark):
    a = spark.createDataFrame([(1, 5, "old"), (2, 1, "kept")], "k int, t int, v string")
    b = spark.createDataFrame([(1, 5, "new"), (2, 0, "late"), (3, None, None)], "k int, t int, v string")
    assert {r["k"]: r["v"] for r in upsert(a, b, ["k"], ["t"]).collect()} == {1: "new", 2: "kept", 3: None}


def test_confirmed_state_and_cooldown_equal_the_sequential_rules(spark):
    rng = random.Random(3)
    raw = [(k, i, rng.choice(["A", "B", None])) for k in "xy" for i in range(60)]
    df = spark.createDataFrame(raw, "k string, i int, s string")
    got = {(r["k"], r["i"]): r["c"] for r in states.confirmed_state(df, "s", ["k"], "i", 2, "c").collect()}
    for k in "xy":
        state, before = None, None
        for _, i, s in [r for r in raw if r[0] == k]:
            if s is not None and s == before:
                state = s
            before = s
            assert got[k, i] == state
    hits = [(k, i) for k, i, s in raw if s == "A"]
    kept = {tuple(r) for r in states.with_cooldown(spark.createDataFrame(hits + hits, "k string, i int"), ["k"], "i", 5).collect()}
    want = set()
    for k in "xy":
        last = -99
        for _, i in sorted(h for h in hits if h[0] == k):
            if i - last > 5:
                want.add((k, i))
                last = i
    assert kept == want


def test_portfolio_equals_a_replay_of_cash_and_quantities(spark):
    rng = random.Random(8)
    prices = {}
    for s in "abcdefg":
        x = 20.0
        for t in range(1, 32):
            x *= 1 + rng.gauss(0, 0.02)
            prices[s, t] = None if rng.random() < 0.06 or (s == "g" and t == 11) or (s == "f" and t > 24) else x
    targets = [(1, p, s) for p, members in ((0, "abc"), (1, "bcdg"), (2, "ef")) for s in members]
    periods, exits, cost = [(0, 1, 11), (1, 11, 21), (2, 21, 31)], [("b", 15), ("a", 2)], 0.01
    prices["b", 15] = prices["a", 2] = 33.0
    for _, p, s in targets:
        first = periods[p][1]
        if (s, first) != ("g", 11):
            prices[s, first] = prices[s, first] or 21.0
    got = portfolio.simulate_at_open(
        spark.createDataFrame([(g, p, s, 1.0 / sum(q == p for _, q, _ in targets)) for g, p, s in targets], "grp int, period int, security_id string, weight double"),
        spark.createDataFrame([(s, t, x) for (s, t), x in prices.items()], "security_id string, session_no int, price double"),
        spark.createDataFrame(periods, "period int, trade int, until int"),
        spark.createDataFrame(exits, "security_id string, exit int"),
        cost,
    )
    rows = {(r["period"], r["session_no"]): r for r in got.collect()}

    def mark(s, t):
        return next((prices[s, k] for k in range(t, max(t - 6, 0), -1) if prices[s, k] is not None), None)

    cash, held, lost = 1.0, {}, False
    for p, first, last in periods:
        names = [s for _, q, s in targets if q == p]
        before = cash + sum(q * mark(s, first) for s, q in held.items())
        bought = [s for s in names if prices[s, first] is not None]
        after = before
        for _ in range(60):
            after = before - cost * sum(abs((after / len(names) if s in bought else 0) - held.get(s, 0) * (mark(s, first) or 0)) for s in {*bought, *held})
        row = rows[p, first]
        assert row["nav"] == pytest.approx(after, rel=1e-9) and row["nav"] + row["cost"] == pytest.approx(before, rel=1e-9)
        held = {s: after / len(names) / prices[s, first] for s in bought}
        cash = after * (1 - len(bought) / len(names))
        assert row["cash"] == pytest.approx(1 - len(bought) / len(names))
        for t in range(first, last + 1):
            for s, out in exits:
                if t == out and s in held and out > first:
                    cash += held.pop(s) * mark(s, t)
            values = [mark(s, t) for s in held]
            nav = None if None in values else cash + sum(q * v for q, v in zip(held.values(), values))
            lost = lost or nav is None
            assert rows[p, t]["nav"] == (None if nav is None else pytest.approx(nav, rel=1e-9))
    assert lost and rows[1, 15]["exited"] == 1


def test_logistic_meets_its_gradient(spark):
    rng = random.Random(1)
    rows = [(x, float(rng.random() < 1 / (1 + math.exp(-(0.3 + 2 * x))))) for x in (rng.gauss(0, 1) for _ in range(400))]
    df = spark.createDataFrame([*rows, (None, 1.0)], "x double, y double")
    a, b = stats.logistic(df, "x", "y", 1.0)
    p = [1 / (1 + math.exp(-(a + b * x))) for x, _ in rows]
    assert abs(sum(q - y for q, (_, y) in zip(p, rows))) < 1e-6
    assert abs(sum((q - y) * x for q, (x, y) in zip(p, rows)) + b) < 1e-6
    assert stats.logistic(df.limit(0), "x", "y", 1.0) == (0.0, 0.0)


def test_total_loss_stays_a_loss(spark):
    df = spark.createDataFrame([("s", i, r) for i, r in enumerate([0.1, -1.0, 0.2, 0.1, 0.3])], "security_id string, session_no int, ret double")
    assert df.withColumn("x", series.compounded("ret", 5)).where("session_no = 4").first()["x"] == -1.0


def test_sections_without_spread_have_no_scores(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 2.0), (1, "c", None), (2, "a", None)], "d int, k string, v double")
    assert all(r["z"] is None for r in xsec.zscore(df, "v", ["d"], "z").collect())
    got = {(r["d"], r["k"]): (r["rank"], r["percentile"]) for r in xsec.ranks(df, "v", ["d"]).collect()}
    assert got == {(1, "a"): (1, 75.0), (1, "b"): (1, 75.0), (1, "c"): (None, None), (2, "a"): (None, None)}
    assert df.groupBy("d").agg(xsec.correlation(F.col("v"), F.col("v")).alias("c")).where("c IS NOT NULL").count() == 0


def test_registry_refuses_a_second_name_and_other_signs():
    with pytest.raises(ValueError):
        fn.register("MOM_1M", (), 1, 0) if fn.REGISTRY else fn.register("x", (), 0, 0)
    with pytest.raises(ValueError):
        fn.register("NEW", (), 0, 0)


def test_wide_sides_are_not_broadcast(spark):
    small, large = spark.range(10), spark.range(5_000)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(large.join(broadcast_if_bounded(small, max_rows=100), "id"))
    assert "strategy=broadcast" not in plan(large.join(broadcast_if_bounded(large, max_rows=100), "id"))
