"""Queries over whole axes: what lies between or behind the rows that a cut would keep, on small tables against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from oracle import difference, duck
from tidemark.plans import aggregate_queries

QUERIES, SQL = entry.queries(), entry.oracle_sql()
START = dt.date(2024, 7, 1)
PRICES = ("open", "high", "low", "close", "adj_close", "volume", "unadjusted_close")


def day(n):
    return START + dt.timedelta(days=n)


def calendar(n):
    """``n`` sessions on weekdays."""
    weekdays = [d for d in map(day, range(2 * n + 7)) if d.weekday() < 5]
    return weekdays[:n]


def write(root, **tables):
    """The small tables, with rows of their own for those given as lists of records of some of the columns."""
    from variants import SMALL

    for p in SMALL.glob("*.parquet"):
        schema = pq.read_schema(p)
        table = pa.Table.from_pylist([dict.fromkeys(schema.names) | r for r in tables[p.stem]], schema) if p.stem in tables else pq.read_table(p)
        pq.write_table(table, root / p.name)
    return str(root)


def session_rows(days):
    return [{"session_date": d, "session_no": i + 1} for i, d in enumerate(days)]


def bar(security, d, close, volume=100.0, run="r1"):
    return {"security_id": security, "date": d, "ingestion_run_id": run, "ticker": security} | dict.fromkeys(PRICES, close) | {"volume": volume}


def rows(spark, name, at):
    return [r.asDict() for r in QUERIES[name](spark, at).collect()]


def test_totals_run_to_the_end_of_the_calendar(spark, tmp_path):
    days = calendar(60)
    bars = [bar("pauses", d, 10.0 + i) for i, d in enumerate(days[:8])] + [bar("late", d, 5.0) for d in days[20:]] + [bar("none", days[3], math.nan), bar("none", days[5], -1.0)]
    got = rows(spark, "p2_totals", write(tmp_path, coverage_bars=bars, trading_sessions=session_rows(days)))
    first = {"pauses": days[0], "late": days[20], "none": days[3]}
    want = {(s, (f + dt.timedelta(days=i)).isoformat()) for s, f in first.items() for i in range((days[-1] - f).days + 1)}
    assert len(got) == len(want) and {(r["security_id"], r["day"]) for r in got} == want
    for r in got:
        d = dt.date.fromisoformat(r["day"])
        recent = [x for x in days if x <= d][-20:]
        valid = [b for b in bars if b["security_id"] == r["security_id"] and b["close"] > 0 and b["date"] <= d]
        inside = {"d7": [b for b in valid if (d - b["date"]).days < 7], "d30": [b for b in valid if (d - b["date"]).days < 30], "s20": [b for b in valid if b["date"] in recent]}
        for w, x in inside.items():
            assert r[f"n_{w}"] == len(x)
            assert r[f"volume_{w}"] == (sum(b["volume"] for b in x) if x else None)
            assert r[f"usd_{w}"] == (sum(b["close"] * b["volume"] for b in x) if x else None)
    assert [r["n_d30"] for r in sorted(got, key=lambda r: r["day"]) if r["security_id"] == "pauses"][-1] == 0


def test_bitemporal_uses_what_was_known_before_each_session(spark, tmp_path):
    days = calendar(60)
    spans = [("a", "OLD", None, None, 4), ("a", "NEW", days[10], None, 30), ("a", "TIE", days[20], days[40], 30), ("b", "B", days[5], days[8], 6), ("c", "C", days[0], days[3], 50)]
    history = [{"security_id": s, "ticker": x, "effective_from": f, "effective_to": t, "source_asof": days[k]} for s, x, f, t, k in spans]
    got = {(r["day"], r["security_id"]): (r["ticker"], r["tickers"]) for r in rows(spark, "j08_j15_bitemporal", write(tmp_path, symbol_history=history, trading_sessions=session_rows(days)))}
    want = {}
    for d in days:
        for s in "abc":
            known = [(k, x) for q, x, f, t, k in spans if q == s and (f or d) <= d <= (t or d) and days[k] < d]
            best = {x for k, x in known if k == max(known)[0]}
            if best:
                want[d.isoformat(), s] = (min(best), len(best))
    assert got == want and len(want) > 50


def test_membership_of_every_session(spark, tmp_path):
    days = calendar(30)
    full, left = "MONTH_END", "FORCED_EXIT"
    events = [(1, "a", True, full), (1, "b", True, full), (3, "b", False, left), (6, "a", True, full), (6, "b", True, full), (6, "c", False, full), (13, "a", False, left), (25, "a", True, full)]
    table = [{"date": days[k], "security_id": s, "active": x, "snapshot_type": kind, "knowledge_date": days[k]} for k, s, x, kind in events]
    bars = [bar(s, d, 10.0) for s in "ab" for i, d in enumerate(days) if (s, i) not in {("a", 8), ("b", 14)}]
    at = write(tmp_path, pit_membership=table, coverage_bars=bars, trading_sessions=session_rows(days))
    member = {}
    for i in range(30):
        snap = max((k for k, _, _, kind in events if kind == full and k <= i), default=None)
        gone = {s for k, s, _, kind in events if kind == left and snap is not None and snap < k <= i}
        member[i] = {s for k, s, x, kind in events if k == snap and kind == full and x} - gone
    got = {(r["day"], r["security_id"]) for r in rows(spark, "j04_j05_j06_membership", at)}
    assert got == {(days[i].isoformat(), s) for i, m in member.items() for s in m}
    got = {r["day"]: (r["expected"], r["observed"]) for r in rows(spark, "j07_proj08_coverage", at)}
    assert got == {days[i].isoformat(): (len(m), len(m - {s for s, k in (("a", 8), ("b", 14)) if k == i})) for i, m in member.items() if m}
    got = {r["session_no"]: (r["members"], r["joined"]) for r in rows(spark, "u12_membership_flow", at)}
    assert got == {i + 1: (len(m), len(m - member.get(i - 1, set()))) for i, m in member.items() if m}
    assert got[7] == (2, 1)


def test_reindexing_spans_all_sessions_and_securities(spark, tmp_path):
    days = calendar(130)
    bars = [bar("early", d, 1.0) for d in days[:120]] + [bar("later", d, 2.0) for d in days[50::2]] + [bar("last", days[-1], 3.0), bar("empty", days[7], math.nan)]
    got = {r["security_id"]: (r["slots"], r["filled"]) for r in rows(spark, "proj19_reindex", write(tmp_path, coverage_bars=bars, trading_sessions=session_rows(days)))}
    assert got == {"early": (130, 120), "later": (130, 40), "last": (130, 1), "empty": (130, 0)}


def test_every_session_is_expected(spark, tmp_path):
    days = calendar(50)
    seen = [("x", days[0]), ("x", days[45]), ("x", days[45]), ("x", days[49] + dt.timedelta(days=40)), ("y", days[41]), ("z", None)]
    documents = [{"doc_id": i, "ticker": t, "observed_at": d and dt.datetime.combine(d, dt.time(12))} for i, (t, d) in enumerate(seen)]
    got = {r["ticker"]: (r["expected"], r["seen"]) for r in rows(spark, "e16_expected_slots", write(tmp_path, documents=documents, trading_sessions=session_rows(days)))}
    assert got == {"x": (50, 2), "y": (50, 1), "z": (50, 0)}


def test_average_correlation_of_every_session(spark, tmp_path):
    days, rng, names = calendar(45), random.Random(5), "abcdef"
    price = {s: np.cumprod([100.0] + [1 + rng.uniform(-0.05, 0.05) for _ in days[1:]]) for s in names}
    bars = [bar(s, d, float(price[s][i])) for s in names for i, d in enumerate(days) if s != "f" or i >= 10]
    got = {r["session_no"]: (r["members"], r["correlation"]) for r in rows(spark, "w27_average_correlation", write(tmp_path, coverage_bars=bars, trading_sessions=session_rows(days)))}
    ret = {s: price[s][1:] / price[s][:-1] - 1 for s in names}
    assert sorted(got) == list(range(21, 46))
    for no, (members, correlation) in got.items():
        whole = [s for s in names if s != "f" or no >= 31]
        pairs = np.corrcoef([ret[s][no - 21 : no - 1] for s in whole])[np.triu_indices(len(whole), 1)]
        assert members == len(whole) and correlation == pytest.approx(pairs.mean(), abs=2e-6)


def by_session(columns, records):
    """Rows by their session, without regard to the order of rows and columns."""
    order, out = sorted(range(len(columns)), key=lambda i: columns[i]), {}
    for r in records:
        out.setdefault(int(r[columns.index("session_no")]), set()).add(tuple(r[i] for i in order))
    return out


def test_month_ends_of_the_factor_block(spark, small):
    whole = by_session((df := QUERIES["c01_registered_factors"](spark, small)).columns, df.collect())
    part = by_session((df := QUERIES["c01_registered_factors"](spark, small, month_ends=True)).columns, df.collect())
    ends = {x for (x,) in duck(small).execute("SELECT max(session_no) FROM trading_sessions GROUP BY date_trunc('month', session_date)").fetchall()}
    assert part == {s: x for s, x in whole.items() if s in ends} and len(part) > 20


def test_chains_of_any_length_with_returns_and_branches(spark, tmp_path):
    names = [f"N{i:02d}" for i in range(70)]
    base = {"source_asof": START, "exchange": "X"}
    table = [base | {"security_id": "long", "ticker": n, "effective_from": day(10 * i), "effective_to": day(10 * i + 9)} for i, n in enumerate(names)]
    table += [base | {"security_id": "back", "ticker": n, "effective_from": day(10 * i), "effective_to": day(10 * i + (15 if i == 0 else 9))} for i, n in enumerate("ABA")]
    got = {r["security_id"]: r for r in rows(spark, "j10_j11_lineage", write(tmp_path, symbol_history=table))}
    assert got["long"]["names"] == 70 and [x.split()[0] for x in got["long"]["chain"].split(">")] == names
    assert (got["long"]["returns"], got["long"]["branches"], got["back"]["returns"], got["back"]["branches"]) == (False, 0, True, 1)


def test_folds_to_the_end_of_a_long_calendar(spark, tmp_path):
    days = calendar(1550)
    got = rows(spark, "a35_walk_forward", write(tmp_path, trading_sessions=session_rows(days)))
    assert [r["fold"] for r in got] == list(range(1, 16)) and max(r["test_to"] for r in got) == 1550


def test_rank_tests_of_a_year_of_millions(spark, small, monkeypatch):
    n = 3_400_000
    ids = spark.range(n, numPartitions=8)
    monkeypatch.setattr(aggregate_queries, "_scores", lambda spark, at: ids.selectExpr("'2025' AS year", "id % 2 = 1 AS y", "CAST(id AS DOUBLE) AS score"))
    (got,) = rows(spark, "a29_a32_rank_tests", small)
    p = n // 2
    u = p * (p + 1) // 2  # the i-th of the odd numbers is above i even ones
    assert got == {"year": "2025", "p": p, "q": p, "auc": round(u / p**2, 6), "z": pytest.approx((u - p * p / 2) / math.sqrt(p * p * (n + 1) / 12), abs=1e-6)}


def test_rank_tests_of_years_with_one_outcome(spark, tmp_path):
    days = calendar(400)
    bars = [bar("a", d, 10.0 + i if i < 200 else 2000.0 - i) for i, d in enumerate(days)]  # only up in 2024, only down in 2026
    at = write(tmp_path, coverage_bars=bars, trading_sessions=session_rows(days))
    assert difference(spark, QUERIES["a29_a32_rank_tests"], SQL["a29_a32_rank_tests"], at) == ("", 3)
