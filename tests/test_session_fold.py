"""The session fold as a stream: rows delivered again, late and out of order over several micro-batches, and many sessions."""

import datetime as dt
import os
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from oracle import difference
from tidemark.streaming import bars as stream

QUERY = "st04_st06_session_fold_stream"
START = dt.datetime(2024, 1, 1)
FOLDED = ("n", "high", "low", "last", "volume", "vwap", "range_high", "range_low", "noon_volume")


def folded(rows):
    """The fold of one session by hand."""
    rows = sorted(rows, key=lambda r: (r["ts"], r["event_id"]))
    x, v = [r["value"] for r in rows], [1 + r["event_id"] % 5 for r in rows]
    early = [r["value"] for r in rows if r["ts"].hour < 8]
    noon = sum(k for r, k in zip(rows, v, strict=True) if r["ts"].hour < 12)
    vwap = sum(a * b for a, b in zip(x, v, strict=True)) / sum(v)
    return (len(rows), max(x), min(x), x[-1], sum(v), pytest.approx(vwap), max(early, default=None), min(early, default=None), noon)


def test_rows_delivered_again_or_late_are_put_in_their_place(spark, tmp_path):
    rng = random.Random(3)
    events = [{"event_id": i, "user_id": i % 4, "ts": START + dt.timedelta(minutes=rng.randrange(3 * 1440)), "value": float(rng.randrange(1000))} for i in range(300)]
    rng.shuffle(events)
    again = [e | {"value": float(rng.randrange(1000, 2000)), "ts": e["ts"].replace(hour=rng.randrange(24))} for e in events[:60]]
    once_more = [e | {"value": float(rng.randrange(1000))} for e in again[:20]] + [events[100]]
    empty = [e | {"value": None} for e in events[200:210]] + [e | {"value": float("nan")} for e in events[210:220]]
    files = [events[:100] + again[:30] + once_more[:5], events[100:200] + again[30:], events[200:] + once_more[5:], empty]
    (tmp_path / "events.parquet").mkdir()
    latest = {}
    for k, rows in enumerate(files):
        pq.write_table(pa.Table.from_pylist(rows, pa.schema({"event_id": pa.int64(), "user_id": pa.int64(), "ts": pa.timestamp("us"), "value": pa.float64()})), at := tmp_path / f"events.parquet/{9 - k}.parquet")
        os.utime(at, (1_700_000_000 + k, 1_700_000_000 + k))
        latest |= {r["event_id"]: r for r in rows if r["value"] is not None and r["value"] == r["value"]}
    want = {}
    for r in latest.values():
        want.setdefault((r["user_id"], r["ts"].date().isoformat()), []).append(r)
    for files_per_batch in (1, 8):
        table = stream.stream_table(spark, str(tmp_path), "events", files_per_batch, delivered=True)
        rows = table.selectExpr("*", "1 + event_id % 5 AS volume", "date_format(ts, 'yyyy-MM-dd') AS day")
        out = stream.run_to_end(stream.session_fold(rows, ["user_id", "day"], "event_id", "ts", "value", "volume", 8, 12), ["user_id", "day"], "update", "fold")
        assert {(r[0], r[1]): tuple(r[2:]) for r in out.select("user_id", "day", *FOLDED).collect()} == {k: folded(x) for k, x in want.items()}


def test_many_sessions_are_folded_in_time(spark):
    began = time.monotonic()
    assert difference(spark, entry.queries()[QUERY], entry.oracle_sql()[QUERY], "/root/testdata/sf0.1") == ("", 40083)
    assert time.monotonic() - began < 80
