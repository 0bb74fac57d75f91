"""Totals over trailing periods as a rolling state: yesterday's totals, plus what arrives, minus what expires.

An amount arrives at its position ``p`` (a day number or a session number) and expires from a window at the
position ``p + w``, or at a position of its own where a window isn't of constant length on the axis. The
totals of a position are those of the position before, plus the amounts that arrive at it, minus the amounts
that expire at it. Over a stretch of positions this recurrence is a running sum of arrivals and expiries;
between stretches it is carried by a stored, versioned state: the totals at the last position and the
amounts that have still to expire. Positions without activity need no rows: totals change only where
something arrives or expires, and a request between two such positions gets the totals of the one before it.

Sums are exact: amounts are decimals with six places, so that adding and taking away leaves no residue.
Amounts of 1e22 or more don't fit; a total that holds any of them is NULL, its count is right.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.scale import scratch_dir
from tidemark.sources.versions import delete_file, list_names, read_text, write_text

_DECIMAL = "decimal(28,6)"

#: length of each window on the axis; None: each amount says itself from which position it no longer counts
Windows = Mapping[str, int | None]


def daily_amounts(rows: DataFrame, entity: str, position: Column, measures: Mapping[str, Column], expires: Mapping[str, Column] | None = None) -> DataFrame:
    """(_entity, _pos, _n, _big, _s_<measure>..., _x_<window>...): the amounts of each row as exact decimals.

    Rows whose entity, position or any measure is NULL hold no amount and are left out. ``expires``: for
    windows without a constant length, the position from which the amount no longer counts; NULL: it never
    counts in that window.
    """
    expires = expires or {}
    df = rows.select(
        F.col(entity).alias("_entity"), position.cast("int").alias("_pos"), *[c.cast("double").alias(f"_s_{m}") for m, c in measures.items()], *[c.cast("int").alias(f"_x_{w}") for w, c in expires.items()]
    ).dropna(subset=["_entity", "_pos", *[f"_s_{m}" for m in measures]])
    until = [f"_x_{w}" for w in expires]
    sums = [F.expr(f"try_cast(_s_{m} AS {_DECIMAL})").alias(f"_s_{m}") for m in measures]
    fits = df.select("_entity", "_pos", *sums, *until)
    big = F.when(F.greatest(*[F.col(f"_s_{m}").isNull().cast("int") for m in measures], F.lit(0), F.lit(0)) > 0, F.lit(1)).otherwise(F.lit(0))
    return fits.select("_entity", "_pos", F.lit(1).alias("_n"), big.alias("_big"), *[F.coalesce(f"_s_{m}", F.lit(0).cast(_DECIMAL)).alias(f"_s_{m}") for m in measures], *until)


def _parts(measures: Sequence[str]) -> list[str]:
    return ["_n", "_big", *[f"_s_{m}" for m in measures]]


def _kind(name: str) -> str:
    return "int" if name.startswith(("_n", "_big")) else _DECIMAL


def _names(windows: Windows, measures: Sequence[str]) -> list[str]:
    return [f"{p}_{w}" for w in windows for p in _parts(measures)]


def _amount(windows: Windows, measures: Sequence[str]) -> list[str]:
    return [*_parts(measures), *[f"_x_{w}" for w, length in windows.items() if length is None]]


def _until(windows: Windows) -> dict[str, Column]:
    return {w: F.col(f"_x_{w}") if length is None else F.col("_pos") + length for w, length in windows.items()}


def _change(at: Column, signs: Mapping[str, int], windows: Windows, measures: Sequence[str]) -> Column:
    """A change of the totals at a position: of each window, the amount times its sign (0 where it has none or never counts)."""
    fields, until = [at.cast("int").alias("_pos")], _until(windows)
    for w in windows:
        for p in _parts(measures):
            value = {1: F.col(p), -1: -F.col(p), 0: F.lit(0)}[signs.get(w, 0)]
            fields.append(F.when(until[w].isNotNull(), value).otherwise(F.lit(0)).cast(_kind(p)).alias(f"{p}_{w}"))
    return F.struct(*fields)


def _expiries(windows: Windows, measures: Sequence[str]) -> list[Column]:
    return [_change(until, {w: -1}, windows, measures) for w, until in _until(windows).items()]


class State:
    """Totals at position ``at`` and the amounts that have still to expire from them."""

    def __init__(self, at: int, totals: DataFrame, live: DataFrame):
        self.at, self.totals, self.live = at, totals, live


def trailing_totals(amounts: DataFrame, requests: DataFrame, windows: Windows, measures: Sequence[str], state: State | None = None) -> DataFrame:
    """The totals at every requested (_entity, _pos), with the requests' further columns.

    A request with a ``_to`` asks for every position from ``_pos`` to it; these are made after the shuffle.
    Out: the columns of ``requests``, and for each window ``n_<window>`` and ``<measure>_<window>``; no
    amounts give a count of 0 and NULL totals. ``amounts`` holds one row per entity and position. With the
    ``state`` of an earlier stretch, amounts and requests must lie after its position.

    Amounts, requests and state are shuffled once, by entity; the changes are made after that shuffle. An
    entity has at most one row per position there, as its deliveries were reduced to that before.
    """
    names, parts = _names(windows, measures), _amount(windows, measures)
    spans = "_to" in requests.columns
    extra = [c for c in requests.columns if c not in ("_entity", "_pos", "_to")]
    request = F.struct(F.lit(1).alias("_one"), *extra)
    none = F.lit(None).cast(requests.select(request.alias("_r")).schema["_r"].dataType).alias("_request")
    kinds = {**{p: _kind(p) if not p.startswith("_x_") else "int" for p in parts}, **{n: _kind(n) for n in names}, "_to": "int"}

    def shaped(df: DataFrame, what: str, own: Sequence[str], request: Column = none) -> DataFrame:
        rest = [F.col(c).cast(t).alias(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
        return df.select("_entity", F.col("_pos").cast("int").alias("_pos"), *rest, request.alias("_request"), F.lit(what).alias("_what"))

    rows = shaped(amounts, "arrive", parts).unionByName(shaped(requests, "ask", ["_to"] if spans else [], request))
    arrive = F.array(_change(F.col("_pos"), {w: 1 for w in windows}, windows, measures), *_expiries(windows, measures))
    nothing = lambda at: F.struct(at.alias("_pos"), *[F.lit(0).cast(_kind(n)).alias(n) for n in names])
    ask = F.transform(F.sequence("_pos", F.greatest("_pos", F.coalesce("_to", "_pos"))), nothing)
    made = F.when(F.col("_what") == "arrive", F.filter(arrive, lambda c: c["_pos"].isNotNull())).when(F.col("_what") == "ask", ask)
    if state is not None:
        rows = rows.unionByName(shaped(state.live, "live", parts)).unionByName(shaped(state.totals.withColumn("_pos", F.lit(state.at)), "total", names))
        made = made.when(F.col("_what") == "live", F.filter(F.array(*_expiries(windows, measures)), lambda c: c["_pos"] > state.at)).otherwise(F.array(F.struct("_pos", *names)))
    changes = rows.repartition("_entity").select("_entity", "_request", F.explode(made).alias("_c")).select("_entity", "_request", "_c.*")
    # a range frame takes in all changes of the requested position itself
    running = Window.partitionBy("_entity").orderBy("_pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = changes.select("_entity", "_pos", "_request", *[F.sum(n).over(running).alias(n) for n in names]).where(F.col("_request").isNotNull())
    out = [F.col("_entity"), F.col("_pos"), *[F.col(f"_request.{c}").alias(c) for c in extra]]
    for w in windows:
        out.append(F.col(f"_n_{w}").cast("int").alias(f"n_{w}"))
        for m in measures:
            out.append(F.when((F.col(f"_n_{w}") > 0) & (F.col(f"_big_{w}") == 0), F.col(f"_s_{m}_{w}")).alias(f"{m}_{w}"))
    return summed.select(*out)


def advance(amounts: DataFrame, to: int, windows: Windows, measures: Sequence[str], state: State | None = None) -> State:
    """The state at position ``to`` after the amounts that arrived since ``state`` (all amounts, where there is none).

    Amounts behind ``to`` are left for later; amounts at or before the state's position are part of it already.
    """
    names, parts = _names(windows, measures), _amount(windows, measures)
    until = list(_until(windows).values())
    new = amounts.where(F.col("_pos") <= to)
    live = new.select("_entity", "_pos", *parts)
    if state is not None:
        new = new.where(F.col("_pos") > state.at)
        live = new.select("_entity", "_pos", *parts).unionByName(state.live.select("_entity", "_pos", *parts))
    arrivals = new.select(_change(F.lit(to), {w: 1 for w in windows}, windows, measures).alias("_c"), "_entity")
    expired = live.select(F.explode(F.array(*_expiries(windows, measures))).alias("_c"), "_entity").where(F.col("_c._pos") <= to)
    if state is not None:
        expired = expired.where(F.col("_c._pos") > state.at)
    moved = arrivals.unionByName(expired).select("_entity", *[F.col(f"_c.{n}").alias(n) for n in names])
    if state is not None:
        moved = moved.unionByName(state.totals.select("_entity", *names))
    totals = moved.groupBy("_entity").agg(*[F.sum(n).cast(_kind(n)).alias(n) for n in names])
    return State(to, totals, live.where(F.greatest(*until, *until) > to))


class RollingState:
    """Versions of the state in a shared folder, one per position advanced to.

    ``advance_to`` stores the next version. ``correct`` takes corrected amounts: versions from the first
    affected position on are dropped and computed anew from the last version before it, so only affected
    positions are recomputed. A version's rows are written into a folder of their own before the version is
    listed, so a lost job leaves no half version, and another driver over the same folder finds all versions
    and goes on from the last one. Without ``root``, versions live as long as the driver.
    """

    def __init__(self, spark: SparkSession, name: str, windows: Windows, measures: Sequence[str], root: str | None = None):
        self.spark, self.windows, self.measures = spark, dict(windows), list(measures)
        self.root = f"{root}/{name}" if root else scratch_dir(spark, name)

    @property
    def versions(self) -> list[int]:
        """Positions of the stored versions, in order."""
        names = list_names(self.spark, f"{self.root}/versions")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def load(self, at: int | None = None) -> State | None:
        """The version at ``at``; by default the last one."""
        if at is None:
            stored = self.versions
            if not stored:
                return None
            at = stored[-1]
        text = read_text(self.spark, f"{self.root}/versions/{at}.json")
        if text is None:
            raise ValueError(f"there is no version {at}")
        stored = json.loads(text)
        # a state without rows has no files to tell its schema
        rows = self.spark.read.schema(T.StructType.fromJson(stored["schema"])).parquet(f"{self.root}/{stored['folder']}")
        totals, live = _names(self.windows, self.measures), _amount(self.windows, self.measures)
        return State(at, rows.where("_what = 'total'").select("_entity", *totals), rows.where("_what = 'live'").select("_entity", "_pos", *live))

    def _store(self, state: State) -> State:
        folder = f"rows/{state.at}-{uuid4().hex}"
        both = state.totals.withColumn("_what", F.lit("total")).unionByName(state.live.withColumn("_what", F.lit("live")), allowMissingColumns=True)
        both.write.partitionBy("_what").parquet(f"{self.root}/{folder}")
        write_text(self.spark, f"{self.root}/versions/{state.at}.json", json.dumps({"folder": folder, "schema": json.loads(both.schema.json())}))
        return self.load(state.at)

    def advance_to(self, arrivals: DataFrame, to: int) -> State:
        """Stores the version at ``to``. An arrival at or before the last version, or a ``to`` that isn't later, is an error."""
        last = self.load()
        if last is not None:
            if to <= last.at:
                raise ValueError(f"version {last.at} is stored already, {to} is not later")
            late = arrivals.where(F.col("_pos") <= last.at).select("_pos").first()
            if late is not None:
                raise ValueError(f"an amount of position {late[0]} is late for version {last.at}: correct the state from there")
        return self._store(advance(arrivals, to, self.windows, self.measures, last))

    def correct(self, amounts: DataFrame, first: int) -> list[int]:
        """Replays the versions at or after ``first`` over the corrected ``amounts`` (all of them, or those from the version before ``first`` on); gives the positions recomputed."""
        again = [v for v in self.versions if v >= first]
        for v in again:
            delete_file(self.spark, f"{self.root}/versions/{v}.json")
        for v in again:
            self._store(advance(amounts, v, self.windows, self.measures, self.load()))
        return again

    def replay(self, amounts: DataFrame, requests: DataFrame, positions: Sequence[int]) -> DataFrame:
        """The totals at ``requests`` (as in ``trailing_totals``) from a state advanced to each of ``positions`` in turn.

        A stretch's totals are made from the version before it and the amounts that arrive in it. Amounts and
        requests lie behind the last stored version; those behind the last position are in the last stretch.
        ``amounts`` are written once, by stretch, so that each stretch reads its own.
        """
        stretch = F.lit(0)
        for i, p in enumerate(positions[:-1]):
            stretch = F.when(F.col("_pos") > p, i + 1).otherwise(stretch)
        at = f"{self.root}/arrivals-{uuid4().hex}"
        amounts.withColumn("_stretch", stretch).write.partitionBy("_stretch").parquet(at)
        schema = amounts.schema.add("_stretch", "integer")
        stored = self.spark.read.schema(schema).parquet(at)
        found = None
        for i, p in enumerate(positions):
            state = self.load()
            own = stored.where(F.col("_stretch") == i).drop("_stretch")
            asked = requests
            begin, last = (positions[i - 1] if i else None), i == len(positions) - 1
            if "_to" in requests.columns:
                if begin is not None:
                    asked = asked.withColumn("_pos", F.greatest("_pos", F.lit(begin + 1)))
                if not last:
                    asked = asked.withColumn("_to", F.least("_to", F.lit(p)))
                asked = asked.where("_pos <= _to")
            else:
                asked = asked.where((F.col("_pos") > (begin if begin is not None else -(2**31))) & (F.col("_pos") <= (p if not last else 2**31 - 1)))
            part = trailing_totals(own, asked, self.windows, self.measures, state)
            found = part if found is None else found.unionByName(part)
            self._store(advance(own, p, self.windows, self.measures, state))
        return found
