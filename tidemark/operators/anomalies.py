"""Implausible readings of a source, measured by that source's own normal behaviour.

An isolation forest per source scores every reading on four features: its level against the levels before
and after, its difference from the reading before, its distance from the usual value of the weekday, and the
length of the run of equal values it stands in. The score from which a reading is suspect is calibrated per
source: probe readings at and beyond the limits of normal behaviour are scored by the same forest, and the
threshold lies between the usual score and the lowest of theirs, never above the latter. Explicit physical
limits apply to every reading; the limits of spikes and runs are then checked on the suspect ones. A suspect
reading that breaks no limit comes out as unusual, where all readings are asked for.

Rows are shuffled once, by source. A task that holds all rows of a source finds its accepted readings and its
scale itself. A source with more rows than a task should hold is split by a salt: its accepted readings, at
most one per day, and its exact scale are made by aggregates before, and go to each of its tasks; these fit
the same forest to a bounded sample of them, and each scores its share of the rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import accepted
from tidemark.scale import broadcast_if_bounded, cut_lineage, finite, hot_keys

_EULER = 0.5772156649015329


def _average_path(n: np.ndarray | int) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2)
    return np.where(n < 2, 0.0, np.where(n < 3, 1.0, 2 * (np.log(safe - 1) + _EULER) - 2 * (safe - 1) / safe))


class IsolationForest:
    """Isolation trees of equal depth, fitted and scored by array operations over all trees at once.

    Nodes are numbered as in a heap. A node that can't be split sends all points to its left child, which
    inherits its path length, so that every point takes the same number of steps. Cuts are drawn from a
    node's range widened up to ``reach``, so that a point beyond all of the sample falls into an empty side
    early instead of sharing the path of the sample's outermost point. ``weights``: how often a feature is
    cut.
    """

    def __init__(self, sample: np.ndarray, trees: int, size: int, seed: int, reach: np.ndarray, weights: np.ndarray):
        rng = np.random.default_rng(seed)
        self.size = min(size, len(sample))
        self.depth = max(1, math.ceil(math.log2(max(self.size, 2))))
        picked = rng.random((trees, len(sample))).argpartition(self.size - 1, axis=1)[:, : self.size]
        points = sample[picked].reshape(trees * self.size, -1)
        tree = np.repeat(np.arange(trees), self.size)
        node = np.zeros(trees * self.size, dtype=np.int64)
        width = 2 ** (self.depth + 1)
        self.feature = np.zeros((trees, width), dtype=np.int64)
        self.cut = np.full((trees, width), np.inf)
        frozen = np.full((trees, width), np.nan)
        for level in range(self.depth):
            nodes = 2**level
            here = tree * nodes + node
            feature = np.searchsorted(np.cumsum(weights)[:-1], rng.random(trees * nodes), "right")
            value = points[np.arange(len(points)), feature[here]]
            low, high = np.full(trees * nodes, np.inf), np.full(trees * nodes, -np.inf)
            np.minimum.at(low, here, value)
            np.maximum.at(high, here, value)
            count = np.bincount(here, minlength=trees * nodes)
            at = slice(nodes - 1, 2 * nodes - 1)
            done = frozen[:, at].ravel()
            # the empty side of a cut ends there, as a single point does
            single = np.isnan(done) & (count <= 1)
            done[single] = level
            high = np.where(count > 0, np.maximum(high, reach[feature]), high)
            split = np.isnan(done) & (high > low)
            cut = np.full(trees * nodes, np.inf)
            cut[split] = low[split] + rng.random(int(split.sum())) * (high - low)[split]
            self.feature[:, at], self.cut[:, at] = feature.reshape(trees, nodes), cut.reshape(trees, nodes)
            frozen[:, at] = done.reshape(trees, nodes)
            children = slice(2 * nodes - 1, 4 * nodes - 1)
            frozen[:, children] = np.repeat(frozen[:, at], 2, axis=1)
            node = node * 2 + (value > cut[here])
        leaves = 2**self.depth
        count = np.bincount(tree * leaves + node, minlength=trees * leaves).reshape(trees, leaves)
        last = slice(leaves - 1, 2 * leaves - 1)
        self.path = np.where(np.isnan(frozen[:, last]), self.depth + _average_path(count), frozen[:, last])
        self.trees = trees

    def score(self, points: np.ndarray, block: int = 16_384) -> np.ndarray:
        """From 0 to 1, in blocks of rows so that memory is bounded; about 0.5 is normal."""
        out = np.empty(len(points))
        width, leaves, columns = self.cut.shape[1], self.path.shape[1], points.shape[1]
        feature, cut, path = self.feature.astype(np.int32).ravel(), self.cut.ravel(), self.path.ravel()
        tree = np.arange(self.trees, dtype=np.int32)[None, :]
        for i in range(0, len(points), block):
            part = np.ascontiguousarray(points[i : i + block]).ravel()
            row = np.arange(len(part) // columns, dtype=np.int32)[:, None] * columns
            # flat positions in one array are gathered faster than pairs of indices
            at = np.broadcast_to(tree * width, (len(row), self.trees)).astype(np.int32)
            for level in range(self.depth):
                right = part.take(row + feature.take(at)) > cut.take(at)
                at = 2 * at - tree * width + 1 + right
            out[i : i + block] = path.take(at - tree * width - (leaves - 1) + tree * leaves).mean(axis=1)
        return 2.0 ** (-out / max(float(_average_path(self.size)), 1e-9))


@dataclass(frozen=True)
class Limits:
    """Of normal behaviour, and the forest's bounds. ``sample`` is the number of readings a tree is grown from;
    ``margin`` is where the threshold lies between the usual score (0) and the lowest one at the limits (1)."""

    spike: float = 8.0
    spell: int = 3
    stuck: int = 5
    level_sessions: int = 5
    trees: int = 32
    sample: int = 64
    margin: float = 0.5


def _middle(windows: np.ndarray) -> np.ndarray:
    """Median of each row without NaN; NaN for a row that has nothing else."""
    ordered = np.sort(windows, axis=1)
    n = (~np.isnan(ordered)).sum(axis=1)
    row = np.arange(len(ordered))
    return np.where(n == 0, np.nan, (ordered[row, np.maximum((n - 1) // 2, 0)] + ordered[row, np.minimum(n // 2, ordered.shape[1] - 1)]) / 2)


class Levels:
    """The usual levels before and after each position of a series (``x`` at ``days``, both without gaps in it)."""

    def __init__(self, days: np.ndarray, x: np.ndarray, limit: float, limits: Limits):
        self.days, self.x, self.limit, self.limits = days, x, limit, limits
        k, n = limits.level_sessions, len(x)
        pad = np.concatenate([np.full(k, np.nan), x, np.full(k, np.nan)])
        view = np.lib.stride_tricks.sliding_window_view(pad, k)
        #: before[s]: of x[s-k:s]; after[s]: of x[s:s+k]
        self.before, self.after = _middle(view[: n + 1]), _middle(view[k : k + n + 1])
        nothing = np.array([np.nan])
        self.steady_before = np.abs(np.concatenate([nothing, x]) - self.before) <= limit
        self.steady_after = np.abs(np.concatenate([x, nothing]) - self.after) <= limit

    def judge(self, day: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For readings in place of the series' own of that day: distance from both levels, and whether it is a spell's spike.

        A spell is of at most ``spell`` successive sessions that are all away from both levels, while the
        sessions next to it are at their levels; both levels must exist.
        """
        n = len(self.x)
        p, q = np.searchsorted(self.days, day, "left"), np.searchsorted(self.days, day, "right")
        distance, spike = np.zeros(len(value)), np.zeros(len(value), dtype=bool)
        padded = np.append(self.x, np.nan)
        for a in range(self.limits.spell):
            for b in range(self.limits.spell - a):
                s, e = p - a, q + b
                there = (s >= 1) & (e <= n - 1)
                s, e = np.minimum(np.maximum(s, 0), n), np.minimum(np.maximum(e, 0), n)
                before, after = self.before[s], self.after[e]
                away = np.where(there, np.minimum(np.abs(value - before), np.abs(value - after)), 0.0)
                distance = np.fmax(distance, away)
                fits = there & (away > self.limit) & self.steady_before[s] & self.steady_after[e]
                for k in [*(p - 1 - i for i in range(a)), *(q + i for i in range(b))]:
                    other = padded[np.minimum(np.maximum(k, 0), n)]
                    fits &= (np.abs(other - before) > self.limit) & (np.abs(other - after) > self.limit)
                spike |= fits
        return distance, spike


def _weekday_medians(days: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Median of each weekday at 0 to 6, of all at 7; a weekday without values has that of all."""
    weekday = (days + 3) % 7
    ordered = np.lexsort((x, weekday))
    count = np.bincount(weekday, minlength=7)
    start, x = np.cumsum(count) - count, x[ordered]
    whole = np.median(x) if len(x) else np.nan
    if not len(x):
        return np.full(8, np.nan)
    low, high = np.minimum(start + (count - 1) // 2, len(x) - 1), np.minimum(start + count // 2, len(x) - 1)
    return np.append(np.where(count > 0, (x[np.maximum(low, 0)] + x[high]) / 2, whole), whole)


def _ratio(value: np.ndarray, base: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        r = np.log(value / base)
    return np.where((value > 0) & (base > 0) & np.isfinite(r), r, np.nan)


def _bent(x: np.ndarray) -> np.ndarray:
    """A feature in units of its limit: squared below the limit, logarithmic and at most 2 beyond, so that a few extremes don't stretch its range."""
    with np.errstate(divide="ignore"):
        return np.where(x <= 1, x * x, np.minimum(1 + np.log2(np.maximum(x, 1)) / 4, 2.0))


def _runs(value: np.ndarray) -> np.ndarray:
    """Length of the run of exactly equal values at each position."""
    if not len(value):
        return np.zeros(0, dtype=int)
    starts = np.append(True, value[1:] != value[:-1])
    group = starts.cumsum() - 1
    return np.bincount(group)[group]


class Source:
    """What is normal for one source, from its accepted rows; judges any rows of it."""

    def __init__(self, days, fields, base, activity, centre, steady: Sequence[int], limits: Limits, seed: int):
        """``fields``: a row per field; ``steady``: the fields whose level is that of a series (of the others, 0)."""
        order = np.argsort(days, kind="stable")
        self.days, self.fields, base, activity = days[order], fields[:, order], base[order], activity[order]
        self.limits, self.steady = limits, set(steady)
        self.scale = centre if centre and np.isfinite(centre) and centre > 0 else np.nan
        counted = activity > 0
        self.levels, self.weekday, self.step, self.logs, self.run = [], [], [], [], []
        for f, value in enumerate(self.fields):
            r = _ratio(value, base)
            ok = ~np.isnan(r)
            self.levels.append(Levels(self.days[ok], r[ok], limits.spike * self.scale, limits) if f in self.steady else None)
            self.weekday.append(_weekday_medians(self.days[ok], r[ok]))
            with np.errstate(all="ignore"):
                logs = np.where((value > 0) & np.isfinite(value), np.log(value), np.nan)
            known = ~np.isnan(logs)
            steps = np.abs(np.diff(logs[known]))
            self.logs.append((self.days[known], logs[known]))
            self.step.append(max(float(np.median(steps)), 1e-6) if len(steps) else np.nan)
            run = np.zeros(len(value), dtype=int)
            run[counted] = _runs(value[counted])
            self.run.append(run)
        self.forest = self.threshold = None
        if np.isfinite(self.scale):
            parts = [self._features(f, self.days, v, base)[0] for f, v in enumerate(self.fields)]
            sample = np.concatenate([x[~np.isnan(x).any(axis=1)] for x in parts])
            if len(sample) >= 8:
                self.forest = IsolationForest(sample, limits.trees, limits.sample, seed, np.ones(4), np.array([0.35, 0.1, 0.15, 0.4]))
                at_limit = self.forest.score(self._probes(np.median(sample, axis=0))).min()
                usual = np.median(self.forest.score(sample))
                self.threshold = min(usual + limits.margin * max(at_limit - usual, 0.0), at_limit) - 1e-9

    def _features(self, f: int, day, value, base):
        """(features, spike, run length) of readings; features are NaN where nothing is known of normal behaviour."""
        r = _ratio(value, base)
        if self.levels[f] is None:
            level, spike = np.abs(r), np.abs(r) > self.limits.spike * self.scale
        elif len(self.levels[f].x):
            level, spike = self.levels[f].judge(day, r)
        else:
            level, spike = np.zeros(len(value)), np.zeros(len(value), dtype=bool)
        seasonal = np.abs(r - self.weekday[f][np.where(day >= -4_000_000, (day + 3) % 7, 7)])
        known_days, logs = self.logs[f]
        with np.errstate(all="ignore"):
            own = np.where((value > 0) & np.isfinite(value), np.log(value), np.nan)
        before = np.searchsorted(known_days, day, "left") - 1
        step = np.abs(own - logs[np.maximum(before, 0)]) / self.step[f] if len(logs) else np.full(len(value), np.nan)
        step = np.where(before >= 0, step, 1.0)
        at = np.clip(np.searchsorted(self.days, day, "left"), 0, max(len(self.days) - 1, 0))
        same = (self.days[at] == day) & (self.fields[f][at] == value) if len(self.days) else np.zeros(len(value), dtype=bool)
        run = np.where(same, self.run[f][at], 0) if len(self.days) else np.zeros(len(value), dtype=int)
        spike_at, stuck_at = self.limits.spike, self.limits.stuck
        with np.errstate(invalid="ignore"):
            parts = [level / self.scale / spike_at, np.nan_to_num(step, nan=1.0) / (4 * spike_at), seasonal / self.scale / spike_at, np.maximum(run - 1, 0) / (stuck_at - 1)]
            features = np.column_stack([_bent(x) for x in parts])
        return features, spike & ~np.isnan(r), run

    def _probes(self, normal: np.ndarray) -> np.ndarray:
        """Readings at the limits of normal behaviour and at growing distances beyond them, otherwise normal."""
        beyond = 2.0 ** np.arange(0, 7, 0.5)
        probes = np.repeat(normal[None, :], 2 * len(beyond), axis=0)
        probes[: len(beyond), 0] = probes[len(beyond) :, 3] = _bent(beyond)
        return probes

    def judge(self, day, values, base, runs: np.ndarray):
        """(score, unusual, spike, stuck) of rows, over their fields; ``runs``: rows that may be stuck. NULL readings are none."""
        n = len(day)
        score, flags = np.zeros(n), np.zeros((3, n), dtype=bool)
        for f, value in enumerate(values):
            features, spike, run = self._features(f, day, value, base)
            suspect = np.ones(n, dtype=bool)
            if self.forest is not None:
                scorable = ~np.isnan(features).any(axis=1)
                own = np.zeros(n)
                own[scorable] = self.forest.score(features[scorable])
                # what has no ratio can only be impossible or stuck: its run alone is scored
                rest = ~scorable & (run > 0)
                if rest.any():
                    own[rest] = self.forest.score(np.nan_to_num(features[rest], nan=0.0))
                suspect = own >= self.threshold
                score = np.maximum(score, own)
                flags[0] |= suspect & scorable
            flags[1] |= suspect & spike
            flags[2] |= suspect & runs & (run >= self.limits.stuck)
        return score, *flags


def _exact_medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, _scale): the exact median of a value that isn't negative, for keys with any number of rows.

    Rows are counted in bins of about 1 % of the value; only the bins that hold the middle ranks are then
    counted value by value. No key's rows meet in one task before they are counted.
    """
    bin_of = F.when(F.col(value) > 0, F.floor(F.log2(F.col(value)) * 64)).otherwise(F.lit(-(2**62))).cast("long")
    binned = rows.select(key, F.col(value).alias("_v"), bin_of.alias("_bin"))
    by_bin = Window.partitionBy(key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = binned.groupBy(key, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_upto", F.sum("_n").over(by_bin)).withColumn("_all", F.sum("_n").over(Window.partitionBy(key)))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    middle = cut_lineage(counts.where((F.col("_upto") > low) & (F.col("_upto") - F.col("_n") <= high)).select(key, "_bin", (F.col("_upto") - F.col("_n")).alias("_before"), "_all"))
    # at most two bins per key
    values = binned.join(broadcast_if_bounded(middle), [key, "_bin"]).groupBy(key, "_bin", "_v").agg(F.count(F.lit(1)).alias("_n"), F.first("_before").alias("_before"), F.first("_all").alias("_all"))
    inside = Window.partitionBy(key, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside)).withColumn("_from", F.col("_upto") - F.col("_n"))
    at = lambda rank: F.max(F.when((F.col("_from") <= rank) & (F.col("_upto") > rank), F.col("_v")))
    return ranked.groupBy(key).agg(((at(low) + at(high)) / 2).alias("_scale"))


def judged_rows(
    deliveries: DataFrame,
    quarantined: DataFrame,
    *,
    source: str,
    date: str,
    run: str,
    order: Sequence[str],
    fields: Sequence[str],
    steady: Sequence[str],
    base: str,
    activity: str,
    bounds: Sequence[str],
    origins: tuple[str, str] = ("deliveries", "quarantined"),
    limits: Limits = Limits(),
    rows_per_task: int = 200_000,
    everything: bool = False,
) -> DataFrame:
    """(origin, _source, _date, _run, score, reasons) of the rows with an implausible reading; a row per case.

    A reading is one of ``fields``; a NULL reading is no case. Its ratio to ``base`` is judged: for
    ``steady`` fields against the usual level, for the others against 0, in units of the median absolute
    ratio of the first field over the source's sound rows (all of ``fields``, ``base`` and ``bounds`` finite
    and positive, ``activity`` finite and not negative). Runs are counted over the accepted rows (greatest
    ``order`` per source and day) with activity above 0. Rows of ``quarantined`` are not judged for runs.
    A row without a usable base, and one without a source, can only be impossible or stuck. A source whose
    scale is unknown or 0 has no spikes. Repeated rows come out once. With ``everything``, all rows of
    a source come out; the reason ``unusual`` means that the forest finds a reading suspect, whether or not it breaks a limit.
    """
    order = list(order)
    positive = F.lit(True)
    for c in dict.fromkeys([*fields, base, *bounds]):
        positive = positive & finite(F.col(c)) & (F.col(c) > 0)
    sound = positive & finite(F.col(activity)) & (F.col(activity) >= 0)
    readings = [f"_f{i}" for i in range(len(fields))]
    numbers = [F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate([*fields, base, activity])]
    orders = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    parts = [
        df.select(F.lit(i).cast("byte").alias("_origin"), F.col(source).alias("_source"), day.alias("_day"), F.col(run).alias("_run"), *orders, *numbers, sound.alias("_sound"))
        for i, df in enumerate((deliveries, quarantined))
    ]
    judged = parts[0].unionByName(parts[1])
    impossible = F.lit(False)
    for c in readings:
        impossible = impossible | F.coalesce(~finite(F.col(c)) & F.col(c).isNotNull() | (F.col(c) <= 0), F.lit(False))
    judged = judged.withColumn("_impossible", impossible)
    hot = broadcast_if_bounded(hot_keys(deliveries.select(F.col(source).alias("_source")).unionByName(quarantined.select(F.col(source).alias("_source"))), "_source", rows_per_task).withColumnRenamed("_source", "_hot"))
    same = F.col("_source").eqNullSafe(F.col("_hot"))
    salt = F.coalesce(F.pmod(F.xxhash64("_day", "_run"), F.col("salts")).cast("int"), F.lit(0))
    rows = judged.join(hot, same, "left").withColumn("_salt", salt).drop("_hot", "salts")
    # of split sources, what each of their tasks must know; without any, these scans are empty
    own = parts[0].where(F.col("_source").isNotNull())
    split = own.join(hot, F.col("_source") == F.col("_hot"), "left_semi")
    best = accepted(split, ("_source", "_day"), [f"_o{i}" for i in range(len(order))], [f"_f{i}" for i in range(len(numbers))])
    size = F.abs(F.ln(F.col("_f0") / F.col(f"_f{len(fields)}")))
    scale = _exact_medians(split.where("_sound").withColumn("_size", size), "_source", "_size")
    copies = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    every = lambda df: df.join(hot, F.col("_source") == F.col("_hot")).withColumn("_salt", copies).drop("_hot", "salts")
    rows = rows.unionByName(every(best.withColumn("_origin", F.lit(2).cast("byte"))), allowMissingColumns=True)
    rows = rows.unionByName(every(scale.select("_source", F.col("_scale").alias("_f0"), F.lit(3).cast("byte").alias("_origin"))), allowMissingColumns=True)
    schema = "_origin byte, _source string, _day int, _run string, _score double, _impossible boolean, _unusual boolean, _spike boolean, _stuck boolean"
    kernel = _kernel(len(fields), len(order), [list(fields).index(c) for c in steady], limits, everything)
    found = rows.groupBy("_source", "_salt").applyInArrow(kernel, schema)
    kinds = ("impossible", "spike", "stuck", *(("unusual",) if everything else ()))
    names = F.array_compact(F.array(*[F.when(F.col(f"_{r}"), r) for r in kinds]))
    return (
        found.where(F.col("_source").isNotNull() | F.col("_impossible"))
        .select(
            F.when(F.col("_origin") == 0, origins[0]).otherwise(origins[1]).alias("origin"),
            "_source",
            F.date_from_unix_date("_day").alias("_date"),
            "_run",
            F.col("_score").alias("score"),
            names.alias("reasons"),
        )
        .groupBy("origin", "_source", "_date", "_run")
        .agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"))
    )


def flagged_rows(deliveries: DataFrame, quarantined: DataFrame, **how) -> DataFrame:
    """The cases alone, as in ``judged_rows``."""
    return judged_rows(deliveries, quarantined, **how, everything=False)


def _rank(column) -> np.ndarray:
    """Dense rank of the values of an Arrow column, NULL first."""
    import pyarrow.compute as pc

    return pc.rank(column, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()


def _accepted(days: np.ndarray, orders: Sequence, values: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """Positions of the row with the greatest order of each day; ties go to the greatest values, where NULL is least and NaN greatest."""
    keys = []
    for value, null in zip(values, missing, strict=True):
        keys += [np.where(null, -1, np.isnan(value)).astype(int), np.nan_to_num(value, nan=0.0, posinf=np.inf, neginf=-np.inf)]
    # lexsort takes the last key first; of a value, NULL, number and NaN come before its size
    ranked = [k for pair in reversed(list(zip(keys[1::2], keys[::2], strict=True))) for k in pair]
    by = np.lexsort([*ranked, *[_rank(o) for o in reversed(orders)], days])
    last = np.ones(len(by), dtype=bool)
    last[:-1] = days[by][1:] != days[by][:-1]
    return by[last]


def _kernel(fields: int, orders: int, steady: list[int], limits: Limits, everything: bool):
    def judge(table):
        import pyarrow as pa

        def number(t, name):
            return t.column(name).to_numpy().astype(float)

        kind = table.column("_origin").to_numpy()
        left, right = table.filter(pa.array(kind < 2)), table.filter(pa.array(kind == 2))
        scale = number(table.filter(pa.array(kind == 3)), "_f0")
        kept = left.select(["_origin", "_source", "_day", "_run"])
        impossible = left.column("_impossible").to_numpy(zero_copy_only=False).astype(bool)
        flags = {"_score": impossible.astype(float), "_impossible": impossible, "_unusual": impossible, "_spike": np.zeros(len(impossible), dtype=bool), "_stuck": np.zeros(len(impossible), dtype=bool)}
        own = table.column("_source")[0].as_py()
        if own is not None and left.num_rows:
            values = [number(left, f"_f{i}") for i in range(fields + 1)]
            delivered = left.column("_origin").to_numpy() == 0
            if right.num_rows or len(scale):
                known = right
            else:
                # the task holds all rows of the source
                mine = left.filter(pa.array(delivered & ~np.asarray(left.column("_day").is_null())))
                day = number(mine, "_day")
                columns = [mine.column(f"_f{i}") for i in range(fields + 2)]
                known = mine.take(_accepted(day, [mine.column(f"_o{i}") for i in range(orders)], np.array([c.to_numpy().astype(float) for c in columns]).reshape(fields + 2, -1), [np.asarray(c.is_null()) for c in columns]))
                sound = delivered & left.column("_sound").to_numpy(zero_copy_only=False).astype(bool)
                with np.errstate(all="ignore"):
                    size = np.abs(np.log(values[0][sound] / values[fields][sound]))
                scale = np.array([np.median(size)]) if len(size) else size
            accepted_values = np.array([number(known, f"_f{i}") for i in range(fields + 2)]).reshape(fields + 2, -1)
            source = Source(number(known, "_day").astype(np.int64), accepted_values[:fields], accepted_values[fields], np.nan_to_num(accepted_values[fields + 1]), scale[0] if len(scale) else np.nan, steady, limits, zlib.crc32(str(own).encode()))
            day = np.nan_to_num(number(left, "_day"), nan=-5_000_000).astype(np.int64)
            score, unusual, spike, stuck = source.judge(day, values[:fields], values[fields], delivered)
            flags |= {"_score": np.maximum(score, impossible), "_unusual": unusual | impossible, "_spike": spike, "_stuck": stuck}
        if not everything:
            hit = np.flatnonzero(flags["_impossible"] | flags["_spike"] | flags["_stuck"])
            kept, flags = kept.take(hit), {k: v[hit] for k, v in flags.items()}
        for name, column in flags.items():
            kept = kept.append_column(name, pa.array(column))
        return kept

    return judge
