"""A mix of sources in which each holds a target share of the total size, in the order of a curriculum.

The total is the largest for which every source reaches its share without using a document more often than
its cap. Each source has a weight schedule over training time from 0 to 1, straight between knots; its
integral up to ``t`` is the share of the source's own demand that is due by then. Documents of a source stand
in an order by hash, pass after pass, each at the sum of tokens before it; inverting the integral at that
sum gives the document's training position. Range-sorting by position gives the mix.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import DEFAULT_VOCABULARY, token_counts
from tidemark.scale import broadcast_if_bounded, cut_lineage

Knots = Sequence[tuple[float, float]]


def same_source(source: Column) -> Column:
    """Trimmed, in lower case, ``-`` as ``_``; empty as NULL."""
    return F.nullif(F.regexp_replace(F.lower(F.btrim(source)), "-", "_"), F.lit(""))


@dataclass(frozen=True)
class Share:
    """What the mix takes of a source."""

    source: str
    target: float
    cap: int
    documents: int
    tokens: int
    demand: float
    schedule: Knots


def plan(targets: Mapping[str, tuple[float, int]], available: Mapping[str, tuple[int, int]], schedules: Mapping[str, Knots] | None = None, tilt: float = 0.5) -> list[Share]:
    """The demand of every source: its target times the largest total that no source's cap forbids.

    ``targets``: source to (weight, cap); ``available``: source to (documents, tokens). Sources without
    tokens or weight demand nothing; the weights of the others are scaled to 1. Without ``schedules``, a
    source begins nearer to its share of the available tokens and ends as far on the other side of its
    target, by at most ``tilt`` of the target; any schedule is scaled so that its integral is the target.
    """
    usable = {s: w for s, (w, cap) in targets.items() if w and w > 0 and (cap or 0) > 0 and available.get(s, (0, 0))[1] > 0}
    scale = sum(usable.values())
    total = min((targets[s][1] * available[s][1] * scale / w for s, w in usable.items()), default=0.0)
    everything = sum(available[s][1] for s in usable)
    shares = []
    for s, (w, cap) in sorted(targets.items()):
        documents, tokens = available.get(s, (0, 0))
        weight = usable.get(s, 0.0) / scale if usable else 0.0
        schedule = (schedules or {}).get(s)
        if schedule is None:
            step = max(-tilt * weight, min(tilt * weight, tokens / everything - weight)) if weight else 0.0
            schedule = ((0.0, weight + step), (1.0, weight - step))
        shares.append(Share(s, float(w or 0), int(cap or 0), documents, tokens, weight * total, schedule))
    return shares


def position(due: Column, schedule: Knots) -> Column:
    """The time at which a schedule's integral reaches the share ``due`` (0 to 1) of its whole."""
    knots = sorted((float(t), max(float(w), 0.0)) for t, w in schedule)
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole, before, found = sum(areas), 0.0, F.lit(knots[-1][0])
    pieces = []
    for (t0, w0), (t1, w1), area in zip(knots, knots[1:], areas, strict=False):
        if area > 0:
            slope = (w1 - w0) / (t1 - t0)
            rest = due * whole - before
            # the root of w0 x + slope x^2 / 2 = rest, in the form that is stable for small slopes
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
            pieces.append((before + area, F.least(F.lit(t1), F.lit(t0) + 2 * rest / F.greatest(F.lit(w0) + root, F.lit(1e-300)))))
            before += area
    for upto, value in reversed(pieces):
        found = F.when(due * whole <= upto, value).otherwise(found)
    return found


def sized(documents: DataFrame, document_id: str, text: str, source: str, targets: Sequence[str], vocabulary: str) -> DataFrame:
    """(document_id, _source, _tokens) of the documents of the target sources, written once."""
    rows = documents.select(document_id, same_source(F.col(source)).alias("_source"), F.col(text).alias("_text"))
    return cut_lineage(token_counts(rows.where(F.col("_source").isin(*targets)), "_text", vocabulary))


def targets_of(table: DataFrame, source: str = "source", weight: str = "target_weight", cap: str = "max_repeats", most: int = 10_000) -> dict[str, tuple[float, int]]:
    """The target table as a mapping. It is a setting, not data: more than ``most`` sources are refused."""
    rows = table.select(same_source(F.col(source)).alias("s"), F.col(weight).alias("w"), F.col(cap).alias("c")).where(F.col("s").isNotNull()).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} target sources")
    return {r["s"]: (r["w"], r["c"]) for r in sorted(rows, key=lambda r: (r["s"], r["w"] or 0))}


def available_of(sizes: DataFrame) -> dict[str, tuple[int, int]]:
    """Source to (documents, tokens); a row per target source."""
    rows = sizes.groupBy("_source").agg(F.count(F.lit(1)).alias("n"), F.sum("_tokens").alias("t")).collect()
    return {r["_source"]: (r["n"], r["t"]) for r in rows}


def offsets(sizes: DataFrame, document_id: str, shares: Sequence[Share], rows_per_task: int = 50_000) -> DataFrame:
    """(document_id, _source, _tokens, _before): the tokens of the source before each document, in the order of hashes.

    Copies (the same id, source and size) are counted first and take one row until the end, so no number of
    them fills a bucket. A source of any size is cut into buckets by hash, with about ``rows_per_task``
    documents in each. Sums of buckets are few and are added up first; within a bucket one task adds up its
    documents.
    """
    buckets = F.create_map(*[F.lit(x) for s in shares for x in (s.source, max(-(-s.documents // rows_per_task), 1))])
    counted = sizes.groupBy(document_id, "_source", "_tokens").agg(F.count(F.lit(1)).alias("_copies"))
    hashed = counted.withColumn("_hash", F.xxhash64(F.col(document_id), F.lit("mix"))).withColumn(
        "_bucket", F.pmod(F.shiftrightunsigned("_hash", 8), F.element_at(buckets, F.col("_source"))).cast("int")
    )
    hashed = hashed.withColumn("_size", F.col("_tokens") * F.col("_copies"))
    sums = hashed.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"))
    up_to = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_source", "_bucket", F.coalesce(F.sum("_sum").over(up_to), F.lit(0)).alias("_start"))
    count = sum(max(-(-s.documents // rows_per_task), 1) for s in shares)
    starts = F.broadcast(starts) if count <= 100_000 else starts
    inside = Window.partitionBy("_source", "_bucket").orderBy("_hash", document_id, "_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.join(starts, ["_source", "_bucket"]).withColumn("_before", F.col("_start") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    placed = placed.select(document_id, "_source", "_tokens", "_before", "_copies")
    # a group of very many copies is spread over tasks before it is written out
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / rows_per_task)))
    few = placed.where(F.col("_copies") <= rows_per_task).withColumn("_part", F.lit(0).cast("bigint"))
    many = placed.where(F.col("_copies") > rows_per_task).withColumn("_part", first).repartition(document_id, "_part")
    start, last = F.col("_part") * rows_per_task, F.least((F.col("_part") + 1) * rows_per_task, F.col("_copies")) - 1
    copies = few.unionByName(many).withColumn("_copy", F.explode(F.sequence(start, last)))
    return copies.select(document_id, "_source", "_tokens", (F.col("_before") + F.col("_copy") * F.col("_tokens")).alias("_before"))


def mixed(sizes: DataFrame, document_id: str, shares: Sequence[Share]) -> DataFrame:
    """(document_id, source, repeat, tokens, position): each use of a document in the mix, not yet sorted.

    A use belongs to the mix if the middle of its tokens lies within the source's demand, so a source is off
    its target by at most half a document.
    """
    wanted = [s for s in shares if s.demand > 0]
    if not wanted:
        return sizes.limit(0).select(document_id, F.col("_source").alias("source"), F.lit(1).alias("repeat"), F.col("_tokens").alias("tokens"), F.lit(0.0).alias("position"))
    constant = lambda pick: F.element_at(F.create_map(*[F.lit(x) for s in wanted for x in (s.source, pick(s))]), F.col("_source"))
    rows = offsets(sizes.where(F.col("_source").isin(*[s.source for s in wanted])), document_id, wanted)
    rows = rows.withColumn("_demand", constant(lambda s: float(s.demand))).withColumn("_whole", constant(lambda s: int(s.tokens)))
    middle = F.col("_before") + F.col("_tokens") / 2
    uses = F.least(F.floor((F.col("_demand") - middle) / F.col("_whole")).cast("int"), constant(lambda s: s.cap - 1))
    used = rows.where(middle <= F.col("_demand")).withColumn("_pass", F.explode(F.sequence(F.lit(0), F.greatest(uses, F.lit(0)))))
    due = F.least((F.col("_pass") * F.col("_whole") + F.col("_before")) / F.col("_demand"), F.lit(1.0))
    at = F.lit(None).cast("double")
    for s in wanted:
        at = F.when(F.col("_source") == s.source, position(due, s.schedule)).otherwise(at)
    return used.select(document_id, F.col("_source").alias("source"), (F.col("_pass") + 1).alias("repeat"), F.col("_tokens").alias("tokens"), at.alias("position"))


def mix(documents: DataFrame, targets: DataFrame, *, document_id: str = "doc_id", text: str = "text", source: str = "source", schedules: Mapping[str, Knots] | None = None, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """The mix, range-sorted by training position, ties by id and repeat.

    Documents without a source or of a source without a target are left out. Empty and NULL texts have no
    tokens; they stand where their hash puts them and change no share. Rows of the same id are different
    documents. No targets, or no tokens in any, give an empty mix.
    """
    wanted = targets_of(targets)
    sizes = sized(documents, document_id, text, source, list(wanted), vocabulary)
    shares = plan(wanted, available_of(sizes), schedules)
    return mixed(sizes, document_id, shares).orderBy("position", document_id, "repeat")


def actual_shares(documents: DataFrame, targets: DataFrame, *, document_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """A row per target source: target_weight, actual_share, documents, uses, most_uses, tokens. A source that can't be used has zeros."""
    wanted = targets_of(targets)
    sizes = sized(documents, document_id, text, source, list(wanted), vocabulary)
    shares = plan(wanted, available_of(sizes))
    used = mixed(sizes, document_id, shares).groupBy("source").agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.count_if(F.col("repeat") == 1).alias("documents"), F.max("repeat").alias("most_uses")
    )
    listed = documents.sparkSession.createDataFrame([(s.source, s.target) for s in shares], "source string, target_weight double")
    # a row per target source, so one task may add them up
    whole = F.sum("tokens").over(Window.partitionBy())
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    return (
        broadcast_if_bounded(listed)
        .join(used, "source", "left")
        .select("source", "target_weight", F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("actual_share"), zero("documents", "bigint"), zero("uses", "bigint"), zero("most_uses", "int"), zero("tokens", "bigint"))
    )
