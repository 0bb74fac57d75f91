"""Passages of test items inside documents, with a bounded share of replaced words.

A passage that repeats ``share`` of an item's words may have one word in ``1 / errors`` replaced. By the
pigeonhole principle, an item is split into pieces so short that every such passage holds one more whole
piece than it may have errors: one of them is hit exactly. All documents are searched for all pieces at once
by an Aho-Corasick automaton. Around the hits, the longest stretches of the item that may still be within
the error budget are verified by Myers' bit-parallel edit distance over words.
"""

from __future__ import annotations

import bisect
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import words

Hit = tuple[int, int]  # position in the item, position in the document


def piece_length(n: int, share: float = 0.5, errors: int = 10) -> int:
    """Words of a piece, the most for which any stretch of at least ``share`` of ``n`` words holds one whole piece more than its error budget."""
    least = max(math.ceil(n * share), 1)
    for size in range((least + 1) // (least // errors + 2), 1, -1):
        if all((length - size + 1) // size > length // errors for length in range(least, n + 1)):
            return size
    return 1


def edit_distance_within(pattern: Sequence[str], text: Sequence[str]) -> int:
    """Least edit distance between ``pattern`` and any stretch of ``text``, over words (Myers' bit vectors)."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        at[w] |= 1 << i
    up, down, score, best = full, 0, m, m
    for w in text:
        same = at.get(w, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        plus = down | (full & ~(diagonal | up))
        minus = diagonal & up
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up = minus | (full & ~(diagonal | plus))
        down = diagonal & plus
        best = min(best, score)
    return best


def _diagonals(hits: Iterable[Hit], slack: int, n: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring diagonals (document minus item position) that hold hits.

    A passage drifts by less than the item's ``n`` words, so a wide range is cut into overlapping ones of at
    most ``2 n``: a long text that repeats the item's pieces all over costs as much as its length.
    """
    low = high = None
    ranges = []
    for d in sorted({q - p for p, q in hits}):
        if high is None or d - high > slack:
            low = d
            ranges.append([low, d])
        ranges[-1][1] = high = d
    for low, high in ranges:
        for start in range(low, high + 1, n):
            yield start, min(high, start + 2 * n)
            if start + 2 * n >= high:
                break


def _longest_rise(worth: np.ndarray) -> int:
    """The greatest ``j - i`` with ``worth[j] >= worth[i]``: no longer stretch can pass, so that most items need no window at all."""
    lowest, highest = np.minimum.accumulate(worth), np.maximum.accumulate(worth[::-1])[::-1]
    # for each end j, the first i whose running minimum is not above worth[j]; only ends that no later one tops can be longest
    first = len(worth) - np.searchsorted(lowest[::-1], highest, "right")
    return int((np.arange(len(worth)) - first).max())


def repeats(item: Sequence[str], document: Sequence[str], hits: Iterable[Hit], share: float = 0.5, errors: int = 10) -> int:
    """Words of the longest stretch of ``item`` (at least ``share`` of it) found within the error budget; 0 if there is none."""
    n = len(item)
    least = max(math.ceil(n * share), 1)
    drift = max(n // errors, 1)
    for low, high in _diagonals(hits, 2 * drift + 1, n):
        # a word counts as found if any diagonal has it that insertions and deletions may reach from a hit:
        # no stretch with fewer of them can pass
        low, high = low - drift, high + drift
        worth = [0]
        for i, w in enumerate(item):
            found = w in document[max(i + low, 0) : max(i + high + 1, 0)]
            worth.append(worth[-1] + (1 if found else 1 - errors))
        worth = np.array(worth)
        for length in range(_longest_rise(worth), least - 1, -1):
            for i in np.flatnonzero(worth[length:] >= worth[: n - length + 1]).tolist():
                budget = length // errors
                text = document[max(i + low - budget, 0) : max(i + length + high + budget, 0)]
                if edit_distance_within(item[i : i + length], text) <= budget:
                    return length
    return 0


class ItemIndex:
    """The pieces of a block of items and the items' words."""

    def __init__(self, items: Iterable[tuple[int, str]], share: float, errors: int):
        import ahocorasick

        self.items = [(i, words(t)) for i, t in items]
        self.share, self.errors = share, errors
        pieces: dict[str, list[Hit]] = defaultdict(list)
        for number, (_, item) in enumerate(self.items):
            size = piece_length(len(item), share, errors)
            for start in range(0, len(item) - size + 1, size):
                pieces[" ".join(["", *item[start : start + size], ""])].append((number, start))
        self.lengths = {}
        self.automaton = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.automaton.add_word(piece, (len(piece), at))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item id, words of the passage) of every item that leaked into the text."""
        if self.empty or not text:
            return []
        document = words(text)
        joined = " ".join(["", *document, ""])
        hits: dict[int, list[Hit]] = defaultdict(list)
        starts: list[int] = []
        for end, (length, at) in self.automaton.iter(joined):
            if not starts:
                position = 0
                for w in document:
                    starts.append(position)
                    position += len(w) + 1
            q = bisect.bisect_left(starts, end - length + 1)
            for number, p in at:
                hits[number].append((p, q))
        found = []
        for number, own in hits.items():
            item_id, item = self.items[number]
            if length := repeats(item, document, own, self.share, self.errors):
                found.append((item_id, length))
        return found


@lru_cache(maxsize=2)
def _index(shared, share: float, errors: int) -> ItemIndex:
    """The index of a broadcast block; a worker process builds it once, however many tasks it runs."""
    return ItemIndex(shared.value, share, errors)


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    *,
    document_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    share: float = 0.5,
    errors: int = 10,
    block_items: int = 20_000,
) -> DataFrame:
    """(document_id, item_id, words): documents that repeat a passage of at least ``share`` of an item's words, a row per pair.

    Texts are read once per block of ``block_items`` items, whole, in place, and not shuffled here; only a
    block's items go to the tasks, through the driver: items are test material, of a bounded number. Items and documents that are NULL, empty or without words leak nothing.
    Several documents of the same id count as one, with the longest passage.
    """
    spark = documents.sparkSession
    queries = items.select(F.col(item_id).alias("_i"), F.col(item_text).alias("_t")).dropna().distinct()
    blocks = -(-queries.count() // block_items)
    types = dict(documents.dtypes) | {f"_{k}": v for k, v in items.dtypes}
    schema = f"`{document_id}` {types[document_id]}, `{item_id}` {types[f'_{item_id}']}, words int"
    result = None
    for b in range(blocks):
        block = [(r[0], r[1]) for r in queries.where(F.pmod(F.xxhash64("_i"), F.lit(blocks)) == b).collect()]
        shared = spark.sparkContext.broadcast(block)

        def search(batches, shared=shared):
            import pyarrow as pa

            index = _index(shared, share, errors)
            for batch in batches:
                rows = [(d, i, n) for d, t in zip(batch.column(0), batch.column(1), strict=True) for i, n in index.find(t.as_py())]
                if rows:
                    ids = pa.array([r[0].as_py() for r in rows], batch.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int32())], [document_id, item_id, "words"])

        found = documents.select(document_id, text).where(F.col(document_id).isNotNull() & F.col(text).isNotNull()).mapInArrow(search, schema)
        result = found if result is None else result.unionByName(found)
    if result is None:
        return spark.createDataFrame([], schema)
    return result.groupBy(document_id, item_id).agg(F.max("words").alias("words"))
