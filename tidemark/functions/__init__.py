"""Scalar functions as Column expressions, and the registry of factors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_ticker(value: Column) -> Column:
    """Upper case, trimmed, ``.`` and ``/`` as ``-``; NULL if other characters are in it."""
    clean = F.regexp_replace(F.upper(F.btrim(value)), "[./]", "-")
    return F.when(clean.rlike("^[A-Z0-9-]{1,15}$"), clean)


def slug(value: Column) -> Column:
    """Lower case, everything else as single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-|-$", "")


def alias(value: Column) -> Column:
    """Lower case with underscores, for column names."""
    return F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_")


def log_share(a: Column, b: Column) -> Column:
    """Share of one compounded return in another; NULL outside the domain."""
    inside = (a > -1) & (b > -1) & (b != 0)
    return F.when(inside, F.log1p(F.when(inside, a)) / F.nullif(F.log1p(F.when(inside, b)), F.lit(0.0)))


def band_label(value: Column, edges: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first edge that the value reaches, from the greatest down; NULL for NULL."""
    out = None
    for edge, label in sorted(edges, reverse=True):
        out = F.when(value >= edge, label) if out is None else out.when(value >= edge, label)
    return F.when(value.isNotNull(), out.otherwise(rest))


def first_match(text: Column, rules: list[tuple[str, str]], rest: str) -> Column:
    """The label of the first pattern found in the case-folded text."""
    out = None
    for label, pattern in rules:
        hit = F.lower(F.coalesce(text, F.lit(""))).rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(rest) if out is not None else F.lit(rest)


def parse_date(text: Column, today: Column) -> Column:
    """The day that a text names relative to ``today``: today, now, yesterday, a number of days, months or years back (5D, 3M, 2Y), or an ISO day; NULL for others."""
    plain = F.lower(F.trim(text))
    number = F.regexp_extract(plain, r"^([0-9]+)[dmy]$", 1)
    n, unit = F.when(number != "", number.cast("int")), F.right(plain, F.lit(1))
    back = F.when(unit == "d", F.date_sub(today, n)).when(unit == "m", F.add_months(today, -n)).otherwise(F.add_months(today, -12 * n))
    return F.when(plain.isin("today", "now"), today).when(plain == "yesterday", F.date_sub(today, 1)).when(n.isNotNull(), back).otherwise(F.try_to_date(plain, "yyyy-MM-dd"))


def digest(*columns: Column) -> Column:
    """SHA-256 of the values, NULL told apart from empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)


@dataclass(frozen=True)
class Factor:
    """A factor: the columns it reads, its sign, and the expression over a dense panel with ``ret``."""

    name: str
    inputs: tuple[str, ...]
    direction: int
    build: Callable[[], Column]
    warm_up: int


REGISTRY: dict[str, Factor] = {}


def register(name: str, inputs: tuple[str, ...], direction: int, warm_up: int):
    """Adds a factor; its name is taken once, its direction is 1 or -1."""
    if name in REGISTRY or direction not in (1, -1):
        raise ValueError(f"{name}: taken, or its direction is not 1 or -1")

    def add(build: Callable[[], Column]) -> Callable[[], Column]:
        REGISTRY[name] = Factor(name, inputs, direction, build, warm_up)
        return build

    return add


def factor_values(panel: DataFrame, names: list[str]) -> DataFrame:
    """(security_id, session_no, factor_id, value, direction) of registered factors, all in one pass over the windows."""
    wide = panel.withColumns({n: REGISTRY[n].build() for n in names})
    stack = ", ".join(f"'{n}', `{n}`, {REGISTRY[n].direction}" for n in names)
    return wide.select("security_id", "session_no", F.expr(f"stack({len(names)}, {stack}) AS (factor_id, value, direction)"))
