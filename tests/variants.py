"""Copies of the small tables: empty, with rows of NULL, with every row twice, with further columns whose names clash."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

SMALL = Path("/root/testdata/sf0.001")


def write(to: Path, change) -> str:
    to.mkdir(parents=True, exist_ok=True)
    for p in SMALL.glob("*.parquet"):
        table = pq.read_table(p)
        pq.write_table(change(p.stem, table), to / p.name)
    return str(to)


def empty(name, table):
    return table.slice(0, 0)


def with_nulls(name, table):
    if name in ("trading_sessions", "source_targets"):
        return table
    return pa.concat_tables([table, pa.Table.from_pylist([dict.fromkeys(table.column_names)] * 3, table.schema)])


def twice(name, table):
    return table if name in ("trading_sessions", "source_targets") else pa.concat_tables([table, table])


def clashing(name, table):
    for extra in ("_entity", "_key", "_pos", "_value", "_time", "_source", "_day", "_n", "value", "id", "position", "row"):
        if extra not in table.column_names:
            table = table.append_column(extra, pa.array([f"x{i % 3}" for i in range(table.num_rows)]))
    return table
