"""Rows of Arrow columns, a few at a time, so that a task holds a batch as it came and Python objects of some rows only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows whose lists are Python objects at once.
ROWS = 16


def lists(column: pa.Array, rows: int = ROWS) -> Iterator[list | None]:
    """The lists of a list column, one after another; None for null."""
    for at in range(0, len(column), rows):
        part = column.slice(at, rows)
        values, place = part.flatten().to_numpy(zero_copy_only=False).tolist(), 0
        for n in part.value_lengths().to_pylist():
            yield None if n is None else values[place : place + n]
            place += n or 0
