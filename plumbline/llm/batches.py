"""Arrow batches in tasks, and what tasks remember from one to the next."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa

_stores: list[dict] = []


def store() -> dict:
    """A dict for what one operator remembers in this process, until ``forget``."""
    _stores.append({})
    return _stores[-1]


def forget() -> None:
    """Let go what operators remember in this process: Spark's Python processes go from one stage to the next."""
    if any(_stores):
        for remembered in _stores:
            remembered.clear()
        gc.collect()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that a task holds the texts and results of few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
