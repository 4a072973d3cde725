"""Buckets compared in blocks: each pair of a bucket's chunks is a unit of work of its own.

Chunks of a bucket of n rows have about 2 * sqrt(n) rows, between two bounds. So a unit's rows grow with the square root of
the bucket, each row is sent to sqrt(n) / 2 units, and no task holds a bucket, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def chunk_size(n: Column, least: int, most: int) -> Column:
    """Rows of a chunk of a bucket of n rows."""
    return F.least(F.lit(max(least, most)), F.greatest(F.lit(least), F.ceil(2 * F.sqrt(n)))).cast("int")


def whole_units(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables that end where a unit ends, with the rows (from, to) of each unit. The rows of a unit, which have one ``key``
    (of numbers), follow each other."""

    def cut(held: list[pa.RecordBatch]) -> tuple[pa.Table, list[tuple[int, int]]]:
        table = pa.Table.from_batches(held)
        change = np.flatnonzero(np.logical_or.reduce([np.diff(table.column(k).to_numpy()) != 0 for k in key])) + 1
        edges = [0, *change.tolist(), table.num_rows]
        return table, list(zip(edges, edges[1:], strict=False))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        where = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        last = np.logical_and.reduce([w == w[-1] for w in where])
        first = batch.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if held and any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in key):
            yield cut(held)
            held = []
        if first:
            yield cut([*held, batch.slice(0, first)])
            held = []
        held.append(batch.slice(first))
    if held:
        yield cut(held)
