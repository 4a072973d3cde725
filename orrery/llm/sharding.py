"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to N-1 by (id, CRC of the text, size); the permutation p of 0..N-1 is keyed by a seed. A row goes
to shard p mod S, slot p div S, so the counts of shards differ by one at most, slots are gapless from 0, and the row
at any (shard, slot) is found by ``invert``, without a table. Same rows, seed and S: same result.

Numbering sorts narrow rows by range and adds each partition's offset; no task sees more than its range, whatever
share of the rows has one id or one text. The permutation is numpy over Arrow batches of row numbers.

Defined results: a null text has no bytes and CRC 0; null ids come first; rows equal in id, size and CRC are
interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import global_index, text_of, unique_name
from orrery.session import cut, store

SEED, SHARDS, ROUNDS = 20_240_117, 24, 6
MASK64 = (1 << 64) - 1


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) of x with a round key."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _round_keys(seed: int) -> list[int]:
    keys = _mix(np.arange(ROUNDS, dtype=np.uint64), seed & MASK64)
    return [int(k) for k in keys]


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _feistel(x: np.ndarray, bits: int, keys: list[int], inverse: bool) -> np.ndarray:
    half, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    left, right = x >> half, x & mask
    for key in reversed(keys) if inverse else keys:
        if inverse:
            left, right = right ^ (_mix(left, key) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key) & mask)
    return (left << half) | right


def permute(numbers: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse) at ``numbers``.

    The network permutes 0..4^b-1, less than four times n; a value that falls outside is walked on along its cycle,
    which comes back inside, four steps on average at most.
    """
    bits, keys = _half_bits(n), _round_keys(seed)
    out = _feistel(numbers.astype(np.uint64), bits, keys, inverse)
    outside = np.flatnonzero(out >= np.uint64(n))
    while len(outside):
        out[outside] = _feistel(out[outside], bits, keys, inverse)
        outside = outside[out[outside] >= np.uint64(n)]
    return out.astype(np.int64)


def invert(shard: np.ndarray, slot: np.ndarray, n: int, shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """Row numbers of the rows at (shard, slot)."""
    return permute(np.asarray(slot, dtype=np.int64) * shards + np.asarray(shard, dtype=np.int64), n, seed, inverse=True)


def assign(numbered: DataFrame, n: int, number_col: str = "row_number", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """numbered with shard (int) and slot (long)."""

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    at = unique_name("permuted_place", numbered.columns)
    out = numbered.drop(*[c for c in numbered.columns if c.lower() in ("shard", "slot")]).withColumn(at, place(number_col))
    return out.withColumn("shard", (F.col(at) % shards).cast("int")).withColumn("slot", F.expr(f"`{at}` div {shards}")).drop(at)


def shard_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """One narrow row per document: id, size, text_crc32, row_number, shard, slot, and ``row_col`` if it is given."""
    narrow = cut(
        docs.select(
            F.col(id_col),
            (F.octet_length(text_of(text_col)).cast("long") + 8).alias("size"),
            F.crc32(text_of(text_col).cast("binary")).alias("text_crc32"),
            *([] if row_col is None else [F.col(row_col)]),
        )
    )
    numbered, n = global_index(narrow, [id_col, "text_crc32", "size"])
    return assign(numbered, n, "row_number", shards, seed)


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, tasks_per_shard: int = 8) -> None:
    """Write docs as shard=K folders, in slot order within each of ``tasks_per_shard`` slot ranges.

    docs are numbered and written to the shared folder first and the plan is joined back by number, so null and repeated
    ids lose and multiply nothing. Columns named shard or slot give way.
    """
    out = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "slot")])
    row = unique_name("shard_row", out.columns)
    full = store(out.withColumn(row, F.monotonically_increasing_id()))
    plan = shard_plan(full, id_col, text_col, shards, seed, row).select(row, "shard", "slot")
    placed = full.join(plan, row).drop(row)
    placed.repartitionByRange(shards * tasks_per_shard, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
