"""Column expressions and distributed helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.components import TRACKED
from orrery.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The ASCII white space [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Rows of a range partition, of narrow rows.
RANGE_ROWS = 4_000_000


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, after which the worker gives free memory back.

    Workers go on to tasks of other stages, or wait beside the JVM; what the allocators of Arrow and C keep of a task's
    batches would be on top of what these take.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return whole


def text_of(column: str) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the fast built-in, which agrees on them."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def frequent(df: DataFrame, key: str, tracked: int = TRACKED, groups: int = 64) -> DataFrame:
    """Candidates for keys (a long column) with at least 1/tracked of df's rows: column ``key``, few rows.

    Misra-Gries summaries (the built-in frequent-items sketch, which descends from them) are built per task,
    merged in ``groups`` tasks and then in one, so the last merge reads ``groups`` rows at any input size. A
    summary has at most 4 * tracked counters. Candidates are not verified; callers count them exactly.
    """
    size = 4 * tracked
    parts = (
        df.where(F.col(key).isNotNull())
        .select(F.col(key).alias("item"), (F.spark_partition_id() % groups).alias("part"))
        .groupBy("part")
        .agg(F.expr(f"approx_top_k_accumulate(item, {size})").alias("summary"))
    )
    # A grouping key that never differs: unlike a global aggregate it starts no summary for an empty partition, which
    # the merge could not read.
    merged = parts.groupBy((F.col("part") < 0).alias("never")).agg(F.expr(f"approx_top_k_combine(summary, {size})").alias("summary"))
    found = merged.select(F.explode(F.expr(f"approx_top_k_estimate(summary, {tracked})")).alias("x"))
    return found.select(F.col("x.item").alias(key))


def keep_smallest(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """docs whose id is the ``component_id`` of some row of found (id_col, component_id); columns as they were.

    The ids that go are joined, not those that stay: they are far fewer, so the documents may stay where they are.
    """
    gone = unique_name("gone_id", docs.columns)
    stays = F.col(id_col).eqNullSafe(F.col("component_id"))
    ids = found.groupBy(F.col(id_col).alias(gone)).agg(F.max(stays).alias("stays")).where("NOT stays").select(gone)
    return docs.join(cut(ids), F.col(id_col).eqNullSafe(F.col(gone)), "left_anti")


def unique_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores in front as long as a column of that name is there (names ignore case)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted = f"_{wanted}"
    return wanted


def global_index(df: DataFrame, order: list[str], out: str = "row_number") -> tuple[DataFrame, int]:
    """df with the 0-based rank of each row by ``order``, and the number of rows.

    Range partitions, a local sort, and an offset for each partition: no task sees more than its range. Equal
    rows are told apart by their place in df, which must be cut (checkpointed) so that the place is fixed.
    The offsets are one row per partition.
    """
    spark = df.sparkSession
    tie, place, at, start = (unique_name(c, [*df.columns, out]) for c in ("tie", "place", "part", "start"))
    keys = [F.col(c).asc_nulls_first() for c in order] + [F.col(tie)]
    tied = df.withColumn(tie, F.monotonically_increasing_id())
    ranged = cut(tied.repartitionByRange(range_partitions(df), *keys).sortWithinPartitions(*keys).drop(tie))
    placed = ranged.withColumn(place, F.monotonically_increasing_id())
    part = F.shiftright(F.col(place), 33)
    counts = placed.groupBy(part.alias(at)).count().collect()  # one row per partition
    offsets, total = [], 0
    for row in sorted(counts, key=lambda r: r[at]):
        offsets.append((row[at], total))
        total += row["count"]
    starts = spark.createDataFrame(offsets or [(0, 0)], f"{at} long, {start} long")
    within = F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    numbered = placed.withColumn(at, part).join(F.broadcast(starts), at)
    return numbered.select(*[f"`{c}`" for c in df.columns if c.lower() != out.lower()], (F.col(start) + within).alias(out)), total


def range_partitions(df: DataFrame) -> int:
    """How many range partitions the rows of df, which must be cut, are dealt to: as shuffles have, more for many rows."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
