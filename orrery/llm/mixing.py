"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are words. Targets share a budget (a multiple of all words) by weight, none above a multiple of its source's
size; what a full source can't take is shared again by weight.

Each source's rows stand in a keyed random order. A target of f whole passes and a rest takes every row f times, and
once more the rows whose running size ends within the rest, so a source misses its target by less than its row at
the cut. Each pass is cut into blocks of about ``block_words`` in that order; these are disjoint and give each source
an exact quota of blocks. The tree splits the vector of quotas between the two halves of the output shards by a
multivariate-hypergeometric draw, again and again down to single shards, so every shard has the same number of
blocks (one apart at most) and each source's blocks are spread as by a uniform deal. A shard takes its quota as the
next blocks of the source's order. Within a shard rows are shuffled locally by a keyed hash.

Running sizes come from range partitions and one offset a partition and source, so a source with a third of all rows
is no single task's. The driver holds one row a source, one quota a source and shard, and one offset a partition and
source; it never sees rows.

Defined results: a null text has size 0; rows of size 0 are taken no times by ``mix_plan`` (taken 0) and stay out of
the mix; a null source is a source, the last; null ids are ordered first; repeated rows are drawn each for itself;
an empty table gives no rows. Same rows and seed, same mix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import range_partitions, text_of, unique_name
from orrery.session import cut, store

WEIGHTS, BUDGET, MOST, SHARDS, BLOCKS_A_SHARD, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 24, 64, 11


def words_of(column: str) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in the text."""
    return F.regexp_count(text_of(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Words for each source: budget * sum(sizes) shared by weight, none above most * its size."""
    total, n = float(sum(sizes)), len(sizes)
    left, out, free = budget * total, [0.0] * n, [i for i in range(n) if sizes[i] > 0]
    while free and left > 0:
        unit = left / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards, sources): how many blocks of each source each shard has. Columns add up to the quotas."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    total = int(quotas.sum())
    size = [total // shards + (s < total % shards) for s in range(shards)]

    def deal(low: int, high: int, held: np.ndarray) -> None:
        if high - low == 1:
            out[low] = held
            return
        middle = (low + high) // 2
        take = sum(size[low:middle])
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(held, take, method="marginals") if held.sum() else held * 0
        deal(low, middle, left)
        deal(middle, high, held - left)

    if shards and len(quotas):
        deal(0, shards, quotas.astype(np.int64))
    return out


def _ordered(rows: DataFrame) -> DataFrame:
    """rows (id, row, source, size, key) with start: the words that stand before a row in its source's order."""
    n_parts = range_partitions(rows)
    keys = [F.col("source").asc_nulls_last(), F.col("key").asc(), F.col("id").asc_nulls_first(), F.col("size").asc(), F.col("row").asc()]
    # A partition holds neighbours in the order; rows of size 0 need no place.
    ranged = cut(rows.where("size > 0").repartitionByRange(n_parts, *keys).withColumn("part", F.spark_partition_id()))
    offsets = ranged.groupBy("source", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(F.col("source").alias("of"), F.col("part").alias("at_part"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part", "source").orderBy(*[k for k in keys[1:]]).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    # One offset a partition and source that meet: at most partitions + sources of them, as sources are in order.
    joined = placed.join(F.broadcast(offsets), F.col("of").eqNullSafe(F.col("source")) & (F.col("at_part") == F.col("part")))
    return joined.select("id", "row", "source", "size", "key", (F.col("start") + F.col("offset")).alias("start"))


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    most: float = MOST,
    shards: int = SHARDS,
    seed: int = SEED,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken, draws (and mix_row, if ``row_col`` is given).

    draws holds a struct (pass, block, shard, local_key) for each time the mix takes the document; block numbers are
    a source's own, local_key orders a shard. weights repeat over the sources in code point order. mix_row is the
    number in ``row_col``, by which rows equal in id, text and source are ordered; else their place in docs orders them.
    """
    number = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    rows = cut(docs.select(F.col(id_col).alias("id"), number.alias("row"), F.col(source_col).cast("string").alias("source"), words_of(text_col).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), text_of(text_col)).alias("key")))
    by_source = rows.groupBy("source").agg(F.sum("size").alias("size")).collect()  # one row a source
    # Code points in order are UTF-8 bytes in order.
    by_source.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = [int(r["size"] or 0) for r in by_source]
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    goal = targets(sizes, weight, budget, most)
    spark = docs.sparkSession
    block_words = max(1, int(sum(goal) / (shards * BLOCKS_A_SHARD)))
    whole = [int(g // s) if s else 0 for g, s in zip(goal, sizes, strict=True)]
    rest = [g - w * s for g, w, s in zip(goal, whole, sizes, strict=True)]
    # Blocks of a whole pass and of the rest; a block's number is the place of a row's start, so none is longer than
    # block_words and a row.
    a_pass = [max(1, -(-s // block_words)) if s else 0 for s in sizes]
    a_rest = [int(-(-r // block_words)) if r >= 1 else 0 for r in rest]
    quotas = np.array([w * p + r for w, p, r in zip(whole, a_pass, a_rest, strict=True)], dtype=np.int64)
    dealt = split_quotas(quotas, shards, seed)
    ends = np.cumsum(dealt, axis=0).T if len(quotas) else np.zeros((0, shards), dtype=np.int64)
    # The last row of a rest is in where half of it or more lies before the cut.
    table = [
        (r["source"], sizes[i], float(goal[i]), whole[i], float(rest[i]), a_pass[i], [int(e) for e in ends[i]])
        for i, r in enumerate(by_source)
    ]
    known = spark.createDataFrame(table, "of string, source_size long, target double, whole int, rest double, a_pass long, ends array<long>")
    ordered = _ordered(rows)
    placed = ordered.join(F.broadcast(known), F.col("of").eqNullSafe(F.col("source")))
    block = F.floor(F.col("start") / block_words).cast("long")
    in_rest = F.col("start") + F.col("size") / 2 <= F.col("rest")
    passes = F.col("whole") + in_rest.cast("int")
    drawn = placed.withColumn("block", block).withColumn("passes", passes)

    def draw(p):
        at = p.cast("long") * F.col("a_pass") + F.col("block")
        shard = F.size(F.filter("ends", lambda e: e <= at)).cast("int")
        return F.struct(p.alias("pass"), at.alias("block"), F.least(shard, F.lit(shards - 1)).alias("shard"), F.xxhash64(F.lit(seed + 1), F.col("key"), F.col("start"), p).alias("local_key"))

    draws = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0), F.col("passes") - 1), draw)).otherwise(F.array().cast("array<struct<pass:int,block:bigint,shard:int,local_key:bigint>>"))
    columns = ["id", "row", "source", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"), draws.alias("draws")]
    empty = rows.where("size = 0").join(F.broadcast(known), F.col("of").eqNullSafe(F.col("source")))
    nothing = empty.select(
        "id", "row", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.array().cast("array<struct<pass:int,block:bigint,shard:int,local_key:bigint>>").alias("draws")
    )
    return drawn.select(*columns).unionByName(nothing).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken", "draws", *([] if row_col is None else [F.col("row").alias("mix_row")]))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **params) -> DataFrame:
    """docs as the mix takes them: a row for each draw, with shard and local_key beside the columns of docs.

    Columns of docs of these names give way. docs are numbered and written to the shared folder, and draws joined back by
    number, so repeated rows are drawn each for itself.
    """
    out = docs.drop(*[c for c in docs.columns if c.lower() in ("shard", "local_key")])
    row, draw = unique_name("mix_row", out.columns), unique_name("draw", out.columns)
    full = store(out.withColumn(row, F.monotonically_increasing_id()))
    plan = mix_plan(full, id_col, text_col, source_col, seed=seed, row_col=row, **params).where("taken > 0")
    rows = full.join(plan.select(F.col("mix_row").alias(row), F.explode("draws").alias(draw)), row)
    return rows.select(*[f"`{c}`" for c in out.columns], F.col(f"{draw}.shard").alias("shard"), F.col(f"{draw}.local_key").alias("local_key"))
