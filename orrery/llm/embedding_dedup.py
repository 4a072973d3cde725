"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations, with verified pairs.

Unit vectors are padded to a power of two and rotated TABLES * HASHES times by three rounds of (random signs, fast
Hadamard transform); a hash is the axis, with sign, that the rotated vector is closest to. A table's key is HASHES
such axes. With multiprobe, a vector also enters the buckets with the second-best axis in each one place, so it is
in HASHES + 1 buckets of a table. Buckets never mix labels.

Equal vectors (same label, same components) are one node with a weight; rows and nodes know each other by 128 bits of
hash. Keys are made once a node and go with it. Within a bucket pairs are verified by their cosine in double precision.
Nodes with one first key (their own in table 0) are compared in that bucket only, and in all others not with each other;
so a bucket whose nodes all have one first key is skipped, and a large group of near copies is compared once, not once a
bucket. A pair with different first keys counts in the first of the buckets where it meets.

A bucket above BLOCK nodes is cut into chunks (see ``blocks``), each of nodes with one first key or, where few share one,
of mixed ones; each pair of chunks that has something to compare is a unit of work of its own. What leaves a unit of work is at most one row a node:
the links it found there, and an edge to the least node it is joined with there.

Buckets are counted from narrow rows first; a vector is sent only where it is compared.

Pairs below the threshold are never linked. A pair at the threshold or above is missed with small probability
(measured recall is in the README); n_links counts the links found.

Defined results: a vector that is null, zero, or holds a null or non-finite component links with nothing, nor does a
row with a null label; vectors of different lengths do not compare; copies count as links of each other; null ids
take part but are nobody's component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.blocks import chunk_size, whole_units
from orrery.operators.components import connected_components, join_counted
from orrery.session import cut, store

THRESHOLD, TABLES, HASHES, SEED, BLOCK, MOST = 0.93, 8, 3, 77, 128, 4096
#: Rows of a unit of work compared at once.
TILE = 512
#: Rows hashed at once.
CHUNK = 2048


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Unnormalised fast Walsh-Hadamard transform of the last axis (a power of two)."""
    n, step = x.shape[-1], 1
    x = x.copy()
    while step < n:
        view = x.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        a, b = view[..., 0, :].copy(), view[..., 1, :].copy()
        view[..., 0, :], view[..., 1, :] = a + b, a - b
        step *= 2
    return x


def bucket_keys(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, seed: int = SEED) -> np.ndarray:
    """(rows, tables, hashes + 1) bucket keys; the first key of a table is the vector's own, the others are probes."""
    rows, dim = unit.shape
    size = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((rows, size), dtype=np.float32)
    padded[:, :dim] = unit
    signs = np.random.default_rng([seed, size]).integers(0, 2, (tables, hashes, 3, size)).astype(np.float32) * 2 - 1
    out = np.empty((rows, tables, hashes + 1), dtype=np.int64)
    for t in range(tables):
        best, second = [], []
        for h in range(hashes):
            x = padded
            for r in range(3):
                x = _hadamard(x * signs[t, h, r]) / np.float32(np.sqrt(size))
            top = np.argpartition(-np.abs(x), 1, axis=1)[:, :2]
            values = np.take_along_axis(x, top, axis=1)
            swap = np.abs(values[:, 1]) > np.abs(values[:, 0])
            top[swap], values[swap] = top[swap][:, ::-1], values[swap][:, ::-1]
            axis = top * 2 + (values < 0)
            best.append(axis[:, 0])
            second.append(axis[:, 1])
        for probe in range(hashes + 1):
            key = np.zeros(rows, dtype=np.int64)
            for h in range(hashes):
                key = key * (2 * size) + (second[h] if probe == h + 1 else best[h])
            out[:, t, probe] = key
    return out


def rows_of(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vec, h1, h2): all but the id are null for a vector that links with nothing."""
    vec = F.col(vector_col)
    fit = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    usable = F.coalesce(fit & F.col(label_col).isNotNull(), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(usable, F.col(label_col).cast("string")).alias("label"), F.when(usable, vec).alias("vec"))
    hash_ = lambda *c: F.when(F.col("vec").isNotNull(), F.xxhash64(*c, "label", "vec"))
    return rows.withColumns({"h1": hash_(), "h2": hash_(F.lit(7))})


def _matrix(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of a column of number lists, and their values one after the other, in doubles."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return lengths, column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _units(full: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so that squares stay in range."""
    full = full / np.abs(full).max(axis=1, keepdims=True)
    return full / np.linalg.norm(full, axis=1, keepdims=True)


def _with_keys(nodes: DataFrame, tables: int, hashes: int, seed: int) -> DataFrame:
    """nodes (node, label, weight, vec) with dim and keys, the keys of all tables one after the other."""
    kind = nodes.schema["vec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, values = _matrix(batch.column(3))
            starts = np.concatenate([[0], np.cumsum(lengths)])
            keys = np.empty((batch.num_rows, tables * (hashes + 1)), dtype=np.int64)
            for dim in np.unique(lengths):
                rows_of_dim = np.flatnonzero(lengths == dim)
                for s in range(0, len(rows_of_dim), CHUNK):
                    rows = rows_of_dim[s : s + CHUNK]
                    unit = _units(values[starts[rows][:, None] + np.arange(dim)])
                    keys[rows] = bucket_keys(unit, tables, hashes, seed).reshape(len(rows), -1)
            ends = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
            made = [pa.array(lengths.astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["node", "label", "weight", "vec", "dim", "keys"])

    return nodes.select("node", "label", "weight", "vec").mapInArrow(run, f"node long, label string, weight long, vec {kind}, dim int, keys array<bigint>")


def _places(keyed: DataFrame, hashes: int) -> DataFrame:
    """(bucket, t, key, node, first): one narrow row for each bucket that a node enters.

    A second-best axis never equals the best, so a node is in a bucket once.
    """
    rows = keyed.select("node", "label", "dim", F.col("keys")[0].alias("first"), F.posexplode("keys").alias("at", "key"))
    rows = rows.withColumn("t", F.expr(f"`at` div {hashes + 1}").cast("int"))
    return rows.select(F.xxhash64("label", "dim", "t", "key").alias("bucket"), "t", "key", "node", "first")


def _work(places: DataFrame, block: int) -> DataFrame:
    """(bucket, t, key, node, chunk, i, j): each node once for each unit of work (bucket, i, j) that it takes part in."""
    groups = places.groupBy("bucket", "t", "key", "first").agg(F.count(F.lit(1)).alias("n"))
    # A bucket has at most as many groups as there are keys of a table.
    groups = groups.withColumn("all", F.sum("n").over(Window.partitionBy("bucket"))).where("all > 1")
    groups = cut(groups.withColumn("size", chunk_size(F.col("all"), block, MOST)).withColumn("home", (F.col("t") == 0) & (F.col("key") == F.col("first"))))
    large, crowded = (F.col("n") * 2 >= F.col("size")) & (F.col("all") > F.col("size")), F.col("all") > F.col("size")
    chunks = F.ceil(F.col("n") / F.col("size")).cast("int")
    # The home group is compared within itself; without it, one group alone has nothing to compare.
    sizes = groups.groupBy("bucket").agg(F.first(crowded).alias("crowded"), F.first("size").alias("size"), F.count(F.lit(1)).alias("groups"), F.max("home").alias("home"), F.sum(F.when(large, chunks).otherwise(0)).alias("own"), F.sum(F.when(large, 0).otherwise(F.col("n"))).alias("rest"))
    sizes = sizes.where((F.col("groups") > 1) | F.col("home")).withColumn("mixed", F.ceil(F.col("rest") / F.col("size")).cast("int"))
    sizes = cut(sizes.select("bucket", "mixed", (F.col("own") + F.col("mixed")).cast("int").alias("chunks")))
    # Large groups of crowded buckets have chunks of their own, which follow the mixed ones.
    before = Window.partitionBy("bucket").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    big = groups.where(large).withColumn("own", chunks).join(sizes.select("bucket", "mixed"), "bucket")
    big = cut(big.select("bucket", "first", "own", "home", (F.col("mixed") + F.coalesce(F.sum("own").over(before), F.lit(0))).cast("int").alias("low")))
    rows = places.join(sizes, "bucket").join(big, ["bucket", "first"], "left")
    turn = F.xxhash64("node")
    rows = rows.withColumn("chunk", F.when(F.col("own").isNotNull(), F.col("low") + F.pmod(turn, "own")).otherwise(F.pmod(turn, "mixed")).cast("int"))
    apart = F.col("own").isNotNull() & ~F.col("home")
    everything = F.sequence(F.lit(0), F.col("chunks") - 1)
    with_ = F.when(apart, F.filter(everything, lambda c: (c < F.col("low")) | (c >= F.col("low") + F.col("own")))).otherwise(everything)
    rows = rows.withColumn("other", F.explode(with_))
    return rows.select("bucket", "t", "key", "node", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))


def _local_roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges x-y: the least node that each can reach."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _unit_of_work(t: int, key: int, i: int, j: int, node: np.ndarray, weight: np.ndarray, chunk: np.ndarray, keys: np.ndarray, full: np.ndarray, threshold: float):
    """Links between chunks i and j of one bucket: (node, links found, least node joined), or None.

    keys: (nodes, tables, keys of a table).
    """
    order = np.argsort(node, kind="stable")
    node, weight, chunk, keys, unit = node[order], weight[order], chunk[order], keys[order], _units(full[order])
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    pairs = []
    for s in range(0, len(left), TILE):
        x, y = np.nonzero(unit[left[s : s + TILE]] @ unit[right].T >= threshold)
        x, y = left[s + x], right[y]
        if i == j:
            x, y = x[x < y], y[x < y]
        if not len(x):
            continue
        # One first key: met at home. Else: met in an earlier table, or in a lesser bucket of this one.
        one = keys[x, 0, 0] == keys[y, 0, 0]
        met = one & ((t > 0) | (keys[x, 0, 0] != key))
        apart = np.flatnonzero(~one)
        kx, ky = keys[x[apart]], keys[y[apart]]
        seen = np.zeros(len(apart), dtype=bool)
        for p in range(keys.shape[2]):
            for q in range(keys.shape[2]):
                seen |= (kx[:, :t, p] == ky[:, :t, q]).any(axis=1) | ((kx[:, t, p] == ky[:, t, q]) & (kx[:, t, p] < key))
        met[apart] = seen
        pairs.append((x[~met], y[~met]))
    if not sum(len(x) for x, _ in pairs):
        return None
    a, b = (np.concatenate(c) for c in zip(*pairs, strict=True))
    found = np.zeros(len(node), dtype=np.int64)
    np.add.at(found, a, weight[b])
    np.add.at(found, b, weight[a])
    root = _local_roots(len(node), a, b)
    linked = np.flatnonzero(found)
    return node[linked], found[linked], node[root[linked]]


def _compare(work: DataFrame, hashes: int, threshold: float) -> DataFrame:
    """(node, found, least) over sorted work: rows of one unit of work follow each other in a partition."""
    schema = pa.schema([("node", pa.int64()), ("found", pa.int64()), ("least", pa.int64())])
    names = ["dim", "t", "key", "i", "j", "node", "weight", "chunk", "label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, units in whole_units(batches, ("bucket", "i", "j")):
            col = {n: table.column(n).to_numpy() for n in names}
            lengths, values = _matrix(table.column("vec").combine_chunks())
            starts = np.concatenate([[0], np.cumsum(lengths)])
            keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1, hashes + 1)
            out = []
            for s, e in units:
                if e - s < 2:
                    continue
                # The bucket is named by a hash, so two buckets may meet here; they are told apart.
                names_of = list(zip(col["label"][s:e], col["dim"][s:e], col["t"][s:e], col["key"][s:e], strict=True))
                for name in sorted(set(names_of)):
                    at = np.array([s + k for k, other in enumerate(names_of) if other == name])
                    _, dim, t, key = name
                    full = values[starts[at][:, None] + np.arange(dim)]
                    got = _unit_of_work(int(t), int(key), int(col["i"][s]), int(col["j"][s]), col["node"][at], col["weight"][at], col["chunk"][at], keys[at], full, threshold)
                    if got is not None:
                        out.append(got)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return work.mapInArrow(run, "node long, found long, least long")


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    tables: int = TABLES,
    hashes: int = HASHES,
    seed: int = SEED,
    block: int = BLOCK,
) -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component_id, kept (id = component_id)."""
    rows = rows_of(vectors, id_col, vector_col, label_col)
    narrow = cut(rows.select("id", "h1", "h2"))
    # Equal vectors are one node: the group is named by its row with the least id.
    same = rows.where(F.col("vec").isNotNull()).groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("least_id"))
    nodes = store(same.withColumn("node", F.monotonically_increasing_id()))
    keyed = store(_with_keys(nodes, tables, hashes, seed))
    work = cut(_work(cut(_places(keyed, hashes)), block))
    work = work.join(keyed, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = cut(_compare(work, hashes, threshold))
    counts = found.groupBy("node").agg(F.sum("found").alias("found"))
    comps = connected_components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    named = nodes.select("node", "h1", "h2", "weight", "least_id").join(counts, "node", "left").join(comps, "node", "left")
    named = cut(named.withColumn("component", F.coalesce("component", "node")))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    of_node = join_counted(named, least, ["component"], "members")
    of_node = cut(of_node.select("h1", "h2", "weight", (F.coalesce("found", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    linked = join_counted(narrow.where("h1 IS NOT NULL"), of_node, ["h1", "h2"], "weight").select("id", "n_links", "component_id")
    alone = narrow.where("h1 IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
