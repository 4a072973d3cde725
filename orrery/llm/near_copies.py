"""Near copies: SimHash links and MinHash bands, each link verified exactly.

Two documents link if the sets of their shingles of five words have a Jaccard similarity of at least 0.8. The fingerprints of
operator 10, here of five-word shingles, propose first: each pair that its covering tables link (two bits). They cannot propose
all: such texts differ in about ten bits, and covering hashing at that radius needs 2^11 tables (see README). So a signature of
BANDS * ROWS minima proposes the rest: a pair at similarity s shares no bucket with probability (1 - s^ROWS)^BANDS, which is
3e-6 at 0.8, the most that a linked pair can have. Of the pairs that share one, those with fewer than LEAST equal minima go (a
linked pair has that few with probability 6e-8); the others are verified on the sets.

Equal sets are one node. A bucket is compared in two passes, and a pair belongs to the first band in which it agrees. In the
first, each node is in one chunk of its bucket and compared with that chunk. What is linked by then is one component and need
not be compared again, so in the second only buckets of several chunks and components are left. The nodes of such a bucket's
largest component are dealt to units, and up to MOST others are sent to each, which makes rows in proportion to the bucket. Only
where more are unlinked is each pair of chunks a unit (see ``blocks``). In both passes the minima say first which nodes have a
pair to verify in a unit; their texts are sent there, and pairs are verified, the most similar first, unless they are in one
component already. So a unit emits fewer links than it has nodes, and nothing is dropped or capped by the number of pairs.

Defined results: a null text counts as empty; texts without words are equal; fewer than five words make one shingle;
null ids take part but are never a component's id unless all of its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import simhash
from orrery.llm.blocks import chunk_size, whole_units
from orrery.llm.common import LOWER, UPPER, keep_smallest, lean
from orrery.operators.components import connected_components, join_counted
from orrery.session import cut, store, tidy

WORDS, SEED, BANDS, ROWS, LEAST = 5, 42, 24, 4, 56
#: The similarity that links, as a fraction of whole numbers.
LINK = (4, 5)
#: Shingles whose minima are taken at once; rows of a chunk of a bucket, at least and at most (also the others that are sent to
#: each unit of a component); rows compared at once.
CHUNK, BLOCK, MOST, TILE = 2048, 128, 512, 64
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The 64-bit hashes of a text's shingles, in order."""
    # bytes.split() without arguments splits at exactly [\x20\x09-\x0D].
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    digest, total = xxhash.xxh64_intdigest, max(1, len(tokens) - words + 1)
    grams = map(b" ".join, zip(*[tokens[i:] for i in range(words)], strict=False)) if len(tokens) >= words else [b" ".join(tokens)]
    return np.fromiter((digest(g, seed) for g in grams), dtype="<u8", count=total)


def shingles(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    return np.unique(hashes(text, words, seed))


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of shingles link."""
    up, down = LINK
    both = len(np.intersect1d(x, y, assume_unique=True))
    return down * both >= up * (len(x) + len(y) - both)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(SEED))
    odd = rng.integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return odd, rng.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)


def minima(sets: np.ndarray, odd: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of 32 bits."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    short = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    for start in range(0, len(short), CHUNK):
        np.minimum(least, (short[start : start + CHUNK] * odd + shift).min(axis=1), out=least)
    return least


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, node, size, minima, fp): node is the hash of the set of shingles, minima the signature's bytes, fp the
    fingerprint of operator 10."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, shift = _permutations()
        for batch in batches:
            node, size, made, prints = [], [], [], []
            for t in batch.column(1):
                every = hashes(t.as_py())
                s = np.unique(every)
                prints.append(simhash.majority(every))
                node.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                size.append(len(s))
                made.append(minima(s, odd, shift).tobytes())
            nodes = pa.array(np.array(node, dtype=np.uint64).view(np.int64))
            fps = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            cols = [batch.column(0), batch.column(1), nodes, pa.array(size, pa.int64()), pa.array(made, pa.binary()), fps]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "text", "node", "size", "minima", "fp"])

    return narrow.mapInArrow(lean(run), f"id {kind}, text string, node long, size long, minima binary, fp long")


def _sketched(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of nodes that the fingerprints (node, fp) propose: within two bits, through one node of each
    fingerprint, and equal fingerprints."""
    held = cut(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")))
    near = simhash.links(held.select("fp"))
    ends = [held.select(F.col("fp").alias(c), F.col("least").alias(f"node_{c}")) for c in ("a", "b")]
    apart = near.join(ends[0], "a").join(ends[1], "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    equal = nodes.join(held.where("n > 1"), "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return apart.unionByName(equal)


def _checked(pairs: DataFrame) -> DataFrame:
    """(a, b) of pairs (a, b, x, y: their texts) that link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [alike(shingles(x.as_py()), shingles(y.as_py())) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long")


def _places(nodes: DataFrame) -> DataFrame:
    """(bucket, band, node): the bucket of each node in each band, a hash of the band's minima."""
    width = 4 * ROWS
    band = F.posexplode(F.array(*[F.xxhash64(F.lit(i), F.substring("minima", 1 + width * i, width)) for i in range(BANDS)]))
    return nodes.select("node", band.alias("band", "bucket")).select("bucket", "band", "node")


def _chunks(places: DataFrame, block: int) -> DataFrame:
    """(bucket, chunks) of the buckets of more than one node."""
    sizes = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return sizes.select("bucket", F.ceil(F.col("n") / chunk_size(F.col("n"), block, MOST)).cast("int").alias("chunks"))


def _chunk() -> Column:
    return F.pmod(F.xxhash64("bucket", "node"), F.col("chunks")).cast("int")


def _within(places: DataFrame, sizes: DataFrame) -> DataFrame:
    """(bucket, band, i, j, node, side, comp): each node once, in the unit of its chunk; see _pairs for sides."""
    rows = places.join(sizes, "bucket").withColumn("i", _chunk())
    return rows.select("bucket", "band", "i", F.col("i").alias("j"), "node", F.lit(0).alias("side"), F.col("node").alias("comp"))


def _across(places: DataFrame, sizes: DataFrame, comps: DataFrame, block: int) -> DataFrame:
    """The units, as _within gives them, of what is left between chunks; comps(node, comp) is what is linked."""
    rows = places.join(sizes.where("chunks > 1"), "bucket").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = cut(rows.select("bucket", "band", "node", "chunks", "comp"))
    held = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = held.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("all")).where("all > most.n")
    main = cut(main.select("bucket", F.col("most.comp").alias("main"), F.col("most.n").alias("n"), (F.col("all") - F.col("most.n")).alias("others")))
    rows = rows.join(main, "bucket")
    few = rows.where(F.col("others") <= MOST).withColumn("pieces", F.ceil(F.col("n") / F.greatest(F.lit(block), "others")).cast("int"))
    own = F.array(F.struct(F.pmod(F.xxhash64("bucket", "node"), F.col("pieces")).cast("int").alias("i"), F.lit(1).alias("side")))
    each = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda i: F.struct(i.alias("i"), F.when(i == 0, 3).otherwise(2).alias("side")))
    few = few.withColumn("u", F.explode(F.when(F.col("comp") == F.col("main"), own).otherwise(each)))
    few = few.select("bucket", "band", F.col("u.i").alias("i"), F.col("u.i").alias("j"), "node", F.col("u.side").alias("side"), "comp")
    many = rows.where(F.col("others") > MOST).withColumn("chunk", _chunk())
    many = many.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: i != F.col("chunk"))))
    side = F.when(F.col("chunk") < F.col("other"), 1).otherwise(2).alias("side")
    return few.unionByName(many.select("bucket", "band", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", side, "comp"))


def _pairs(band: int, side: np.ndarray, comp: np.ndarray, size: np.ndarray, made: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, equal minima) of the pairs of a unit that belong to this band and may link. Rows of side 0 or 3 are compared with
    each other, those of side 1 with those of 2 and 3; rows of one component are not compared."""
    up, down = LINK
    for left, right, inner in ((side == 0, side == 0, True), (side == 1, side >= 2, False), (side == 3, side == 3, True)):
        left, right = np.flatnonzero(left), np.flatnonzero(right)
        for s in range(0, len(left) if len(right) else 0, TILE):
            rows = left[s : s + TILE]
            same = made[rows][:, None, :] == made[right][None, :, :]
            equal = same.sum(axis=2, dtype=np.int16)
            a, b = np.nonzero(equal >= LEAST)
            if not len(a):
                continue
            x, y = rows[a], right[b]
            first = same[a, b].reshape(len(a), BANDS, ROWS).all(axis=2).argmax(axis=1)
            fits = np.minimum(size[x], size[y]) * down >= np.maximum(size[x], size[y]) * up
            ok = (first == band) & fits & (comp[x] != comp[y]) & ((x < y) if inner else True)
            if ok.any():
                yield x[ok], y[ok], equal[a, b][ok]


def _units(work: DataFrame) -> DataFrame:
    return work.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    col = {n: table.column(n).to_numpy() for n in ("bucket", "band", "i", "j", "node", "side", "comp", "size")}
    return col | {"minima": np.frombuffer(b"".join(table.column("minima").to_pylist()), dtype=np.uint32).reshape(table.num_rows, BANDS * ROWS)}


def _active(work: DataFrame) -> DataFrame:
    """The rows of work (with size and minima) that have a pair to verify in their unit, without size and minima."""
    kept = ["bucket", "band", "i", "j", "node", "side", "comp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, units in whole_units(batches, ("bucket", "i", "j")):
            col, busy = _columns(table), np.zeros(table.num_rows, dtype=bool)
            for s, e in units:
                for a, b, _ in _pairs(int(col["band"][s]), *(col[c][s:e] for c in ("side", "comp", "size", "minima"))):
                    busy[s + a] = busy[s + b] = True
            yield from table.select(kept).filter(pa.array(busy)).to_batches()

    return _units(work).mapInArrow(lean(run), "bucket long, band int, i int, j int, node long, side int, comp long")


def _verified(work: DataFrame) -> DataFrame:
    """(a, b): links that join what is linked in each unit of work (with size, minima and text) and was not."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, units in whole_units(batches, ("bucket", "i", "j")):
            col, texts, out = _columns(table), table.column("text"), []
            for s, e in units:
                found = list(_pairs(int(col["band"][s]), *(col[c][s:e] for c in ("side", "comp", "size", "minima"))))
                if not found:
                    continue
                x, y, equal = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.argsort(-equal, kind="stable")
                # Rows of one component have one root from the start.
                _, at, which = np.unique(col["comp"][s:e], return_index=True, return_inverse=True)
                root, sets = at[which].tolist(), {}

                def top(k: int, root: list[int] = root) -> int:
                    while root[k] != k:
                        root[k] = root[root[k]]
                        k = root[k]
                    return k

                for k, m in zip(x[order].tolist(), y[order].tolist(), strict=True):
                    p, q = top(k), top(m)
                    if p == q:
                        continue
                    for n in (k, m):
                        if n not in sets:
                            sets[n] = shingles(texts[s + n].as_py())
                    if alike(sets[k], sets[m]):
                        root[max(p, q)] = min(p, q)
                        out.append((int(col["node"][s + k]), int(col["node"][s + m])))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in (0, 1)], schema=schema)

    return _units(work).mapInArrow(lean(run), "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: id, node and component_id (the smallest id reachable)."""
    signed = store(signatures(docs, id_col, text_col))
    first = [F.first(c).alias(c) for c in ("size", "minima", "fp")]
    nodes = cut(signed.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), *first))
    # Texts without words are one node and have no shingle to share.
    some = nodes.where("size > 0").select("node", "size", "minima", "fp")

    def texts(needed: DataFrame) -> DataFrame:
        # Equal sets may come from different texts; any of them will do.
        return signed.select("node", "text").join(needed.distinct(), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))

    def verified(work: DataFrame) -> DataFrame:
        signs = some.select("node", "size", "minima")
        active = cut(_active(work.join(signs, "node")))
        tidy(docs.sparkSession)
        out = cut(_verified(active.join(signs.join(texts(active.select("node")), "node"), "node")))
        del active
        tidy(docs.sparkSession)
        return out

    near = cut(_sketched(some.select("node", "fp")))
    ends = cut(texts(near.select(F.explode(F.array("a", "b")).alias("node"))))
    both = [ends.select(F.col("node").alias(c), F.col("text").alias(t)) for c, t in (("a", "x"), ("b", "y"))]
    links = cut(_checked(near.join(both[0], "a").join(both[1], "b")))
    del near, ends, both
    tidy(docs.sparkSession)
    places = _places(some)
    # A bucket of one is most of them; those left are looked up again.
    sizes = cut(_chunks(places, block))
    links = links.unionByName(verified(_within(places, sizes)))
    found = connected_components(links, tidied=True)
    if not sizes.where("chunks > 1").isEmpty():
        more = verified(_across(places, sizes, found.withColumnRenamed("component", "comp"), block))
        found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), tidied=True)
    named = cut(nodes.join(found, "node", "left").select("node", "least", "copies", F.coalesce("component", "node").alias("component")))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    label = cut(join_counted(named, smallest, ["component"], "members").select("node", "copies", "component_id"))
    return join_counted(signed.select("id", "node"), label, ["node"], "copies").select(F.col("id").alias(id_col), "node", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of each component the row with the smallest id stays; columns as they were.

    Ids should be unique; rows that repeat the smallest id of a component all stay, and a component whose ids are all
    null stays whole.
    """
    return keep_smallest(docs, near_copies(docs, id_col, text_col), id_col)
