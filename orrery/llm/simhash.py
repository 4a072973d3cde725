"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: 64 bits, one vote for each shingle of three words. Two fingerprints link if they differ in at most two
bits. Every one of the 64 bit positions gets a number from 0 to 7 (three bits); each non-zero mask vector v in 1..7
keeps the positions whose number has an odd inner product with v. Whatever two positions differ, some v is
orthogonal to both their numbers, so the pair agrees on all positions that v keeps: each linked pair collides in
at least one of the seven tables. That is a guarantee, not a probability.

Equal fingerprints are one node. A bucket of up to SMALL nodes is compared inside its task. In a larger bucket the
nodes within two bits are linked through hubs: fingerprints x and y differ in at most two bits exactly if some z is
within one bit of each, so every node joins the hubs of its 64 one-bit neighbours and its own. That is 65 rows a
node, with no pairs, and gives the same components.

Defined results: a null text counts as empty; a text without words has fingerprint zero, linked like any other; one
or two words make one shingle; null ids take part but are never a component's id unless all of its ids are null;
repeated rows count as copies; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import LOWER, UPPER, keep_smallest
from orrery.operators.components import connected_components, join_counted
from orrery.session import cut

WORDS, SEED, RADIUS, SMALL = 3, 42, 2, 64
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Shingles whose votes are counted at once.
CHUNK = 8192


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    votes = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = hashes[start : start + CHUNK]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    # bytes.split() without arguments splits at exactly [\x20\x09-\x0D].
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), seed)
    digest = xxhash.xxh64_intdigest
    if words == 3:
        shingles = map(b"%b %b %b".__mod__, zip(tokens, tokens[1:], tokens[2:], strict=False))
    else:
        shingles = (b" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1))
    total = len(tokens) - words + 1
    hashes = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8", count=total)
    return majority(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(id, fp): the fingerprint as a signed long, one row per document."""
    kind = docs.schema[id_col].dataType
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), words, seed) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["id", "fp"])

    return narrow.mapInArrow(run, f"id {kind.simpleString()}, fp long")


def covering_masks(bits: int = 64, radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks over ``bits`` positions, as unsigned numbers."""
    size = 1 << (radius + 1)
    number = [i % size for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (number[i] & v).bit_count() & 1) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(nodes: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """Edges (a, b) that join all fingerprints of ``nodes`` (column fp, distinct longs) within ``radius`` bits.

    The edges of small buckets are links themselves; those of large buckets may name hubs, values that need not be
    in ``nodes`` but lie within one bit of all the nodes they join. Both give the components of the link graph.
    """
    masks = [_signed(m) for m in covering_masks(64, radius)]
    rows = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])).alias("x"))
    rows = rows.select("fp", F.col("x.t").alias("t"), F.col("x.key").alias("key"))
    sizes = cut(rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # A bucket of one is most of them; those left are looked up again.
    held = cut(rows.join(sizes, ["t", "key"]))
    members = held.where(F.col("n") <= small).groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("all"))
    pairs = members.select("all", F.explode("all").alias("a")).select("a", F.explode(F.filter("all", lambda b: (b < F.col("a")) & (F.bit_count(b.bitwiseXOR(F.col("a"))) <= radius))).alias("b"))
    if radius != 2:
        raise ValueError("hubs for large buckets are for a radius of 2")
    ones = [F.lit(_signed(1 << i)) for i in range(64)]
    crowded = held.where(F.col("n") > small).select("fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(one) for one in ones])
    spread = crowded.select("fp", F.explode(near).alias("hub"))
    # A hub that only one node reaches joins nothing: an edge to the hub's smallest node leaves it out.
    least = spread.groupBy("hub").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hub", "b")
    hubs = spread.join(least, "hub").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(hubs).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """One row per document: id, fp (signed long), fingerprint (hex), component_id (smallest id reachable)."""
    prints = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")))
    found = connected_components(links(nodes.select("fp"), radius, small))
    named = cut(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    label = cut(join_counted(named, smallest, ["component"], "members").select("fp", "copies", "component_id"))
    return join_counted(prints, label, ["fp"], "copies").select(
        F.col("id").alias(id_col), "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest id stays; columns as they were.

    Ids should be unique; rows that repeat the smallest id of a component all stay, and a component whose ids are all
    null stays whole.
    """
    return keep_smallest(docs, near_duplicates(docs, id_col, text_col), id_col)
