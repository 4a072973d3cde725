"""Exact de-duplication with a heavy-hitter split (DataFrame functions only).

1. Each row is reduced to (id, digest of the normalised text), cut to the shared folder.
2. Misra-Gries summaries name digests that may hold 1/TRACKED of the rows or more.
3. An exact, map-side combined count of those candidates keeps the verified ones, at most TRACKED of them, each with
   its winner. They are broadcast, so rows of frequent digests get their group's values without a shuffle.
4. All other digests take one ordinary shuffle by digest. A frequent one that the summaries missed would be among them;
   results would be the same.

Defined results: a null text counts as empty, an empty text is a text like any other; the row with the largest id
stays, a null id being less than any other; of rows equal in id and text one stays (of
``drop_exact_duplicates`` that with the least hash of all its columns); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import TRACKED, ascii_lower, frequent, text_of, unique_name
from orrery.session import cut


def normalised(column: str) -> Column:
    return ascii_lower(text_of(column))


def _split(keyed: DataFrame, tracked: int) -> DataFrame:
    """Verified frequent digests with winner and size. keyed: id, row, digest, short (a hash of the digest)."""
    candidates = frequent(keyed, "short", tracked)
    total = F.broadcast(keyed.agg(F.count(F.lit(1)).alias("total")))
    return (
        keyed.join(F.broadcast(candidates), "short", "left_semi")
        .groupBy("digest")
        .agg(
            F.count(F.lit(1)).alias("group_size"),
            F.max("id").alias("keep_id"),
            F.max(F.struct(F.col("id").isNotNull(), "id", "row")).alias("best"),
        )
        .join(total, F.col("group_size") * tracked >= F.col("total"))
        .select("digest", "group_size", "keep_id", F.col("best.row").alias("keep_row"))
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    keyed = cut(
        docs.select(
            F.col(id_col).alias("id"),
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2(normalised(text_col), 256)).alias("digest"),
        ).withColumn("short", F.xxhash64("digest"))
    )
    heavy = cut(_split(keyed, tracked))
    hot = keyed.join(F.broadcast(heavy), "digest").select("id", "digest", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"))
    group = Window.partitionBy("digest")
    order = group.orderBy(F.col("id").desc_nulls_last(), F.col("row").desc())
    cold = keyed.join(F.broadcast(heavy), "digest", "left_anti").select(
        "id",
        "digest",
        F.max("id").over(group).alias("keep_id"),
        F.count(F.lit(1)).over(group).alias("group_size"),
        (F.row_number().over(order) == 1).alias("kept"),
    )
    return hot.unionByName(cold).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tracked: int = TRACKED) -> DataFrame:
    """docs without the rows that ``exact_duplicates`` drops; columns as they were.

    Rows of frequent digests are filtered map-side against the broadcast winners. Other rows are shuffled once, by
    digest, together with their columns.
    """
    columns = docs.columns
    digest, short, id_, row, turn = (unique_name(c, columns) for c in ("digest", "short", "id", "row", "turn"))
    full = docs.withColumn(digest, F.unhex(F.sha2(normalised(text_col), 256))).withColumn(id_, F.col(id_col)).withColumn(turn, F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    keyed = cut(full.select(F.col(id_).alias("id"), F.col(digest).alias("digest")).withColumn("row", F.lit(0)).withColumn("short", F.xxhash64("digest")))
    heavy = cut(_split(keyed, tracked)).select(F.col("digest").alias(digest), F.col("keep_id").alias(short))
    # A frequent digest's winning rows: one, or the repeats of one id, which a partial aggregation brings down to one.
    hot = full.join(F.broadcast(heavy), digest).where(F.col(id_).eqNullSafe(F.col(short)))
    hot = hot.groupBy(digest).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), turn).alias(row)).select(f"{row}.*")
    order = Window.partitionBy(digest).orderBy(F.col(id_).desc_nulls_last(), turn)
    cold = full.join(F.broadcast(heavy), digest, "left_anti").withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).select(*[f"`{c}`" for c in columns])
    return hot.unionByName(cold)
