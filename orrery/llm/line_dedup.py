"""Line de-duplication over documents (DataFrame functions only).

Lines are exploded, normalised and hashed to 128 bits; a line's documents are counted exactly; lines over the
threshold go everywhere but in the document with the largest id that holds them; the rest is joined by position.

Keys with at least 1/TRACKED of all eligible lines are verified and broadcast (at most TRACKED of them), so a line
that stands in a third of the documents is dropped map-side. All other keys take an ordinary shuffle join, in which
no key has many rows. Documents without a dropped line pass as they are; the others are joined to the positions that
they lose by (id, text hash), so a row needs no number of its own.

Defined results: a null text counts as empty and an empty text has one empty line; rows with a null id count as one
document, smaller than any other; rows equal in id and text are one document and lose the same lines; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import ASCII_SPACE, TRACKED, ascii_lower, text_of, unique_name
from orrery.session import cut

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _wide_hash(c: Column) -> list[Column]:
    """128 bits as two longs, which hash aggregates and joins keep in fixed width."""
    return [F.xxhash64(c), F.xxhash64(F.lit(7), c)]


def frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, tracked: int = TRACKED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(eligible lines, heavy keys, other keys). A key has its hashes k1 and k2 and the largest id that holds it."""
    t1, t2 = _wide_hash(F.col("text"))
    k1, k2 = _wide_hash(F.col("key"))
    lines = (
        docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
        .where(F.length("text") >= min_chars)
        .select("id", t1.alias("t1"), t2.alias("t2"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .select("id", "t1", "t2", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", "t1", "t2", "pos", k1.alias("k1"), k2.alias("k2"))
    )
    lines = cut(lines)
    per_doc = lines.groupBy("k1", "k2", "id").agg(F.count(F.lit(1)).alias("n"))
    keys = cut(
        per_doc.groupBy("k1", "k2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_lines"), F.max("id").alias("keep_id"))
        .where(F.col("n_docs") >= min_docs)
    )
    total = F.broadcast(lines.agg(F.count(F.lit(1)).alias("total")))
    split = keys.join(total)
    heavy = split.where(F.col("n_lines") * tracked >= F.col("total")).select("k1", "k2", "keep_id")
    light = split.where(F.col("n_lines") * tracked < F.col("total")).select("k1", "k2", "keep_id")
    return lines, heavy, light


def dropped_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, tracked: int = TRACKED) -> DataFrame:
    """(id, t1, t2, dropped array<int>) of the documents that lose lines; t1 and t2 hash the text."""
    lines, heavy, light = frequent_lines(docs, id_col, text_col, min_chars, min_docs, tracked)
    loses = ~F.col("id").eqNullSafe(F.col("keep_id"))
    hot = lines.join(F.broadcast(heavy), ["k1", "k2"]).where(loses)
    cold = lines.join(F.broadcast(heavy), ["k1", "k2"], "left_anti").join(light, ["k1", "k2"]).where(loses)
    lost = hot.select("id", "t1", "t2", "pos").unionByName(cold.select("id", "t1", "t2", "pos"))
    return lost.groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("dropped"))


def drop_frequent_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, tracked: int = TRACKED) -> DataFrame:
    """docs with the text that stays in ``text_col``, and n_lines (before) and n_dropped beside it.

    Columns of docs named n_lines or n_dropped give way to the operator's own.
    """
    lost = dropped_positions(docs, id_col, text_col, min_chars, min_docs, tracked)
    out = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    id_, t1, t2, gone, lines = (unique_name(c, out.columns) for c in ("lost_id", "lost_t1", "lost_t2", "dropped", "lines"))
    lost = lost.select(F.col("id").alias(id_), F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("dropped").alias(gone))
    text = text_of(text_col)
    h1, h2 = _wide_hash(text)
    joined = out.join(lost, (h1 == F.col(t1)) & (h2 == F.col(t2)) & F.col(id_col).eqNullSafe(F.col(id_)), "left")
    split = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    return (
        joined.withColumn(lines, split)
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size(gone), F.lit(0)).cast("long"))
        .withColumn(text_col, kept)
        .select(*[f"`{c}`" for c in out.columns], "n_lines", "n_dropped")
    )
