"""The corpus pipeline: quality, exact copies, near copies, mixture, pieces. Part of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns what it keeps with the columns of documents; the last returns the
sampled segmentations of every document that is left. Stages never look back at documents that an earlier one
dropped; labels are read from sf_dir.

Defined results: a null text counts as empty in every stage; an empty text is scored like any other, is equal to other empty
texts, is near to none but these, has size 0 and so is taken by no mixture. Null ids are not held out and carry no label; of
equal texts a null id goes before any other; a component of near copies all of whose ids are null stays whole. A null source
is the last source. Rows that repeat id and text: one of them is left after the exact copies. Empty tables give empty
stages. Extra columns pass through the stages, whatever their names, but ``shard`` and ``local_key`` of the mixture and the
columns of the last stage give way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import exact_dedup, mixing, pieces, quality
from orrery.llm import near_copies as near
from orrery.session import cut, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects (score below 0.3)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps the row with the largest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with 0.8 of their five-word shingles in common keeps the smallest doc_id.

    SimHash (operator 10) proposes links first, MinHash bands those that it cannot find: README says why, with figures.
    """
    return near.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as their source's target asks: none, one or two rows each."""
    return mixing.mix(docs).select(*docs.columns)


def piece_samples(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations a row, with their ids and inclusion scores."""
    return pieces.encode(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("piece_samples", piece_samples),
]
#: Network, signatures, keyed draws and sampled segmentations have no SQL; tests/llm/test_pipeline.py holds a
#: brute-force version of every stage against this one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
