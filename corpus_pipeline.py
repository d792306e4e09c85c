"""A corpus pipeline of five stages over ``documents``; each stage works on all that the one before it kept.

Edge cases: rows that share an id, or have none, are documents of their own: each stage tells them apart by their texts. Rows with
equal id and text are copies, of which the near-duplicate stage keeps one. Null texts, and texts without words, pass the first three stages
as they are and have nothing that the mix could take. Empty tables give empty ones, and columns may be called anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from burrow.llm import line_dedup, mixing, near_join, packing, quality
from burrow.llm.common import save, table

LEAST_QUALITY = 0.3


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: rejected documents go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), quality.learnable)
    return quality.keep_good(docs, model, LEAST_QUALITY)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated chunks of lines go, ``n_chars`` follows where any did; documents that consist of them go as a whole."""
    return line_dedup.dedup_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the first one (by id, then by text) stays."""
    return near_join.first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: documents appear as often as the mix takes them."""
    return mixing.repeated(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the places of all pieces in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", drop_bad),
    ("line dedup", drop_repeated_lines),
    ("near-duplicate join", drop_near_copies),
    ("source mixing", mix_sources),
    ("sequence packing", pack_sequences),
]
#: Compression, byte-pair encoding and packing have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = save(docs, name.replace(" ", "-"))
    return docs
