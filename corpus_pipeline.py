"""The corpus pipeline: documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
kept.  All but the last return the columns of ``documents``; the last returns a
row for each piece of a packed sequence.

Defined cases: a null or empty text is scored, is one group of exact copies and has
no shingles, words or tokens but the end id; rows without id or with a shared one are
decided by their own text; rows that repeat are exact copies; columns beside those of
``documents`` are carried along, whatever their names; an empty table gives an empty
result.

Scale: documents are scanned, not shuffled, but for the groups of copies, whose keys
are pre-aggregated; each stage is written as Parquet in the shared folder, so a
lost executor costs its tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boundsmith.llm.common import discard, stages_of_a_block, table, written
from boundsmith.llm.decontam import drop_contaminated
from boundsmith.llm.exact import drop_exact_copies
from boundsmith.llm.minhash import drop_near_copies
from boundsmith.llm.packing import pack
from boundsmith.llm.quality import accepted, fit
from boundsmith.llm.queries import digest_of_pieces, tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return accepted(docs, fit(docs, table(spark, sf_dir, "labels")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_copies(docs)


def keep_dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8."""
    return drop_near_copies(docs, k=5, threshold=0.8)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return digest_of_pieces(pack(docs, tokenizer_path()))


STAGES = [
    ("quality", keep_good),
    ("exact dedup", keep_distinct),
    ("near dedup", keep_dissimilar),
    ("decontamination", keep_uncontaminated),
    ("packing", packed),
]

#: Classifier, near-duplicate groups and packing aren't SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on its way goes once its rows are written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with stages_of_a_block() as paths:
            docs, path = written(stage(spark, docs, sf_dir), f"stage-{k}", compressed=True)
        discard(spark, *before, *(p for p in paths if p != path))
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
