"""Training corpus from raw documents: toxicity filter, near-duplicate filter, repeated passages out, packing.

Every stage takes what its predecessor kept, as written and reread Parquet.  The first three return the columns of
``documents`` and carry any others; the last returns the packed pieces.  A null text counts as empty in all stages, texts of any length are taken whole, and an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from radiolith.llm import packing, simhash, suffix_dedup, toxicity
from radiolith.llm.common import materialize, table
from radiolith.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold.  Null and empty texts stay, rows that repeat are judged each; without labels of both kinds all stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.in_training_folds)
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of every group of near copies: SimHash fingerprints at most 3 bits apart, which meet at covering anchors, or
    a Jaccard similarity of 0.8 over shingles of five words, which differ in more bits.  Texts without words, null ones among them, are one group; of rows that repeat a doc_id as copies one
    stays."""
    return simhash.one_of_each_near(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less every byte covered by a 100-byte string that starts earlier.  A null text comes back empty, a document that is all repeats stays with an empty text; equal
    strings at the same place of rows that repeat a doc_id leave each other alone."""
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in sequences.  An empty or null text is its end token; rows that repeat are packed each."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("suffix_array_dedup", drop_repeated_passages), ("best_fit_packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
