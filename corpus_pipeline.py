"""The corpus pipeline: documents without toxic ones and copies, mixed to target weights and packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the
next one's docs. All but the last return the columns of documents, and each decides on all that its predecessor kept.
"""

from pyspark.sql import DataFrame, SparkSession

from loreforge.llm import exact_dedup, mixing, packing, similar, toxicity
from loreforge.llm.common import freeze, table
from loreforge.llm.subwords import public


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model rejects (score of 0.5 or more)."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for blanks one stays."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a five-word similarity of 0.8 or more the one with the smallest id stays. Links are looked up by SimHash
    fingerprints first, then, of documents that these leave apart, by MinHash and rare shingles; each is checked on whole sets of shingles."""
    return similar.drop_copies(docs, width=5, t=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its ids, its sequence and its place there."""
    return packing.pack(docs, public("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [("toxicity", without_toxic), ("exact_dedup", without_copies), ("simhash_near_dedup", without_near_copies), ("mixing", mixed), ("packing", packed)]

#: SQL can express neither the learned model nor the fingerprints' components; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = freeze(stage(spark, docs, sf_dir), name)
    return docs
