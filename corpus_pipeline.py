"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Toxic documents go, repeated passages of lines are cut out, one document of each
group of near-duplicates stays, documents with a benchmark item go, and what is
left is packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewatch.llm.common import stored
from placewatch.llm.decontam import without_contaminated
from placewatch.llm.lines import dedup_lines
from placewatch.llm.packing import pack_examples, pieces
from placewatch.llm.queries import VOCABULARY, table
from placewatch.llm.simhash import one_of_each
from placewatch.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, by a model learned from the labelled ones among them."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of two lines or more met before; ``n_chars`` follows the text."""
    return dedup_lines(docs, text_length="n_chars", passages=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    return one_of_each(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    packed = stored(pack_examples(docs, public_tokenizers.path(VOCABULARY)), "packed")
    return pieces(packed).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup),
          ("benchmark decontamination", decontamination), ("packing", packing)]
#: SQL can't learn the first stage's model; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
