"""From raw documents to token ids: quality rules, exact dedup, near dedup, source mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its result is written as Parquet
and reread. All but the last return the columns of documents, whatever their names.

Defined results, as of the operators: null and empty texts fail the quality rules, so no later stage sees them; rows with a
null id are never dropped as copies by the second and third stage (which drop by id), rows that share an id go together;
the mix gives each row its own copies; very long texts stay whole; empty tables give empty tables with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import exact_dedup, jaccard_join, mixing, quality_rules, sentencepiece_np
from lexforge.llm.joins import without_ids
from lexforge.session import Block, materialize, remove, table

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    index = exact_dedup.DigestIndex(spark)
    try:
        return exact_dedup.drop_copies(docs, index)
    finally:
        index.drop()


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    found = jaccard_join.near_duplicates(docs)
    dropped = materialize(spark, found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "near-copies")
    return without_ids(docs, dropped)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, repeats as repeated rows."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each row."""
    return sentencepiece_np.encode(docs, MODEL_PATH)


STAGES = [
    ("quality_rules", good_quality),
    ("exact_dedup", no_copies),
    ("jaccard_join", no_near_copies),
    ("mix_sources", mixed_sources),
    ("sentencepiece", token_ids),
]

#: SQL can't express the Jaccard components, the knapsack and the merges; a test holds run() against plain versions of the
#: five stages: ids that stay, words taken of each source, token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Only the table that it reads is left; a stage's own tables and its input go once it is written."""
    docs, before = table(spark, sf_dir, "documents"), ""
    for name, stage in STAGES[:-1]:
        with Block(spark) as block:
            docs = block.keep(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            remove(spark, before)
        before = block.kept
    return STAGES[-1][1](spark, docs, sf_dir)
