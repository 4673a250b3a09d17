"""From raw documents to packed training sequences.

Five stages, each written as Parquet and read again before the next: language identification, toxicity, exact
deduplication, near-duplicate join, packing.  Every stage works on all rows that its predecessor kept, and all but the
last return the columns of their input, whatever their names.

Nulls in columns that a stage doesn't read are carried.  An empty table passes every stage and gives an empty result.
Very long texts are judged and packed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import exact_dedup, language_id, ngram_jaccard, packing, toxicity
from tessel.llm.common import forget, remainder, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a language; texts without a letter, and those of which no language has a fair share, go.

    Null and empty texts go, a null language isn't learned from, null identifiers and repeated rows are judged like others;
    ties go to the language first in the alphabet.  Without any row with a language all go."""
    return language_id.accepted(docs, language_id.learn(docs, train=remainder("doc_id", 4) != 2))


def civility(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows below the limit of toxicity; the lexicon is learned from the rows' labels.

    Null and empty texts have no hits and stay; null identifiers have no labels; repeated rows are judged each.  A score at
    the limit goes.  Without labels of both kinds the base lexicon stands."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.learn(docs, labels, train=remainder("doc_id", 3) != 1))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id.

    A null text is equal to an empty one; a null identifier is less than any other; of rows that repeat text and identifier
    one stays."""
    return exact_dedup.deduplicate(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.75 make, the row with the smallest doc_id.

    Texts without words have no links and stay, and so do rows without identifier; rows that repeat an identifier are one
    document and stay or go together."""
    return ngram_jaccard.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences.

    Null and empty texts are their end id; null identifiers are kept as null; repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("toxicity", civility), ("exact_dedup", copies), ("ngram_jaccard_join", near_copies), ("best_fit_packing", packed)]

#: SQL can't express the trained models of the first stages, nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(spark, before)
        before = docs
    return docs
