"""Documents to a training mix: quality, near-duplicates, benchmark leaks, source weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared
folder and reads it again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankweave.llm import leaks, mixing, near_copies, quality
from rankweave.runtime import materialize, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes, which learns from these and ``labels``.

    Null and empty texts go by the labels of short ones, repeated rows are scored each, an empty table stays empty, without
    labels of both kinds all stay; all columns are kept as they are.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id, null last, then the text's hash.

    Null and empty texts are one group; rows that share a doc_id but not a text are documents each; an empty table stays empty;
    all columns are kept as they are.
    """
    return near_copies.keep_one(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks.

    Null and empty texts stay, repeated rows are judged alike, null items are left out, an empty table stays empty, without a
    benchmark all stay; all columns are kept as they are.
    """
    return leaks.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and ``repeats`` (another name where docs has that one): how often each is read.

    Null and empty texts have no words and follow their draw, a null source is one of its own, rows that share doc_id and text
    are decided alike, an empty table stays empty.
    """
    return mixing.apply_mix(docs)


STAGES = [("quality classifier", good_quality), ("SimHash near-dedup", one_of_each), ("benchmark decontamination", without_leaks), ("mixing sources", mixed)]

#: SQL can't express the classifier's vectors or the shingles' hashes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
