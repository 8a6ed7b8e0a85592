"""A corpus from raw documents: toxic ones out, near duplicates and leaks out, mixed, sharded.

STAGES lists the steps in order.  Each takes (spark, docs, sf_dir) and returns a table;
``run`` writes each result to the shared folder and goes on from the written copy.  All
stages but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwise.llm.base import fresh, quoted, read_table, stage
from panelwise.llm.decontam import clean_documents
from panelwise.llm.mixing import mix_documents, mixed_rows
from panelwise.llm.sharding import shard_documents
from panelwise.llm.simhash import simhash_groups
from panelwise.llm.toxicity import score_toxicity

SHARDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity operator predicts as toxic."""
    scored = score_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(*map(quoted, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the group's smallest id.

    Of rows that share this id one stays, chosen by a hash of the row.  A group whose
    ids are all null keeps one row in the same way.
    """
    grouped = simhash_groups(docs, words_per_shingle=3, max_bits=3)
    first = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    (nth,) = fresh(first, "nth")
    one = Window.partitionBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint"))).orderBy(F.xxhash64(*map(quoted, docs.columns)))
    return first.withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).select(*map(quoted, docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item."""
    return clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken, in the mix's own shards and order."""
    return mixed_rows(mix_documents(docs)).select(*map(quoted, docs.columns))


def shard_corpus(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their size, shard and slot."""
    return shard_documents(docs, shards=SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard_corpus),
]

#: The compression model, XXH64 fingerprints and components have no SQL form; tests/llm checks against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
