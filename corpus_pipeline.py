"""From raw documents to packed training sequences, a stage at a time.

Every stage takes what its predecessor kept, as a parquet table in the shared folder, and
all but the last return documents with all their columns.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm import toxicity
from tally.llm.common import table, written
from tally.llm.decontamination import contained_items
from tally.llm.exact_dedup import keep_one
from tally.llm.ngram_join import near_classes
from tally.llm.packing import pack
from tally.llm.queries import held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not take for toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out("id"))
    return toxicity.score(docs, model, name="_toxicity").filter("_toxicity < 0.5").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return keep_one(docs)


def with_row_key(docs: DataFrame) -> DataFrame:
    """Adds ``_key``, a hash of id and text: rows that repeat an id, or have none, are decided each by itself."""
    return docs.withColumn("_key", F.xxhash64(F.col("doc_id"), F.col("text")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; empty texts are no group."""
    keyed = with_row_key(docs)
    members = near_classes(keyed, "_key").filter("n_shingles > 0").select("_key", "component_id").distinct()
    members = written(members.join(keyed.select("_key", "doc_id").distinct(), "_key"), "stage-members")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("first")
    kept = members.groupBy("component_id").agg(first).select("first._key")
    others = members.join(kept, "_key", "left_anti").select("_key")
    return keyed.join(others, "_key", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    keyed = with_row_key(docs)
    found = contained_items(keyed, table(spark, sf_dir, "benchmark"), "_key").select("_key").distinct()
    return keyed.join(found, "_key", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 1024."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None  # trained scores and token ids are not SQL; tests/llm holds run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
