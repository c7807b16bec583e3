"""Corpus pipeline over ``documents``: five stages, each calling one training-data operator.

1. *quality*: documents that the byte-level network scores below 0.3 go; it learns from ``labels`` by the same
   folds as its query.
2. *near_duplicates*: of every component of the n-gram Jaccard join the document with the smallest id stays.
3. *decontamination*: documents that hold a ``benchmark`` item, also with other numbers or names, go.
4. *mixing*: all documents, in the order of the Pfair schedule for weights of rows**0.7 a source.
5. *sharding*: every document gets its place in one of 8 shards along the Hilbert curve, and keeps its place in the mix
   (``mix_seq``: the order in which stage 4 wrote the rows; nothing is scheduled again).

A stage takes (spark, docs, sf_dir); all but the last return the columns of their input. Null or empty texts score as empty
and link with nothing; rows with null ids or repeated rows pass as the operators define; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebook.llm import hilbert, mixing, partenum, quality, templates
from tidebook.llm.common import crc_bucket
from tidebook.session import cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels, crc_bucket("doc_id", 5) != 0))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return partenum.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.keep_mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = mixing.as_written(docs)
    return hilbert.shard(placed, carry=placed.columns)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]
#: the first stage is a trained network, which SQL can't express; tests hold every stage against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
