"""The corpus pipeline: five of the training-data operators in a row.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` over all rows its
predecessor kept; results are written as Parquet and read back as the next
stage's ``docs``.  All stages but the last return the columns of ``documents``.

1. ``language``: drops documents without a letter or without text, and those between two languages;
2. ``near_duplicates``: keeps one document of every SimHash component;
3. ``decontaminate``: drops documents that hold a window of a benchmark item;
4. ``mix``: takes documents up to their source's target (some twice), in order of training position;
5. ``shard``: adds size, text_crc32, law, shard, slot.

Some stages cannot be stated in SQL (learned classifier, XXH64), so ORACLE_SQL is
None; ``tests/llm/test_pipeline.py`` compares ``run`` with a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import curriculum, decontam, langid, sharding, simhash
from tidewatch.llm.common import table
from tidewatch.session import checkpoint_dir, delete_path, scratch

ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null or empty texts and texts without a letter go; so do ambiguous ones."""
    return langid.accepted(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of every component stays."""
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a hit window go; an empty benchmark removes nothing."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document taken twice is two rows; one not taken is none."""
    return curriculum.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, in one of 24 shards with a slot of its own."""
    return sharding.assign_shards(docs).drop("grown_shard")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder.  A stage's own tables and
    the result before it are deleted once its result is written."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/tables/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{root}/{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
