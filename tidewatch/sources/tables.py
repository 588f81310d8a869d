"""Readers for the driver tables and their mapping onto the source-file shape.

A *source table* has columns ``repo, path, language, bytes, content``.  Any
table with a text column can be shown as one; these are the stand-ins used by
the registered queries (see FIXTURES.md section C).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import spread

SOURCE_COLUMNS = ("repo", "path", "language", "bytes", "content")

# Host part of a URL: scheme, then everything up to the first / : ? or #.
URL_HOST_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)"


# Tables whose rows carry whole texts: per-row work (regexes, line splits,
# parsing) is spread over all cores even when the table is one small file.
TEXT_TABLES = ("documents", "pages", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXT_TABLES else df


def documents_as_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> (repo=source, path=doc_id, language=lang)."""
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("repo"),
        F.col("doc_id").cast("string").alias("path"),
        F.col("lang").alias("language"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.col("text").alias("content"),
    )


def pages_as_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages -> (repo=URL host, path=page_id, language='html')."""
    p = read_table(spark, sf_dir, "pages")
    return p.select(
        F.regexp_extract("url", URL_HOST_RE, 1).alias("repo"),
        F.col("page_id").cast("string").alias("path"),
        F.lit("html").alias("language"),
        F.octet_length("html").cast("long").alias("bytes"),
        F.col("html").alias("content"),
    )


def conversations_as_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> (repo=conv_id, path=conv_id/turn, language=role)."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("repo"),
        F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"),
        F.col("role").alias("language"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.col("text").alias("content"),
    )


def all_text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three text tables as one source table (repo names are prefixed)."""
    parts = [
        documents_as_sources(spark, sf_dir).withColumn("repo", F.concat(F.lit("documents:"), "repo")),
        pages_as_sources(spark, sf_dir).withColumn("repo", F.concat(F.lit("pages:"), "repo")),
        conversations_as_sources(spark, sf_dir).withColumn("repo", F.concat(F.lit("conversations:"), "repo")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
