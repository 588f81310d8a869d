"""Sharding by proportional stratified interleaving.

Rows are shuffled inside each source by a seeded hash and ranked; a row's
fractional rank is (rank + offset) / rows of the source, with a seeded offset
per source.  Sorting all rows by fractional rank interleaves the sources in
proportion, so cutting that order into equal parts gives shards that all hold
the mixture.  Law: ``rows`` (shard sizes are at most one row apart).

Ranks are exact but no source and no shard is ever gathered in one task: see
``common.running``.

Defined results: a null or empty text has size 8 and CRC 0; a null source is a
source of its own; repeated rows each get a slot of their own (which of two
identical rows gets which slot cannot be told apart); an empty table gives an
empty result; existing columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import bucket_bits, running, seeded_hash, source_key

LAW = "rows"


def assign_shards(docs: DataFrame, n_shards: int = 24, seed: str = "shard-1") -> DataFrame:
    """``docs`` plus size, text_crc32, law, shard, slot, grown_shard."""
    n = docs.count()
    bits = bucket_bits(n)
    d = (docs.withColumn("__size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8)
             .withColumn("__crc", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
             .withColumn("__src", source_key(F.col("source"))))
    d = d.withColumn("__h", seeded_hash(seed, F.col("doc_id"), F.col("__crc"), F.col("__src")))
    d = d.withColumn("__b", F.shiftright("__h", 60 - bits)).withColumn("__one", F.lit(1).cast("long"))
    d = running(d, "__src", "__b", ["__h", "doc_id", "__crc"], "__one")
    offset = (seeded_hash(seed, F.col("__src")) + F.lit(0.5)) / F.lit(float(1 << 60))
    d = d.withColumn("__f", (F.col("__rank") + offset) / F.col("__n"))
    # Second pass: place of every row in the order of fractional ranks.
    d = d.withColumn("__fb", F.least(F.floor(F.col("__f") * F.lit(float(1 << bits))), F.lit((1 << bits) - 1)).cast("long"))
    d = d.drop("__rank", "__before", "__n", "__total")
    d = running(d, None, "__fb", ["__f", "__h", "__src", "doc_id", "__crc"], "__one")
    shard = F.expr(f"(__rank * {n_shards}) div __n")
    d = d.withColumn("__shard", shard)
    first = F.expr(f"(__shard * __n + {n_shards - 1}) div {n_shards}")
    d = (d.withColumn("size", F.col("__size")).withColumn("text_crc32", F.col("__crc"))
          .withColumn("law", F.lit(LAW)).withColumn("slot", (F.col("__rank") - first).cast("long"))
          .withColumn("shard", F.col("__shard").cast("int")).withColumn("grown_shard", F.lit(None).cast("int")))
    return d.drop(*[c for c in d.columns if c.startswith("__")])
