"""Hashed byte n-grams of whole texts (numpy, used inside tasks)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import seeded_hash


def ngram_counts(data: bytes, orders: tuple[int, ...], bits: int, step: int = 1 << 20) -> np.ndarray:
    """Counts of the byte n-grams of ``orders``, hashed into 2^bits places.
    Long texts are counted in steps, so memory does not follow their length."""
    out = np.zeros(1 << bits, np.int64)
    shift = np.uint32(32 - bits)
    for start in range(0, len(data), step):
        for order in orders:
            a = np.frombuffer(data[start:start + step + order - 1], np.uint8).astype(np.uint32)
            if len(a) < order:
                continue
            n = len(a) - order + 1
            key = np.full(n, order, np.uint32)
            for j in range(order):
                key *= np.uint32(0x01000193)
                key ^= a[j:j + n]
            key *= np.uint32(0x9E3779B1)
            out += np.bincount(key >> shift, minlength=1 << bits)
    return out


def held_out(doc_id: Column) -> Column:
    """Documents kept out of all learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(keys: DataFrame, label: str, per_label: int, total: int, seed: str) -> DataFrame:
    """(doc_id, label): at most ``per_label`` rows of each label, at most ``total``
    in all, first in a seeded order; held-out and null ids are left out."""
    k = keys.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    k = k.select("doc_id", label, seeded_hash(seed, F.col("doc_id")).alias("__order"))
    # First a cut by the seeded order that leaves about twice what is wanted of each label
    # (one count per label), so that no label's rows meet in one task; then the exact places.
    counts = k.groupBy(F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    k = k.join(F.broadcast(counts.orderBy(F.col("__n").desc(), "__l").limit(total)), F.col(label) == F.col("__l"))
    k = k.filter(F.col("__order") < F.lit(float(1 << 60)) * F.least(F.lit(1.0), F.lit(2.0 * per_label + 64) / F.col("__n")))
    place = Window.partitionBy(label).orderBy("__order", "doc_id")
    k = k.withColumn("__place", F.row_number().over(place)).filter(F.col("__place") <= per_label)
    return k.orderBy("__place", "__order", label).limit(total).select(F.col("doc_id").alias("__id"), F.col(label).alias("__label"))


def unpack_vectors(rows: list) -> np.ndarray:
    """Half-precision vectors sent to the driver, as one float matrix (no second copy of all rows)."""
    x = np.empty((len(rows), len(rows[0]["v"]) // 2), np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r["v"], np.float16)
    return x
